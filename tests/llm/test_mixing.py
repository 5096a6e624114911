"""Raking against SQL, its marginals, and odd tables."""

import sys
from pathlib import Path

import pytest
from corpus import MIDDLE, documents, odd_rows, table
from pyspark.sql import functions as F

from matchlake.llm import mixing
from matchlake.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparison import connect, normal, rows_of_sql  # noqa: E402


def test_equals_sql(spark):
    frame = mixing.mixture(table(spark, MIDDLE, "documents"))
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == normal(*rows_of_sql(connect(MIDDLE), mixing.sql()))


def test_marginals_meet_targets(spark):
    cells = spark.createDataFrame(
        [(s, lang, t, float(10 + 7 * i + 3 * j + k)) for i, s in enumerate("ab") for j, lang in enumerate("xyz") for k, t in enumerate("pq")],
        "source string, lang string, topic string, tokens double",
    )
    goal = lambda rows: spark.createDataFrame(rows, "value string, share double")
    targets = {"source": goal([("a", 0.3), ("b", 0.7)]), "lang": goal([("x", 0.5), ("y", 0.3), ("z", 0.2)]), "topic": goal([("p", 0.6), ("q", 0.4)])}
    aimed, _ = mixing.aims(cells, targets)
    fitted = mixing.rake(aimed, 20, Scratch(spark, "test-mixing")).toPandas()
    total = fitted.tokens.sum()
    assert fitted.weight.sum() == pytest.approx(total)
    assert (fitted.groupby("source").weight.sum() / total).to_dict() == pytest.approx({"a": 0.3, "b": 0.7})
    assert (fitted.groupby("lang").weight.sum() / total).to_dict() == pytest.approx({"x": 0.5, "y": 0.3, "z": 0.2})
    assert (fitted.groupby("topic").weight.sum() / total).to_dict() == pytest.approx({"p": 0.6, "q": 0.4})


def _sourced(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")


def _expected(frame, name):
    """Expected share of kept tokens by value, an empty text weighing one."""
    pdf = frame.toPandas()
    kept = (pdf.n_tokens.clip(lower=1) * pdf.probability).groupby(pdf[name]).sum()
    return (kept / kept.sum()).to_dict(), kept.sum() / pdf.n_tokens.clip(lower=1).sum()


def test_kept_tokens_meet_targets(spark):
    frame = mixing.mixture(table(spark, MIDDLE, "documents")).cache()
    pdf = frame.toPandas()
    for name in mixing.DIMENSIONS:
        held = pdf.n_tokens.clip(lower=1).groupby(pdf[name]).sum() ** mixing.POWERS[name]
        assert _expected(frame, name)[0] == pytest.approx((held / held.sum()).to_dict(), rel=1e-3)
    assert pdf.probability.between(0, 1).all()


def test_one_large_and_one_small_source(spark):
    rows = [(i, "w " * 99 + "w", "large" if i % 10 else "small", "en") for i in range(400)]
    frame = mixing.mixture(_sourced(spark, rows))
    shares, kept = _expected(frame, "source")
    assert shares == pytest.approx({"large": 0.75, "small": 0.25}, rel=1e-3)
    # All of the small source, and three times as much of the large one.
    assert kept == pytest.approx(0.4, rel=1e-3)


def test_full_cells_leave_the_rest_to_others(spark):
    """A cell that is short of tokens is taken whole, and the others of its values make up for it."""
    rows, number = [], 0
    for source, lang, n in (("a", "x", 10), ("a", "y", 60), ("b", "x", 60), ("b", "y", 60)):
        for _ in range(n):
            rows.append((number, "w " * 9 + "w", source, lang))
            number += 1
    goal = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    targets = {"source": goal([("a", 0.5), ("b", 0.5)]), "lang": goal([("x", 0.5), ("y", 0.5)])}
    frame = mixing.mixture(_sourced(spark, rows), targets, budget=0.6)
    for name, wanted in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"x": 0.5, "y": 0.5})):
        assert _expected(frame, name)[0] == pytest.approx(wanted, rel=1e-3)
    chances = {(r.source, r.lang): r.probability for r in frame.collect()}
    assert chances["a", "x"] == 1.0 and max(chances.values()) <= 1.0


def test_values_without_target_and_contradictions(spark):
    rows = [(i, "w w", "ab"[i % 2], "xy"[i % 2]) for i in range(20)] + [(99, "w w", "c", "x")]
    goal = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    targets = {"source": goal([("a", 0.2), ("b", 0.8), ("absent", 3.0)]), "lang": goal([("x", 0.6), ("y", 0.4)])}
    with pytest.warns(UserWarning, match="marginals"):
        found = mixing.mixture(_sourced(spark, rows), targets, rounds=3).collect()
    assert len(found) == 21 and all(0 <= r.probability <= 1 for r in found)
    assert [r.kept for r in found if r.source == "c"] == [False]


def test_kept_share_follows_probability(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    row = mixing.mixture(docs).agg(F.avg("probability").alias("p"), F.avg(F.col("kept").cast("int")).alias("k")).first()
    assert row.k == pytest.approx(row.p, abs=0.02)


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    as_is = dict.fromkeys(mixing.DIMENSIONS, 1.0)
    found = mixing.mixture(docs, budget=1.0, powers=as_is).collect()
    assert len(found) == len(odd_rows()) and all(r.kept for r in found)
    assert {r.lang for r in found} == {"en", "(none)"}
    sample = mixing.mixed(docs, budget=1.0, powers=as_is)
    assert sample.columns == docs.columns and sample.count() == len(odd_rows())
    assert mixing.mixture(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [])).collect() == []


def test_native(spark):
    plan = mixing.mixture(table(spark, MIDDLE, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
