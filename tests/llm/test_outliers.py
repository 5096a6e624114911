"""Robust outliers against SQL and brute force, contaminated groups, and odd tables."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from corpus import MIDDLE, SPACED, documents, odd_rows, table
from pyspark.sql import functions as F

from matchlake.llm import outliers
from matchlake.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparison import connect, normal, rows_of_sql  # noqa: E402


def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by plain loops."""
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_equals_sql(spark):
    frame = outliers.outliers(table(spark, MIDDLE, "documents")).drop("distance")
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == normal(*rows_of_sql(connect(MIDDLE), outliers.sql()))


def test_counts_by_brute_force(spark):
    rows = odd_rows() + [(20, "a b c a b c a"), (21, "x\n\nx\n \nx \ny#|\n"), (22, "\na\x0bb\x0cc\r\nd e\n"), (23, "é ✓✓ 😀 é ✓✓ 😀")]
    rows += [(r.doc_id, r.text) for r in table(spark, MIDDLE, "documents").limit(300).collect()]
    found = outliers.described(documents(spark, rows), F.col("doc_id")).collect()
    expected = Counter((i, *counted(t)) for i, t in rows)
    assert Counter((r.doc_id, *(r[c] for c in outliers.COUNTS), r.base_failed) for r in found) == expected


def test_estimate_ignores_the_outlying_part(spark):
    rng = np.random.default_rng(5)
    sound = rng.normal([200, 10, 5, 30], [8, 9, 24, 26], (6000, 4))
    sound[:, 3] += 0.5 * (sound[:, 2] - 5)
    bad = rng.normal([300, 90, 120, 150], [3, 3, 3, 3], (4000, 4))
    whole = np.rint(np.vstack([sound, bad])).astype(int).tolist()
    columns = "pool string, " + ", ".join(f"{d} bigint" for d in outliers.DIMENSIONS) + ", n bigint"
    frame = spark.createDataFrame([("p", *v, 1) for v in whole] + [("q", 1, 2, 3, 4, 3)], columns)
    model = outliers.estimates(frame, Scratch(spark, "test-outliers")).collect()
    assert [m.pool for m in model] == ["p"]  # the pool of three rows is too small
    mean = [model[0][f"m_{d}"] for d in outliers.DIMENSIONS]
    assert mean == pytest.approx([200, 10, 5, 30], abs=2.5)
    lower = np.zeros((4, 4))
    for a, b in outliers.PAIRS:
        lower[outliers.DIMENSIONS.index(a), outliers.DIMENSIONS.index(b)] = model[0][f"l_{a}_{b}"]
    expected = np.cov(sound.T) + np.diag([(outliers.FLOOR[d] * outliers.GRID) ** 2 for d in outliers.DIMENSIONS])
    assert lower @ lower.T == pytest.approx(expected, rel=0.25, abs=60)


def test_rejects_junk_keeps_clean(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    judged = outliers.outliers(docs).where("NOT base_failed").join(labels, "doc_id")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.995 and kept[0] < 0.1


def prose(seed, n=80):
    words = random.Random(seed)
    return " ".join("".join(words.choice("abcdefghij") for _ in range(words.randrange(2, 9))) for _ in range(n))


def test_pools(spark):
    """Small sources share a pool of their language; with too few rows there is no verdict."""
    junk = "a|b|c " * 3 + " ".join(f"w{i}|#$%|" for i in range(90))
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(240)] + [(900, junk, "en", "s1"), (901, junk, None, None), (902, prose(1), None, "s9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in outliers.outliers(docs).collect()}
    assert not found[900].kept and found[900].distance > outliers.CUTOFF
    assert found[901].kept and found[901].distance is None and found[902].kept
    assert all(found[i].kept for i in range(240))
    assert {r.doc_id for r in outliers.inliers(docs).collect()} == set(found) - {900}


def test_odd_tables(spark):
    docs = documents(spark, odd_rows())
    found = outliers.outliers(docs).collect()
    assert len(found) == len(odd_rows()) and not any(r.kept and r.base_failed for r in found)
    empty = outliers.inliers(documents(spark, []))
    assert empty.columns == docs.columns and empty.collect() == []


def test_native(spark):
    plan = outliers.outliers(table(spark, MIDDLE, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
