"""Exact search against SQL and all pairs."""

import math
import sys
from pathlib import Path

import numpy as np
from corpus import MIDDLE, table

from matchlake.llm import topk

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparison import connect, normal, rows_of_sql  # noqa: E402


def brute(rows, k, every):
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for i, q in usable:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            found += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(found)


def test_equals_sql(spark):
    frame = topk.nearest(table(spark, MIDDLE, "embeddings"))
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == normal(*rows_of_sql(connect(MIDDLE), topk.SQL))


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.choice([-0.5, 0.25, 0.75], 6)]) for k in range(120)]
    rows += [(200, None), (202, []), (204, [1.0, None]), (206, [float("nan")] * 6), (208, [float("inf")] + [0.0] * 5)]
    rows += [(None, [1.0] * 6), (210, [1.0, 2.0]), (215, [3.0, 1.0]), (300, [1e12] * 3), (301, [-2e12] * 3)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, score string")
    small = [r for r in rows if not (r[1] and len(r[1]) == 3)]
    found = sorted(tuple(r) for r in topk.nearest(frame.where("vec_id IS NULL OR vec_id < 300"), every=5).collect())
    assert found == brute(small, 5, 5)


def test_empty_and_alone(spark):
    kinds = "vec_id bigint, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], kinds)).collect() == []
    assert topk.nearest(spark.createDataFrame([(50, [1.0])], kinds)).collect() == []
    pair = topk.nearest(spark.createDataFrame([(50, [1.0]), (7, [-1.0])], kinds)).collect()
    assert [tuple(r) for r in pair] == [(50, 1, 7, -65536)]
