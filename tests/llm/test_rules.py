"""Quality rules: held-out accuracy, rules as columns, odd tables."""

import zlib

import numpy as np
import pytest
from corpus import MIDDLE, documents, odd_rows, table
from pyspark.sql import functions as F

from matchlake.llm import rules

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    found = rules.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 500
    assert (found.predicted == found.quality).mean() > 0.97
    assert (found.predicted[found.quality == 0] == 0).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_held_out_rows_and_inputs(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    found = {r.doc_id: r for r in rules.quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    # Labels of held-out rows, languages and sources change nothing.
    wrong = labels.withColumn("quality", F.when(rules.held_out(4), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r.doc_id: r for r in rules.quality(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), wrong).collect()}
    assert found == other


def test_column_equals_table(spark):
    rng = np.random.default_rng(0)
    values = {n: rng.random(300) for n in rules.NAMES}
    labels = ((values["upper"] > 0.5) & (values["stops"] < 0.7)).astype(float)
    model = rules.fit(values, labels)
    assert 0 < len(model.weights) < 200
    frame = spark.createDataFrame(list(zip(*[values[n].tolist() for n in rules.NAMES], strict=True)), list(rules.NAMES))
    scores = np.array([r[0] for r in frame.select(model.column()).collect()])
    total = model.bias + sum(w * np.logical_and.reduce([b.holds(values) for b in rule]) for rule, w in model.weights.items())
    assert scores == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((scores > 0.5) == labels).mean() > 0.95


def test_odd_tables(spark):
    docs = documents(spark, odd_rows())
    some = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, None), (5, 1, 0), (None, 0, 0), (6, None, 0), (8, 0, 1), (99, 1, 1)], LABELS)
    found = rules.quality(docs, some).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    none = rules.quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert rules.quality(documents(spark, []), some).collect() == []
    kept = rules.accepted(docs, spark.createDataFrame([(k, 1, 0) for k in (1, 3, 4, 5, 6, 7, 8)], LABELS))
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
