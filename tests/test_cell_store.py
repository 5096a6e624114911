"""The stored table of cells against the in-memory upsert, and what a put touches."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchlake.schemas import CELLS
from matchlake.sources.cell_store import CellStore


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def table(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_small_put_touches_its_buckets_only(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "cells"), buckets=16)
    rows = [(e, q, t, float(e + t)) for e in range(400) for q in ("real_match", "games=1/x") for t in (1, 2)]
    store.put(frame(spark, rows))
    first = files(tmp_path)
    store.put(frame(spark, [(7, "real_match", 1, -1.0), (7, "real_match", 9, 3.0)]))
    after = files(tmp_path)
    assert {p: t for p, t in after.items() if p in first} == first  # nothing is rewritten
    assert len(after) - len(first) == 1
    expected = {r[:3]: r[3] for r in rows} | {(7, "real_match", 1): -1.0, (7, "real_match", 9): 3.0}
    assert table(store.read()) == sorted((*k, v) for k, v in expected.items())

    assert len(store.compact()) == 1 and store.compact() == []
    compacted = files(tmp_path)
    assert len(compacted) - len(after) == 1
    assert table(store.read()) == sorted((*k, v) for k, v in expected.items())
    assert store.vacuum() == 2 and len(files(tmp_path)) == len(first)
    assert table(store.read()) == sorted((*k, v) for k, v in expected.items())
    assert store.vacuum() == 0


def test_many_puts_against_a_dictionary(spark, tmp_path):
    rng, store, expected = random.Random(6), CellStore(spark, str(tmp_path / "cells"), buckets=3), {}
    for step in range(6):
        puts = [(rng.randrange(9), rng.choice("ab"), rng.randrange(3), rng.choice([None, 1.0, 2.0, 5.0])) for _ in range(25)]
        latest = {}
        for *key, value in puts:
            held = latest.get(tuple(key))
            latest[tuple(key)] = max((v for v in (held, value) if v is not None), default=None)
        expected |= latest
        store.put(frame(spark, puts))
        if step == 3:
            store.compact()
            store.vacuum()
    assert table(store.read()) == sorted((*k, v) for k, v in expected.items() if v is not None)
    assert table(store.read("a|none")) == sorted((*k, v) for k, v in expected.items() if v is not None and k[1] == "a")


def test_a_pattern_reads_its_folders_only(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "cells"), buckets=2)
    store.put(frame(spark, [(e, q, 1, 1.0) for e in range(20) for q in ("wins", "games")]))
    assert all("qualifier=wins" in f for f in store.read("wi.*").inputFiles())
    with pytest.raises(Exception, match="needs a qualifier"):
        store.put(frame(spark, [(1, "", 1, 1.0)]))


def test_broken_and_competing_writers(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "cells"))
    store.put(frame(spark, [(1, "q", 1, 1.0)]))
    broken = frame(spark, [(1, "q", 1, 9.0)]).withColumn("bucket", F.lit(0))
    broken.write.partitionBy("qualifier", "bucket").parquet(f"{tmp_path}/cells/cells/write=000000000001-x")  # no log entry followed
    assert table(store.read()) == [(1, "q", 1, 1.0)]
    other = CellStore(spark, str(tmp_path / "cells"))
    other._next = lambda: 1  # it looked at the log before the next put
    store.put(frame(spark, [(2, "q", 1, 2.0)]))
    with pytest.raises(Exception, match="exist"):
        other.put(frame(spark, [(2, "q", 1, 3.0)]))
    assert table(store.read()) == [(1, "q", 1, 1.0), (2, "q", 1, 2.0)]


def test_empty_tables(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "cells"))
    assert store.read().collect() == [] and store.compact() == [] and store.vacuum() == 0
    store.put(frame(spark, []))
    assert store.read().collect() == []
    store.put(frame(spark, [(1, "q", 1, 2.0)]))
    store.put(frame(spark, [(1, "q", 1, None)]))
    assert store.read().collect() == []
    store.compact()
    assert store.read().collect() == [] and store.read("q").columns == ["entity", "qualifier", "ts", "value"]
