"""Exact top-k search by block-at-a-time pruning.

Vectors are stored in blocks: ranges of ids with a forward index of their components and
the largest and smallest value of every component (term). The sum of a query's products
with these extremes bounds its score in a block. Each query visits blocks in falling
order of their bounds and stops when they fall below its k-th score. A first pass finds
each query's best block, so that tasks start from a good k-th score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a block, and queries that one pass sends to the tasks.
BLOCK, QUERIES = 256, 2048
#: Products add up exactly as floats below this.
_EXACT = float(2**53)


def _quantised(embeddings: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, values) of the vectors that can be scored, components as whole numbers."""
    vector = F.col("`embedding`").cast("array<double>")
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x * scale).cast("bigint"))
    rows = embeddings.where(F.col("`vec_id`").isNotNull() & vector.isNotNull() & usable & (F.size(vector) > 0))
    return rows.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("values"))


_BLOCKS = "dim int, first bigint, ids array<bigint>, values array<bigint>, low array<bigint>, high array<bigint>"


def _blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors in id order; ranges come from sorting ids across tasks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(2).flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(dims)))
            rows = []
            for dim in np.unique(dims):
                chosen = np.flatnonzero(dims == dim)
                for k in range(0, len(chosen), BLOCK):
                    part = chosen[k : k + BLOCK]
                    matrix = np.stack([flat[starts[r] : starts[r + 1]] for r in part])
                    rows.append((int(dim), int(ids[part[0]]), ids[part], matrix.ravel(), matrix.min(axis=0), matrix.max(axis=0)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "first", "ids", "values", "low", "high"]
            )

    return vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, _BLOCKS)


class QueryBlock:
    """Queries of one dimension, with their k best candidates so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.filled = np.zeros(len(ids), np.int64)
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)

    def product(self, queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Inner products of some queries with rows of a matrix, exact."""
        left = self.values[queries]
        size = float(np.abs(left).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * matrix.shape[1]
        if size < _EXACT:
            return (left.astype(float) @ matrix.T.astype(float)).astype(np.int64)
        return left @ matrix.T

    def bounds(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest possible score of every query in every block."""
        positive, negative = np.maximum(self.values, 0), np.minimum(self.values, 0)
        size = float(np.abs(self.values).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * low.shape[1]
        if size < _EXACT:
            return (positive.astype(float) @ high.T.astype(float) + negative.astype(float) @ low.T.astype(float)).astype(np.int64)
        return positive @ high.T + negative @ low.T

    def least(self) -> np.ndarray:
        """The score that a candidate must reach to matter."""
        own = np.where(self.filled >= self.k, self.scores[:, -1], np.iinfo(np.int64).min)
        return np.maximum(own, self.floor)

    def visit(self, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Score a block for some queries; ties go to smaller ids."""
        scores = self.product(queries, matrix)
        for q, row in zip(queries, scores, strict=True):
            keep = np.flatnonzero((row >= max(self.floor[q], self.scores[q, -1])) & (ids != self.ids[q]))
            if not len(keep):
                continue
            n = self.filled[q]
            all_scores = np.concatenate((self.scores[q, :n], row[keep]))
            all_ids = np.concatenate((self.found[q, :n], ids[keep]))
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.scores[q, : len(order)], self.found[q, : len(order)] = all_scores[order], all_ids[order]
            self.filled[q] = len(order)


_CANDIDATES = "query_id bigint, vec_id bigint, score bigint"


def _search(blocks: DataFrame, ids: np.ndarray, values: np.ndarray, floor: np.ndarray | None, k: int) -> DataFrame:
    """Each task's best candidates by query. Without a floor only each query's best block counts."""
    sent = blocks.sparkSession.sparkContext.broadcast((ids, values, floor))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, floor = sent.value
        queries = QueryBlock(ids, values, k)
        if floor is not None:
            queries.floor = floor
        for batch in batches:
            names = batch.schema.names
            get = lambda name: batch.column(names.index(name))  # noqa: B023, E731
            if not batch.num_rows:
                continue
            dim = values.shape[1]
            low = get("low").flatten().to_numpy().reshape(-1, dim)
            high = get("high").flatten().to_numpy().reshape(-1, dim)
            block_ids = [np.asarray(x.values) for x in get("ids")]
            matrices = [np.asarray(x.values).reshape(-1, dim) for x in get("values")]
            bounds = queries.bounds(low, high)
            order = np.argsort(-bounds, axis=1, kind="stable")
            rounds = 1 if floor is None else len(matrices)
            waiting = np.arange(len(ids))
            for turn in range(rounds):
                # All queries whose next block may still matter visit it, grouped by block.
                block = order[waiting, turn]
                alive = bounds[waiting, block] >= queries.least()[waiting]
                waiting, block = waiting[alive], block[alive]
                if not len(waiting):
                    break
                for b in np.unique(block):
                    queries.visit(waiting[block == b], block_ids[b], matrices[b])
        rows = np.repeat(np.arange(len(ids)), queries.filled)
        columns = np.arange(len(rows)) - np.repeat(np.cumsum(queries.filled) - queries.filled, queries.filled)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.ids[rows]), pa.array(queries.found[rows, columns]), pa.array(queries.scores[rows, columns])],
            ["query_id", "vec_id", "score"],
        )

    return blocks.mapInArrow(run, _CANDIDATES)


def _query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, values) of bounded blocks; rows come one partition at a time."""
    held: dict[int, list[tuple[int, list[int]]]] = {}
    for row in queries.toLocalIterator():
        part = held.setdefault(row[1], [])
        part.append((row[0], row[2]))
        if len(part) >= most:
            yield row[1], np.array([r[0] for r in part]), np.array([r[1] for r in part], np.int64)
            part.clear()
    for dim, part in held.items():
        if part:
            yield dim, np.array([r[0] for r in part]), np.array([r[1] for r in part], np.int64)


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components become floor(``scale`` * x); the score is the whole-number inner product.
    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows of another
    id; equal scores go to the smaller id. Vectors that are null, empty or hold a null or
    a number that is not finite take no part, nor do rows without an id; vectors are
    compared with those of their length. Of repeated ids each row is a candidate, and a
    query with several vectors has its ``k`` best over all of them. Other columns are not read.
    """
    scratch = Scratch(embeddings.sparkSession, "topk")
    vectors = _quantised(embeddings, scale)
    blocks = scratch.write(_blocks(vectors), "blocks")
    found: DataFrame | None = None
    queries = vectors.where(F.col("vec_id") % every == 0)
    for number, (dim, ids, values) in enumerate(_query_blocks(queries, QUERIES)):
        mine = blocks.where(F.col("dim") == dim)
        seeds = _search(mine, ids, values, None, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        # The k-th best score of any k candidates is a floor for the true one.
        kth = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        floors = {r[0]: r[1] for r in kth.where(F.size("scores") >= k).select("query_id", F.col("scores")[k - 1]).collect()}
        floor = np.array([floors.get(int(i), np.iinfo(np.int64).min) for i in ids], np.int64)
        if len(np.unique(ids)) < len(ids):
            floor[:] = np.iinfo(np.int64).min
        part = scratch.write(_search(mine, ids, values, floor, k), f"candidates-{number}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # Each task gave at most k candidates a query, so a query's list is short.
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score").alias("s"), (-F.col("vec_id")).alias("v"))), asc=False), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best"))
    rows = ranked.select("query_id", F.posexplode("best").alias("place", "b"))
    return rows.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), (-F.col("b.v")).alias("vec_id"), F.col("b.s").alias("score")
    )


#: The same rows as SQL, for k = 5, every 50th id and scale 256.
SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
