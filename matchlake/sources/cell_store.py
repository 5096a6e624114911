"""A stored table of versioned cells that takes puts without being rewritten.

Cells lie in hash buckets of the entity within a folder for each qualifier. A put appends a
batch that holds its own cells only, and a log entry names the buckets it touched; a batch
counts once its entry is complete, so one that was broken off is never read. Reading merges a
bucket's batches, the latest put at an (entity, qualifier, ts) winning. Compaction rewrites the
buckets with several batches, and those only, as one base batch each; older batches of
these buckets are then out of use until ``vacuum`` deletes them.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CELLS
from .cells import KEY

_LOG = "batch BIGINT, write STRING, qualifier STRING, bucket INT, base BOOLEAN"
_PARTS = ("qualifier", "bucket")


@dataclass(frozen=True)
class Folder:
    """A batch's cells of one bucket."""

    write: str
    qualifier: str
    bucket: int


class CellStore:
    """Cells (entity, qualifier, ts, value) under ``path``, a folder that all executors share.

    ``buckets`` is fixed when the store is first written. One writer at a time succeeds: a second
    one that started from the same state fails on its log entry and has changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- log ---------------------------------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _batches(self) -> list[int]:
        """Complete batches, oldest first."""
        files, folder = self._hadoop(f"{self.path}/log")
        if not files.exists(folder):
            return []
        found = (s.getPath() for s in files.listStatus(folder) if s.isDirectory())
        done = (p for p in found if files.exists(self._hadoop(f"{p}/_SUCCESS")[1]))
        return sorted(int(p.getName()) for p in done)

    def _entries(self) -> list:
        batches = self._batches()
        if not batches:
            return []
        log = self.spark.read.schema(_LOG).json([f"{self.path}/log/{b:012d}" for b in batches])
        # As many rows as buckets and batches since the last compaction and vacuum.
        return log.orderBy("batch").collect()

    def live(self) -> dict[tuple[str, int], list[Folder]]:
        """Folders in use by qualifier and bucket: the last base and the batches after it."""
        found: dict[tuple[str, int], list[Folder]] = {}
        for row in self._entries():
            key = row.qualifier, row.bucket
            folder = Folder(row.write, *key)
            found[key] = [folder] if row.base else [*found.get(key, []), folder]
        return found

    def _commit(self, batch: int, cells: DataFrame, touched: DataFrame | None, base: bool) -> None:
        """Write the cells, then the entry that makes them count."""
        # Writes sort by their batch; competing ones of the same batch do not share a folder.
        write = f"{batch:012d}-{uuid.uuid4().hex}"
        cells.write.mode("errorifexists").partitionBy(*_PARTS).parquet(self._folder(write))
        touched = self._written(write) if touched is None else touched
        entry = touched.select(F.lit(batch).cast("bigint").alias("batch"), F.lit(write).alias("write"), *_PARTS, F.lit(base).alias("base"))
        entry.coalesce(1).write.mode("errorifexists").json(f"{self.path}/log/{batch:012d}")

    def _folder(self, write: str) -> str:
        return f"{self.path}/cells/write={write}"

    def _written(self, write: str) -> DataFrame:
        """Qualifiers and buckets of a write, from its folders."""
        schema = "entity BIGINT, ts BIGINT, value DOUBLE, qualifier STRING, bucket INT"
        return self.spark.read.schema(schema).parquet(self._folder(write)).select(*_PARTS).distinct()

    def _next(self) -> int:
        return max(self._batches(), default=-1) + 1

    # --- writing -----------------------------------------------------------------------

    def put(self, cells: DataFrame) -> int:
        """Append a batch of puts and return its number.

        Of several puts at one (entity, qualifier, ts) the largest value stays. A put of null
        deletes the cell; beside a value at the same key it counts for nothing. An
        empty table of puts is a batch without cells; a cell without a qualifier is an error.
        """
        bucket = F.pmod(F.xxhash64("entity"), F.lit(self.buckets)).cast("int")
        named = F.when(F.coalesce("qualifier", F.lit("")) == "", F.raise_error(F.lit("a cell needs a qualifier"))).otherwise(F.col("qualifier"))
        puts = cells.select("entity", named.alias("qualifier"), "ts", "value").groupBy(*KEY).agg(F.max("value").alias("value"))
        batch = self._next()
        # Rebalanced by folder: few files for each, and a bucket with very many puts is split.
        laid_out = puts.withColumn("bucket", bucket).hint("rebalance", *_PARTS)
        self._commit(batch, laid_out, None, base=False)
        return batch

    def compact(self, most_batches: int = 1) -> list[tuple[str, int]]:
        """Rewrite the buckets with more than ``most_batches`` batches as one; these are returned."""
        crowded = {k: f for k, f in self.live().items() if len(f) > most_batches}
        if crowded:
            batch = self._next()
            merged = self._merged([f for folders in crowded.values() for f in folders])
            # A bucket whose cells were all deleted has an entry too.
            touched = self.spark.createDataFrame(list(crowded), "qualifier STRING, bucket INT")
            self._commit(batch, merged.hint("rebalance", *_PARTS), touched, base=True)
        return sorted(crowded)

    def vacuum(self) -> int:
        """Delete the folders that no read uses any more, and return how many."""
        used = {f for folders in self.live().values() for f in folders}
        known = {Folder(r.write, r.qualifier, r.bucket) for r in self._entries()}
        count = 0
        for folder in known - used:
            files, target = self._hadoop(self._place(folder))
            count += bool(files.exists(target) and files.delete(target, True))
        return count

    # --- reading -----------------------------------------------------------------------

    def _place(self, folder: Folder) -> str:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return f"{self._folder(folder.write)}/{name('qualifier', folder.qualifier)}/bucket={folder.bucket}"

    def _scan(self, folders: list[Folder]) -> DataFrame:
        """Cells of these folders with their ``write``, ``qualifier`` and ``bucket``."""
        schema = "entity BIGINT, ts BIGINT, value DOUBLE, write STRING, qualifier STRING, bucket INT"
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/cells")
        places = [p for p in map(self._place, folders) if self._hadoop(p)[0].exists(self._hadoop(p)[1])]
        return reader.parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _merged(self, folders: list[Folder]) -> DataFrame:
        """The latest put of each key, without deleted cells; combined before the shuffle."""
        last = F.max_by("value", "write").alias("value")
        return self._scan(folders).groupBy(*_PARTS, "entity", "ts").agg(last).where(F.col("value").isNotNull())

    def read(self, pattern: str | None = None) -> DataFrame:
        """All cells, or those whose whole qualifier matches a regular expression; only its folders are read.

        Buckets of one batch are read as they are; others are merged.
        """
        wanted = [f for (q, _), f in self.live().items() if pattern is None or re.fullmatch(pattern, q)]
        single = [f for folders in wanted if len(folders) == 1 for f in folders]
        several = [f for folders in wanted if len(folders) > 1 for f in folders]
        parts = [self._scan(single).where(F.col("value").isNotNull())] if single else []
        parts += [self._merged(several)] if several else []
        if not parts:
            return self.spark.createDataFrame([], CELLS)
        whole = [p.select(*KEY, "value") for p in parts]
        return whole[0] if len(whole) == 1 else whole[0].unionByName(whole[1])
