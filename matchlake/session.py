"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; sizes (memory, cores, shuffle partitions) belong to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Settings for sessions made here; they cannot be changed later. Plans have many
# expressions, and recording the call site of each takes longer than planning.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A local master with none set uses its warehouse; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through reliable storage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class BucketedTables:
    """Tables of one run in the shared folder, all bucketed and sorted by the same columns.

    Joins and aggregates on those columns read them without a shuffle. There are as many
    buckets as the session has shuffle partitions. Leaving the context deletes the tables.
    """

    def __init__(self, spark: SparkSession, *columns: str):
        self.spark = spark
        self.columns = columns
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"bucketed_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.prefix}"
        self.names: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df``, which should be laid out by the columns, and read it again."""
        name = f"{self.prefix}_{len(self.names)}"
        self.names.append(name)
        (
            df.write.option("path", f"{self.folder}/{name}")
            .bucketBy(self.buckets, *self.columns)
            .sortBy(*self.columns)
            .saveAsTable(name)
        )
        return self.spark.table(name)

    def __enter__(self) -> BucketedTables:
        return self

    def __exit__(self, *failure: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
