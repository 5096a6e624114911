"""Words of texts, hashing of words, and tables written in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that stay in an alphanumeric word: digits, letters (lower-cased), all of non-ASCII.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words of digits, ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(wide).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, which bound what a task holds as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Words(NamedTuple):
    """Words of several texts in order: the distinct ones, the number of each one's there, and how many a text has."""

    distinct: pa.Array
    numbers: np.ndarray
    sizes: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """As ``space_words`` of each text of a string column; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at either end leaves empty words.
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~empty.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(pc.invert(empty))
    coded = words.dictionary_encode()
    return Words(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), sizes)


def text_pieces(batches: Iterable[pa.RecordBatch], name: str, rows: int = 1000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows and, unless a text is larger, bytes of texts."""
    for batch in pieces(batches, rows):
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_numpy()
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for each run of ``length`` words, by the words' hashes."""
    count = len(words) - length + 1
    base = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(max(count, 0), np.uint64)
    for k in range(length):
        total = total * base + words[k : k + max(count, 0)]
    return mixed(total)


def held_out(modulus: int) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def thinned(key: str, share: float) -> Column:
    """About this share of the rows by a hash of ``key``, in steps of 10^-12, so that large tables keep some."""
    million = 1_000_000
    part = lambda *of: F.pmod(F.xxhash64(*of), F.lit(million))
    return part(key) + part(key, F.lit(1)) / million < F.lit(share * million)


#: Shuffle files are deleted as soon as what they served is written, and not when the driver collects garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Scratch:
    """Parquet tables of one run in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``; where it is unset, the warehouse. Written
    tables survive lost executors and cut the lineage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and read it again."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Delete a table that no later step reads."""
        jvm, path = self.spark._jvm, self.path(table)
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
