"""Small corpora and brute-force helpers for the corpus operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
CLASHING = "id bigint, key string, label string, score double, n bigint, token string, spans string, row string, size int, hub int"
DOCUMENTS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
EXTRA = (1, "k", "l", 0.5, 2, "t", "s", "r", 3, 4)

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents of these ids and texts, with columns whose names operators use inside."""
    full = [(i, t, "en" if t else None, "src", None if t is None else len(t), *EXTRA) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, a null id, ties, repeated rows, white space, a very long text."""
    words = random.Random(4)
    long = " ".join(words.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(words.randrange(300)) for _ in range(40_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "same text here for ties and copies"),
        (7, "same text here for ties and copies"), (7, "same text here for ties and copies"), (None, "no id at all here"),
        (None, None), (8, long), (9, long), (10, "ünïcode Straße İstanbul ÄÖ"), (11, "x" * 200_000), (12, "a\u0085b c d e"),
    ]
