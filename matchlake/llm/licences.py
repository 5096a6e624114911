"""Licence scans by diagonal voting.

Every run of ``GRAM`` words of a document is hashed and joined to the places of the same run
in licence templates. A match votes for a diagonal, the document's place less the template's.
Votes are added by diagonal, neighbouring diagonals are merged (a word put in or left
out shifts the rest). The words of a merged span are aligned with the template's, and it
stands if they hold enough of it and no word between them names another licence.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, pieces, shingle_hashes, texts_of

GRAM = 3
#: Diagonals this close belong to one span.
NEIGHBOURS = 3
#: A span holds this share of its template's runs, or this many of them.
LEAST_SHARE, LEAST_RUNS = 0.6, 12

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words that make another licence of a notice, and pairs of words that are one of them.
VARIANTS = frozenset(b"noncommercial sharealike noderivatives noderivs nc sa nd".split())
VARIANT_PAIRS = {
    (b"non", b"commercial"): b"noncommercial", (b"share", b"alike"): b"sharealike",
    (b"no", b"derivatives"): b"noderivatives", (b"no", b"derivs"): b"noderivs",
}

#: Notices as their licences word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
     "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_runs(spark: SparkSession) -> DataFrame:
    """(run, template, label, place, runs): places of word runs in the templates."""
    rows, hashes = [], WordHashes()
    for number, (label, text) in enumerate(TEMPLATES):
        runs = shingle_hashes(hashes.of(alnum_words(text.encode())), GRAM).view(np.int64)
        rows += [(int(run), number, label, place, len(runs)) for place, run in enumerate(runs)]
    return spark.createDataFrame(rows, "run bigint, template int, label string, place int, runs int")


def _joined(words: list[bytes]) -> list[bytes]:
    """The words with pairs that are one word made one; the second place becomes empty."""
    words = list(words)
    for k in range(len(words) - 1):
        if one := VARIANT_PAIRS.get((words[k], words[k + 1])):
            words[k : k + 2] = one, b""
    return words


def verified(words: list[bytes], template: list[bytes]) -> tuple[int, int, int] | None:
    """(first word, last word, runs held) of the template in these words, if they quote it.

    Words and template are aligned, so a place counts once. Neither may have a word of its own
    that makes another licence: the template anywhere, the text between its outer runs.
    """
    blocks = [b for b in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
    held = [b for b in blocks if b.size >= GRAM]
    if not held:
        return None
    # Single words around the runs may be any text's.
    blocks = [b for b in blocks if held[0].a <= b.a <= held[-1].a]
    for one, other in zip(blocks, blocks[1:], strict=False):
        if not VARIANTS.isdisjoint(words[one.a + one.size : other.a]):
            return None
    aligned = {k for b in blocks for k in range(b.b, b.b + b.size)}
    if any(word in VARIANTS for k, word in enumerate(template) if k not in aligned):
        return None
    return held[0].a, held[-1].a + held[-1].size - 1, sum(b.size - GRAM + 1 for b in held)


def _row_key(doc_id: int | None, text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}:".encode() + (text or b""))


def _quoting(docs: DataFrame) -> DataFrame:
    """(row_key, text): rows that hold a run of a template."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known = np.concatenate([shingle_hashes(hashes.of(alnum_words(t.encode())), GRAM) for _, t in TEMPLATES])
        for batch in pieces(batches):
            rows = [
                (_row_key(doc_id, text), text)
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True)
                if text and np.isin(shingle_hashes(hashes.of(alnum_words(text)), GRAM), known).any()
            ]
            columns = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["row_key", "text"])

    return docs.mapInArrow(run, "row_key binary, text binary")


def _runs(docs: DataFrame) -> DataFrame:
    """(row_key, runs): hashes of all runs of each row that has any."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            keys, runs = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                words = alnum_words(text or b"")
                if len(words) >= GRAM:
                    keys.append(_row_key(doc_id, text))
                    runs.append(shingle_hashes(hashes.of(words), GRAM).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(runs, pa.list_(pa.int64()))], ["row_key", "runs"])

    return docs.mapInArrow(run, "row_key binary, runs array<bigint>")


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        for at in (k for k, word in enumerate(words) if word == parts[0]):
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return found


def _base(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "n_words", "n_base", "first_word", "last_word", "base_labels"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                words = alnum_words(text or b"")
                places = phrase_places(words) if b"license" in words else []
                starts = [p for p, _ in places]
                labels = sorted({label for _, label in places})
                rows.append((doc_id, _row_key(doc_id, text), len(words), len(places), min(starts, default=None), max(starts, default=None), labels))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(
        run,
        "doc_id bigint, row_key binary, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>",
    )


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))


def licence_spans(documents: DataFrame) -> DataFrame:
    """Verified spans, once for equal rows: ``row_key``, ``label``, ``template``, ``first_word``, ``last_word``, ``share``."""
    docs = _documents(documents)
    runs = _runs(docs).select("row_key", F.posexplode("runs").alias("at", "run"))
    votes = (
        # The templates are the fixed list above, a few hundred runs.
        runs.join(F.broadcast(template_runs(docs.sparkSession)), "run")
        .withColumn("diagonal", F.col("at") - F.col("place"))
        # Equal rows have equal votes: a place votes once.
        .groupBy("row_key", "template", "label", "runs", "diagonal")
        .agg(F.count_distinct("at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    line = Window.partitionBy("row_key", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEIGHBOURS, 0).otherwise(1)
    spans = (
        votes.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(line))
        .groupBy("row_key", "template", "label", "runs", "span")
        .agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_list(F.struct("diagonal", "votes", "first", "last"))).alias("lines"))
    )
    # Summed votes are at least the places that a span holds.
    hopeful = spans.where((F.col("votes") >= LEAST_SHARE * F.col("runs")) | (F.col("votes") >= LEAST_RUNS))
    chains = hopeful.groupBy("row_key").agg(F.collect_list(F.struct("template", "lines")).alias("chains"))
    return _quoting(docs).join(chains, "row_key").mapInArrow(_verify, _SPANS).distinct()


_SPANS = "row_key binary, label string, template int, first_word bigint, last_word bigint, share double"


def _regions(lines: list[dict], runs: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the words of a chain of diagonals; one that is not compact is cut.

    It is cut around the diagonals with most votes, whose regions do not overlap.
    """
    first, last = min(v["first"] for v in lines), max(v["last"] for v in lines)
    if last - first < 2 * runs + NEIGHBOURS:
        yield first, last + GRAM
        return
    taken: list[int] = []
    for line in sorted(lines, key=lambda v: (-v["votes"], v["diagonal"])):
        middle = line["diagonal"]
        at = bisect_left(taken, middle)
        if any(abs(middle - other) < runs for other in taken[max(0, at - 1) : at + 1]):
            continue
        insort(taken, middle)
        yield max(0, middle - NEIGHBOURS), middle + runs + GRAM - 1 + NEIGHBOURS


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the candidate chains whose words quote their templates."""
    templates = [_joined(alnum_words(text.encode())) for _, text in TEMPLATES]
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    names = ["row_key", "label", "template", "first_word", "last_word", "share"]
    for batch in pieces(batches):
        rows = []
        for key, text, chains in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = _joined(alnum_words(text))
            for chain in chains:
                number = chain["template"]
                runs = len(templates[number]) - GRAM + 1
                for first, end in _regions(chain["lines"], runs):
                    found = verified(words[first:end], templates[number])
                    # The words beside the span, which the template has not, may also change it.
                    if not found or not VARIANTS.isdisjoint([*words[max(0, first + found[0] - 1) : first + found[0]], *words[first + found[1] + 1 : first + found[1] + 2]]):
                        continue
                    if found[2] >= LEAST_SHARE * runs or found[2] >= LEAST_RUNS:
                        rows.append((key, TEMPLATES[number][0], number, first + found[0], first + found[1], found[2] / runs))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def licences(documents: DataFrame) -> DataFrame:
    """Licences named or quoted in each row of ``documents``.

    Returns ``doc_id``, ``n_words``, the phrases' count and outer places, ``base_labels``,
    ``labels`` with those of the quoted templates, and ``score``: the largest share of a
    template found, at least 0.9 where a phrase is named. A null or empty text has no words
    and score 0; rows without an id and repeated rows are each returned; other columns
    are not read.
    """
    docs = _documents(documents)
    quoted = licence_spans(documents).groupBy("row_key").agg(
        F.collect_set("label").alias("quoted"), F.max("share").alias("share")
    )
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("quoted", none)))
    named = F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)
    return _base(docs).join(quoted, "row_key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(named, F.coalesce("share", F.lit(0.0))).alias("score"),
    )
