"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of the documents that one task reads. Its words are numbered by
the vocabulary of the test phrases; a word that no phrase holds cannot be part of an
occurrence, so runs of such words become one separator, and stretches that are shorter
than the shortest phrase are left out. Over what remains stands an FM-index: the
Burrows-Wheeler transform in a wavelet matrix, with suffix positions sampled. All test
phrases of a block are searched backwards at once, their occurrences are located by
walking to sampled positions, and become spans of words that are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, pieces, texts_of

#: Words of a test phrase.
WINDOW = 10
#: Symbols that a shard's index holds before the next shard begins.
SHARD_SYMBOLS = 400_000
#: Distinct phrases searched in one pass; a larger benchmark takes several passes.
BLOCK_PHRASES = 200_000
#: Text positions between two sampled suffixes.
SAMPLE_STEP = 16

SPANS = "doc_id bigint, text_key binary, n_words bigint, spans array<struct<start:int,stop:int>>, items array<bigint>"


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.size = len(symbols)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            row = np.concatenate((row[bit == 0], row[bit == 1]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        start, stop = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - k)) & 1 == 1
            below, above = ones[start], ones[stop]
            start = np.where(bit, zeros + below, start - below)
            stop = np.where(bit, zeros + above, stop - above)
        return stop - start

    def access(self, rows: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        at, found = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            found = found * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return found


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; each 0 is a separator of its own, ordered by place.

    Prefix doubling, in which only suffixes that are still tied are sorted again.
    """
    size = len(symbols)
    first = symbols.astype(np.int64)
    separators = np.flatnonzero(first == 0)
    first += len(separators)
    first[separators] = np.arange(len(separators))
    order = np.argsort(first, kind="stable")
    heads = np.concatenate(([True], first[order][1:] != first[order][:-1]))
    starts = np.maximum.accumulate(np.where(heads, np.arange(size), 0))
    rank = np.empty(size, np.int64)
    rank[order] = starts
    step = 1
    while True:
        ends = np.concatenate((heads[1:], [True]))
        tied = np.flatnonzero(~(heads & ends))
        if not len(tied):
            return order
        suffixes = order[tied]
        # The last symbol is a separator, so a tied suffix always has symbols left.
        key = rank[suffixes] * size + rank[np.minimum(suffixes + step, size - 1)]
        sort = np.argsort(key, kind="stable")
        order[tied] = suffixes[sort]
        key = key[sort]
        heads[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.maximum.accumulate(np.where(heads, np.arange(size), 0))
        rank[order[tied]] = starts[tied]
        step *= 2


class FMIndex:
    """Backward search and location in symbols where 0 separates; the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        transform = symbols[order - 1]
        self.matrix = WaveletMatrix(transform, alphabet)
        counts = np.bincount(symbols, minlength=alphabet)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        # A walk never steps over a separator, as positions behind one are sampled.
        sampled = (order % SAMPLE_STEP == 0) | (transform == 0)
        self.sampled = sampled
        self.before = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase; phrases are of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.matrix.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.matrix.access(rows[walking])
            rows[walking] = self.first[symbol] + self.matrix.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.before[rows]] + steps


class Phrases:
    """Distinct test phrases over numbered words, with the items each belongs to."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[int | None]] = {}

    def add(self, item_id: int | None, text: bytes | None) -> None:
        words = alnum_words(text or b"")
        if not words:
            return
        numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
        length = min(self.window, len(words))
        for k in range(len(words) - length + 1):
            self.items.setdefault(tuple(numbers[k : k + length]), set()).add(item_id)

    def by_length(self) -> list[tuple[np.ndarray, list[list[int]]]]:
        groups: dict[int, list[tuple[int, ...]]] = {}
        for phrase in self.items:
            groups.setdefault(len(phrase), []).append(phrase)
        return [
            (np.array(found), [sorted(x for x in self.items[p] if x is not None) for p in found])
            for _, found in sorted(groups.items())
        ]


def phrase_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of bounded size; rows come one partition at a time."""
    phrases = Phrases(window)
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).toLocalIterator():
        phrases.add(row[0], None if row[1] is None else row[1].encode())
        if len(phrases.items) >= most:
            yield phrases
            phrases = Phrases(window)
    yield phrases


class Shard:
    """Documents of a task gathered up to the size of an index."""

    def __init__(self, numbers: dict[bytes, int], shortest: int):
        self.numbers, self.shortest = numbers, shortest
        self.docs: list[tuple[int | None, bytes | None, int]] = []
        self.symbols: list[np.ndarray] = []
        self.owners: list[tuple[int, int, int]] = []  # document, first word, first symbol
        self.size = 0

    def add(self, doc_id: int | None, key: bytes | None, text: bytes | None) -> None:
        words = alnum_words(text or b"")
        self.docs.append((doc_id, key, len(words)))
        if len(words) < self.shortest:
            return
        codes = np.fromiter(map(self.numbers.get, words, [0] * len(words)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes != 0, [0]))))
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            if stop - start >= self.shortest:
                self.symbols += [codes[start:stop], np.zeros(1, np.int32)]
                self.owners.append((len(self.docs) - 1, int(start), self.size))
                self.size += int(stop - start) + 1

    def found(self, groups: list[tuple[np.ndarray, list[list[int]]]], alphabet: int) -> Iterator[tuple]:
        """(doc_id, key, words, merged spans, items) of each document."""
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        items: dict[int, set[int]] = {}
        if self.size:
            index = FMIndex(np.concatenate(self.symbols), alphabet)
            owners = np.array(self.owners, np.int64)
            for phrases, names in groups:
                low, high = index.search(phrases)
                which = np.repeat(np.arange(len(phrases)), high - low)
                if not len(which):
                    continue
                offsets = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                places = index.locate(low[which] + offsets)
                owner = np.searchsorted(owners[:, 2], places, side="right") - 1
                docs = owners[owner, 0]
                starts = owners[owner, 1] + places - owners[owner, 2]
                by_doc = np.argsort(docs, kind="stable")
                cuts = np.flatnonzero(np.diff(docs[by_doc])) + 1
                for part in np.split(by_doc, cuts):
                    doc = int(docs[part[0]])
                    hits.setdefault(doc, []).append((starts[part], starts[part] + phrases.shape[1]))
                    for p in np.unique(which[part]):
                        items.setdefault(doc, set()).update(names[p])
        for k, (doc_id, key, count) in enumerate(self.docs):
            yield doc_id, key, count, merged(hits.get(k, [])), sorted(items.get(k, ()))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[str, int]]:
    """Spans in order, with those that touch or overlap made one."""
    if not parts:
        return []
    starts = np.concatenate([p[0] for p in parts])
    stops = np.concatenate([p[1] for p in parts])
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    heads = np.concatenate(([True], starts[1:] > stops[:-1]))
    first = np.flatnonzero(heads)
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    return [{"start": int(starts[a]), "stop": int(stops[b])} for a, b in zip(first, last, strict=True)]


def _search(docs: DataFrame, phrases: Phrases, shard_symbols: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((phrases.numbers, phrases.by_length()))

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, groups = sent.value
        shortest = min((p.shape[1] for p, _ in groups), default=1 << 60)
        shard = Shard(numbers, shortest)

        def out(shard: Shard) -> pa.RecordBatch:
            rows = list(shard.found(groups, len(numbers) + 1))
            columns = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            kinds = [pa.int64(), pa.binary(), pa.int64(), span, pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_words", "spans", "items"])

        for batch in pieces(batches):
            keys = texts_of(batch, "text_key")
            for doc_id, key, text in zip(batch.column(0).to_pylist(), keys, texts_of(batch, "text"), strict=True):
                shard.add(doc_id, key, text)
                if shard.size >= shard_symbols or len(shard.docs) >= 20_000:
                    yield out(shard)
                    shard = Shard(numbers, shortest)
        if shard.docs:
            yield out(shard)

    return docs.mapInArrow(shards, SPANS)


def _span_union(spans: Column) -> Column:
    """Sorted spans of several passes with those that touch made one."""
    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        joins = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(
            joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        ).otherwise(F.concat(done, F.array(span)))

    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return F.aggregate(F.array_sort(spans), empty, step)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_symbols: int = SHARD_SYMBOLS,
    block_phrases: int = BLOCK_PHRASES,
) -> DataFrame:
    """Spans of test phrases in each document.

    Returns a row for each row of ``documents``: ``doc_id``, ``n_words``, ``spans`` (merged
    word ranges to remove), ``items`` (ids of the test items that occur). A phrase is
    ``window`` consecutive words of an item, or the whole of a shorter one.

    A null or empty text has no words; a null ``doc_id`` is kept; repeated rows are each
    returned; items without words never occur; an item whose id is null has its words
    found but is not listed; other columns are not read. Empty tables give no rows, or
    rows without spans.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = phrase_blocks(benchmark, window, block_phrases)
    phrases, following = next(blocks), next(blocks, None)
    if following is None:
        plain = docs.select("doc_id", F.lit(None).cast("binary").alias("text_key"), "text")
        return _search(plain, phrases, shard_symbols).drop("text_key")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"), "text")
    parts, number = [], 0
    while phrases is not None:
        parts.append(scratch.write(_search(keyed, phrases, shard_symbols), f"block-{number}"))
        phrases, following = following, next(blocks, None)
        number += 1
    # Equal rows have equal spans, so one of them stands for the others in the union.
    found = parts[0].where(F.size("spans") > 0)
    for part in parts[1:]:
        found = found.unionByName(part.where(F.size("spans") > 0))
    union = found.groupBy("doc_id", "text_key").agg(
        _span_union(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = parts[0].select("doc_id", "text_key", "n_words").alias("r")
    same = F.expr("r.doc_id <=> u.doc_id AND r.text_key = u.text_key")
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return rows.join(union.alias("u"), same, "left").select(
        "r.doc_id",
        "r.n_words",
        F.coalesce("u.spans", none).alias("spans"),
        F.coalesce("u.items", F.expr("cast(array() as array<bigint>)")).alias("items"),
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items for each document."""
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that hold no test phrase, with their columns; rows without an id stay.

    Equal ids are judged together: one contaminated row removes all rows of its id.
    """
    found = summary(contamination(documents, benchmark, window))
    dirty = found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    # Written first, so that Spark knows its size when it plans the join of the texts.
    dirty = Scratch(documents.sparkSession, "decontaminate").write(dirty, "dirty")
    return documents.join(dirty, "doc_id", "left_anti").select(*documents.columns)
