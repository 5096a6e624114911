"""Language-model scores by a probabilistic suffix tree.

The tree's states are contexts of up to ``DEPTH`` tokens. A context seen often enough is kept if
its next-token distribution differs from its parent's (the context without its first token) by
a divergence test, and if its parent is kept. Distributions are smoothed towards the parent's, at
the root towards token counts. A token is scored from the state of the longest kept suffix of
what stands before it.

The tree is a set of Spark tables that grow with the corpus: thresholds are numbers of
occurrences. At a kept context a listed token has ``gain + fall * parent's probability``, any other
one ``fall * parent's``. So a text's score is its score at the root plus one value for
each kept context and one for each listed transition that it meets. Values of the most frequent are sent
to tasks, at most 1 / ``COMMON`` of a kind and length; those of all others are joined. What a
task lists for the join is first thinned by a bit table of bounded size, which can only
let too much pass, and never too little.

What tasks count or list goes through shuffles as rows of packed numbers, a row for each bucket of a block of
texts. Buckets follow from the keys, so that all of a key meets in one task; there are as many as the corpus
needs to keep each small. Texts are scored in passes over a part of the rows each: a text is read in one only.

Contexts and transitions go by 64-bit keys: the rotated key of the tokens before, xor the token's hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TIDY, Scratch, Words, held_out, settings, split_words, text_pieces

#: Tokens of the longest contexts.
DEPTH = 4
#: Least occurrences of a context, and of a transition that is listed at it.
CONTEXT, TRANSITION = 500, 6
#: Least relative frequency of what is sent to tasks instead of being joined.
COMMON = 4e-6
#: A context is kept if count * divergence exceeds this many times log(count).
KEEP = 3.0
#: Weight of the parent's distribution, in tokens.
SMOOTH = 20.0
END = b""
#: Distinct tokens or transitions counted in a task before they are passed on.
HELD, HELD_GRAMS = 400_000, 1_500_000
#: Bits of the tables that thin what tasks list: the fewest, for each key, and the most.
BITS, KEY_BITS, MOST_BITS = 1 << 26, 16, 1 << 28
#: Passes that score a part of the rows each: only what these list is shuffled at a time.
PASSES = 4
#: Counted occurrences, and joined values or tokens, for each bucket; buckets of the join at least.
BUCKET_RUNS, BUCKET_VALUES, BUCKETS = 500_000, 100_000, 64
#: Key of the place before a text, and by how many bits the key of what stands before is rotated.
START, TURN = 0x5D588B656C078965, 23
#: Of xxhash64.
PRIMES = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text")
    ).withColumn("held_out", held_out(7))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over the training rows; the end is the empty token."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns({"n_sum": "n"}).select(["token", "n"])

        for batch in text_pieces(batches, "text"):
            words = split_words(batch.column(0))
            ends += batch.num_rows
            counts = np.bincount(words.numbers, minlength=len(words.distinct))
            held.append(pa.table({"token": words.distinct, "n": pa.array(counts, pa.int64())}))
            if sum(map(len, held)) > 2 * HELD:
                held[:] = [merged()]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches()
        if ends:
            held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
            yield from merged().to_batches()

    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "token binary, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def token_hash(word: bytes) -> int:
    """As ``xxhash64`` in SQL gives it for a binary column."""
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >> 63 else value


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def token_hashes(words: pa.Array) -> np.ndarray:
    """``token_hash`` of a binary column: words under 32 bytes together, longer ones one by one."""
    one, two, three, four, five = (np.uint64(p) for p in PRIMES)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    at, sizes = ends[:-1], np.diff(ends)
    raw = np.concatenate([np.frombuffer(data or b"", np.uint8), np.zeros(8, np.uint8)])
    # Eight and four bytes from any place.
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    quad = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    value = sizes.astype(np.uint64) + np.uint64(42) + five
    for k in range(0, 24, 8):
        own = np.flatnonzero((sizes >= k + 8) & (sizes < 32))
        value[own] = _rotated(value[own] ^ (_rotated(eight[at[own] + k] * two, 31) * one), 27) * one + four
    own = np.flatnonzero(sizes & 4)
    value[own] = _rotated(value[own] ^ (quad[at[own] + (sizes[own] & ~7)].astype(np.uint64) * one), 23) * two + three
    for k in range(3):
        own = np.flatnonzero(sizes & 3 > k)
        value[own] = _rotated(value[own] ^ (raw[at[own] + (sizes[own] & ~3) + k].astype(np.uint64) * five), 11) * one
    value = (value ^ (value >> np.uint64(33))) * two
    value = (value ^ (value >> np.uint64(29))) * three
    found = (value ^ (value >> np.uint64(32))).view(np.int64)
    for k in np.flatnonzero(sizes >= 32).tolist():
        found[k] = token_hash(words[k].as_py())
    return found


class Alphabet:
    """Common tokens, which are sent to tasks, with their counts."""

    def __init__(self, rows: Iterable[tuple[bytes, int]]):
        common = sorted(((bytes(t), int(n)) for t, n in rows), key=lambda x: (-x[1], x[0]))
        self.tokens = pa.array([token for token, _ in common], pa.binary())
        self.counts = np.array([n for _, n in common] + [0], np.int64)
        self.end = dict(common).get(END, 0)

    def encode(self, words: pa.Array) -> np.ndarray:
        """Numbers of the tokens; those that were not sent have the last."""
        return pc.index_in(words, self.tokens).fill_null(len(self.tokens)).to_numpy().astype(np.int64)


class Symbols:
    """Hashes of the start, the tokens and the end of several texts, with the text of each and its place there."""

    def __init__(self, words: Words, hashes: np.ndarray):
        sizes = words.sizes + 2
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.text)) - starts[self.text]
        self.keys = np.full(len(self.text), token_hash(END), np.int64)
        self.keys[starts] = START
        self.keys[(self.place > 0) & (self.place <= words.sizes[self.text])] = hashes[words.numbers]


def _turned(keys: np.ndarray) -> np.ndarray:
    wide = keys.view(np.uint64)
    return ((wide << np.uint64(TURN)) | (wide >> np.uint64(64 - TURN))).view(np.int64)


def _turned_column(key: Column) -> Column:
    return F.shiftleft(key, TURN).bitwiseOR(F.shiftrightunsigned(key, 64 - TURN))


def _longer(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Keys of runs of one more token, by the place of their last one; the first place has none."""
    longer = symbols.copy()
    longer[1:] ^= _turned(keys[:-1])
    return longer


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    """Values of the place ``by`` places earlier."""
    moved = np.zeros_like(values)
    if by < len(values):
        moved[by:] = values[: len(values) - by]
    return moved


class BitTable:
    """A set of keys in bits: has all that were put in, and some others."""

    def __init__(self, keys: DataFrame):
        """From the first column; at most MOST_BITS / 64 rows reach the driver."""
        self.many = keys.count()
        self.bits = min(max(BITS, 1 << (KEY_BITS * self.many).bit_length()), MOST_BITS)
        bits = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(self.bits)).alias("bit"))
        part = F.expr("shiftleft(1L, cast(bit % 64 as int))")
        words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(part).alias("bits")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys & (self.bits - 1)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1


def _packed(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of whole numbers and of packed arrays, buffers or bytes."""
    columns = [[v if isinstance(v, (int, bytes)) else v.tobytes() if isinstance(v, np.ndarray) else v.to_pybytes() for v in c] for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns or [[]] * len(schema), schema, strict=True)], schema=schema)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() if pa.types.is_integer(c.type) else c[k].as_buffer() for c in batch.columns)


def _summed(context: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once with its count."""
    key = _turned(context) ^ suffix
    order = np.argsort(key)
    for exact in (False, True):
        if exact:  # Different pairs share a key.
            order = np.lexsort((suffix, context))
        first = np.ones(len(order), bool)
        one, other, whole = context[order], suffix[order], key[order]
        first[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
        if not (first[1:] & (whole[1:] == whole[:-1])).any():
            break
    at = np.flatnonzero(first)
    return one[at], other[at], np.add.reduceat(counts[order], at) if len(at) else counts


RUNS = pa.schema([("bucket", pa.int32()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("suffixes", pa.binary()), ("counts", pa.binary())])


def _dealt(context: np.ndarray, suffix: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Pairs by bucket: half of its bits are the context's, the others the suffix's, so that a frequent context is spread."""
    half = bits // 2
    bucket = ((context & ((1 << (bits - half)) - 1)) << half) | (suffix & ((1 << half) - 1))
    # By bucket, then by the rest of the context: each is written once for its suffixes.
    order = np.argsort((bucket << (62 - bits)) | ((context >> bits) & ((1 << (62 - bits)) - 1)))
    context, suffix, counts, bucket = context[order], suffix[order], counts[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order))).astype(np.int32)
    found, starts = np.unique(bucket, return_index=True)
    rows = []
    for b, low, high in zip(found.tolist(), starts, np.append(starts[1:], len(order)), strict=True):
        left, right = np.searchsorted(heads, (low, high))
        rows.append((b, context[heads[left:right]], sizes[left:right], suffix[low:high], counts[low:high].astype(np.int64)))
    return _packed(rows, RUNS)


def _transitions(docs: DataFrame, often: Broadcast, listed: Broadcast, least: int, most: int, total: int) -> DataFrame:
    """(context, suffix, n): occurrences of a context and of the run without its first token, over the training rows.

    The contexts have ``least`` to ``most`` tokens. All runs of ``least`` tokens in them must be in
    ``often``, and the last ``least`` tokens of the whole in ``listed``, as rarer parts make a rarer whole.
    """
    bits = max(0, math.ceil(math.log2(max(total, 1) / BUCKET_RUNS)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known = often.value, listed.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge() -> None:
            if held:
                held[:] = [_summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]

        for batch in text_pieces(batches, "text"):
            words = split_words(batch.column(0))
            symbols = Symbols(words, token_hashes(words.distinct))
            keys = symbols.keys
            for _ in range(least - 1):
                keys = _longer(keys, symbols.keys)
            parts, fits = frequent.has(keys), known.has(keys)
            for length in range(least, most + 1):
                fits = fits & _shift(parts, length - least + 1)
                chosen = np.flatnonzero(fits & (symbols.place >= length))
                if len(chosen):
                    held.append((keys[chosen - 1], keys[chosen], np.ones(len(chosen), np.int64)))
                keys = _longer(keys, symbols.keys)
            if sum(len(c) for c, _, _ in held) > HELD_GRAMS:
                merge()
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield _dealt(*held.pop(), bits)
        merge()
        if held:
            yield _dealt(*held.pop(), bits)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(_unpacked(batches), lambda row: row[0]):
            blocks = []
            for _, contexts, sizes, suffixes, counts in rows:
                context = np.repeat(np.frombuffer(contexts, np.int64), np.frombuffer(sizes, np.int32))
                blocks.append((context, np.frombuffer(suffixes, np.int64), np.frombuffer(counts, np.int64)))
            context, suffix, counts = _summed(*(np.concatenate(c) for c in zip(*blocks, strict=True)))
            enough = counts >= TRANSITION
            yield pa.RecordBatch.from_arrays([pa.array(c[enough]) for c in (context, suffix, counts)], ["context", "suffix", "n"])

    parts = docs.where(~F.col("held_out")).select("text")
    parts = parts.mapInArrow(run, "bucket int, contexts binary, sizes binary, suffixes binary, counts binary")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(count, "context bigint, suffix bigint, n bigint")


def _grow(counted: DataFrame, contexts: DataFrame, parents: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One more length of contexts: candidate transitions, and the transitions and contexts that are kept.

    ``contexts`` has candidates with their parent and count, ``parents`` the probability ``p`` of the
    parents' transitions, or of tokens at the root, by ``key``.
    """
    key = _turned_column(F.col("context").bitwiseXOR(F.col("parent"))).bitwiseXOR(F.col("suffix"))
    found = counted.join(contexts, "context").withColumn("key", key)
    above = parents.select(F.col("key").alias("suffix"), F.col("p").alias("above"))
    found = scratch.write(found.join(above, "suffix"), f"candidates-{level}")
    whole = F.col("total") + SMOOTH
    falls = found.groupBy("context").agg(F.first("total").alias("total"), F.sum("n").alias("seen"))
    falls = falls.select("context", "total", ((whole - F.col("seen")) / whole).alias("fall"))
    probability = F.col("n") / whole + F.col("fall") * F.col("above")
    mine = found.drop("total").join(falls, "context").withColumn("p", probability)
    sums = mine.groupBy("context").agg(
        F.first("total").alias("total"),
        F.first("fall").alias("fall"),
        F.sum(F.col("p") * F.log(F.col("p") / F.col("above"))).alias("inner"),
        F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("left"),
        F.greatest(1 - F.sum("above"), F.lit(1e-12)).alias("base"),
    )
    divergence = F.col("inner") + F.col("left") * F.log(F.col("left") / F.col("base"))
    kept = sums.where(F.col("total") * divergence > KEEP * F.log(F.greatest("total", F.lit(2))))
    kept = scratch.write(kept.select("context", "total", "fall"), f"contexts-{level}")
    chosen = found.drop("total").join(kept, "context").withColumn("p", probability)
    value = F.log10("p") - F.log10("above") - F.log10("fall")
    listed = scratch.write(chosen.select("key", "p", "n", value.alias("value")), f"transitions-{level}")
    return found, listed, kept


class Model:
    """Token counts, and the values of the tree's contexts and transitions by key."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        context = docs.sparkSession.sparkContext
        self.tokens = scratch.write(token_counts(docs), "tokens")
        total, distinct = self.tokens.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.total, self.distinct = int(total or 0), int(distinct)
        common = self.tokens.where((F.col("n") >= COMMON * self.total) | (F.col("token") == F.lit(END)))
        common = common.select("token", "n").toArrow()
        self.letters = context.broadcast(Alphabet(zip(common["token"].to_pylist(), common["n"].to_pylist(), strict=True)))
        hashed = self.tokens.select(F.xxhash64("token").alias("key"), "n", "token")
        parents = hashed.select("key", ((F.col("n") + 1) / (self.total + self.distinct + 1)).alias("p"))
        # A token is a context as often as it stands; the start, as often as the end.
        start = F.when(F.col("token") == F.lit(END), F.lit(START)).otherwise(F.col("key"))
        contexts = hashed.where(F.col("n") >= CONTEXT).select(
            start.alias("context"), F.lit(0).cast("bigint").alias("parent"), F.col("n").alias("total")
        )
        often, listed = contexts, hashed.where(F.col("n") >= TRANSITION).select("key")
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        counted = None
        for level in range(1, DEPTH + 1):
            if level < 3:
                # The first pass counts pairs of tokens, the second one all longer runs.
                tables = [context.broadcast(BitTable(t)) for t in (often, listed)]
                counted = scratch.write(_transitions(docs, *tables, level, 1 if level == 1 else DEPTH, self.total), f"counts-{level}")
                for table in tables:
                    table.unpersist()
            found, transitions, kept = _grow(counted, contexts, parents, scratch, level)
            # Nothing reads these any more.
            scratch.drop("counts-1" if level == 1 else f"candidates-{level - 1}")
            if kept.isEmpty():
                break
            self.levels.append((transitions, kept))
            contexts = found.where(F.col("n") >= CONTEXT).select(
                F.col("key").alias("context"), F.col("suffix").alias("parent"), F.col("n").alias("total")
            )
            contexts = contexts.join(kept.select(F.col("context").alias("parent")), "parent", "left_semi")
            often, listed, parents = contexts.select("context"), transitions.select("key"), transitions

        for name in ("counts-2", f"candidates-{level}"):
            scratch.drop(name)
        values = docs.sparkSession.createDataFrame([], "key bigint, value double, n bigint")
        for transitions, kept in self.levels:
            values = values.unionByName(transitions.select("key", "value", "n")).unionByName(
                kept.select(F.bitwise_not("context").alias("key"), F.log10("fall").alias("value"), F.col("total").alias("n"))
            )
        sent = values.where(F.col("n") >= COMMON * self.total).select("key", "value").toArrow().sort_by("key")
        self.keys, self.values = sent["key"].to_numpy(), sent["value"].to_numpy()
        self.rest = values.where(F.col("n") < COMMON * self.total).select("key", "value")
        self.others = BitTable(self.rest)
        self.depth = len(self.levels)


class Sent:
    """Values by key, found by trying a key's place and those after it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << (4 * len(keys) + 1).bit_length()
        self.mask = size - 1
        # What stands in free places is no key.
        self.free = int(np.setdiff1d(np.arange(len(keys) + 1), keys)[0])
        self.keys, self.values, self.steps = np.full(size, self.free, np.int64), np.zeros(size), 0
        while len(keys):
            place = self.place(keys)
            open_ = np.flatnonzero(self.keys[place] == self.free)
            places, first = np.unique(place[open_], return_index=True)
            first = open_[first]
            self.keys[places], self.values[places] = keys[first], values[first]
            keys, values = np.delete(keys, first), np.delete(values, first)
            self.steps += 1

    def place(self, keys: np.ndarray, step: int | None = None) -> np.ndarray:
        return ((keys >> 20) + (self.steps if step is None else step)) & self.mask

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys or 0, and whether a key is there."""
        values, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left = np.flatnonzero(keys != self.free)
        for step in range(self.steps):
            place = self.place(keys[left], step)
            stands = self.keys[place]
            hit = stands == keys[left]
            there[left[hit]], values[left[hit]] = True, self.values[place[hit]]
            left = left[~hit & (stands != self.free)]
        return values, there


class Tree:
    """What tasks need of a model: values of frequent keys, and which keys others may have."""

    def __init__(self, model: Model):
        self.sent, self.others, self.depth = Sent(model.keys, model.values), model.others, model.depth

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the keys or 0, and whether a key is there, or may be among the others."""
        values, there = self.sent.look_up(keys)
        return values, there, ~there & self.others.has(keys)

    def score(self, symbols: Symbols, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the texts the sum of the values that are here, and the keys to be joined with their texts."""
        text, place = symbols.text, symbols.place
        sums, places, keys = np.zeros(many), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        shorter, at = symbols.keys, np.flatnonzero(place >= 1)
        for length in range(1, self.depth + 1):
            longer = _longer(shorter, symbols.keys)
            at = at[place[at] >= length]
            context = ~shorter[at - 1]
            value, there, maybe = self.look_up(context)
            sums += np.bincount(text[at], value, many)
            places.append(text[at[maybe]])
            keys.append(context[maybe])
            at = at[there | maybe]
            value, _, maybe = self.look_up(longer[at])
            sums += np.bincount(text[at], value, many)
            places.append(text[at[maybe]])
            keys.append(longer[at[maybe]])
            shorter = longer
        return sums, np.concatenate(places), np.concatenate(keys)


#: What is shuffled to score: values of the model, what blocks of rows list, and what else is known of these rows.
MODEL, LISTS, ROWS = range(3)
SHEETS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("tokens", pa.binary()), ("times", pa.binary())])
SHEET = "bucket int, kind int, block bigint, keys binary, numbers binary, tokens binary, times binary"


def _in_buckets(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket that keeps the order inside, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> 40) & (buckets - 1)


def _sheets(keys: np.ndarray, numbers: np.ndarray, tokens: pa.Array, hashes: np.ndarray, times: np.ndarray, buckets: int) -> Iterator[tuple]:
    """By bucket: its keys with a number each, and its tokens with one, the tokens joined by spaces."""
    order, ends = _in_buckets(_bucket(keys, buckets), buckets)
    keys, numbers = keys[order], numbers[order]
    order, stops = _in_buckets(_bucket(hashes, buckets), buckets)
    times = times[order]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), tokens.take(pa.array(order))), b" ")
    for b in np.flatnonzero((np.diff(ends) > 0) | (np.diff(stops) > 0)).tolist():
        own, its = slice(ends[b], ends[b + 1]), slice(stops[b], stops[b + 1])
        yield b, keys[own], numbers[own], joined[b].as_buffer(), times[its]


def _model_sheets(model: Model, buckets: int) -> DataFrame:
    """The values of keys and the counts of tokens that were not sent."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            held.clear()
            keys, tokens = rows.filter(pc.is_null(rows["token"])), rows.filter(pc.is_valid(rows["token"]))
            sheets = _sheets(
                keys["key"].to_numpy(), keys["value"].to_numpy(), tokens["token"].cast(pa.binary()),
                tokens["key"].to_numpy(), tokens["n"].to_numpy(), buckets,
            )
            return _packed([(b, MODEL, 0, *sheet) for b, *sheet in sheets], SHEETS)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > HELD:
                yield out()
        if held:
            yield out()

    none = F.lit(None).cast("binary").alias("token")
    values = model.rest.select("key", "value", none, F.lit(0).cast("bigint").alias("n"))
    tokens = model.tokens.where(F.col("n") < COMMON * model.total)
    rest = values.unionByName(tokens.select(F.xxhash64("token").alias("key"), F.lit(0.0).alias("value"), "token", "n"))
    return rest.mapInArrow(run, SHEET)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list the sums of its rows: values of keys, known tokens and logs of their counts. By bucket, the model first."""
    for _, rows in itertools.groupby(_unpacked(batches), lambda row: row[0]):
        parts, counts, keys, values = [], {}, None, None
        for bucket, kind, block, own, numbers, tokens, times in rows:
            words = tokens.to_pybytes().split(b" ") if len(times) else []
            if kind == MODEL:
                parts.append((np.frombuffer(own, np.int64), np.frombuffer(numbers, np.float64)))
                counts.update(zip(words, np.frombuffer(times, np.int64).tolist(), strict=True))
                continue
            if kind == ROWS:
                yield _packed([(bucket, kind, block, own, numbers, tokens, times)], SHEETS)
                continue
            if keys is None:
                keys, values = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
                order = np.argsort(keys)
                keys, values = np.append(keys[order], 0), np.append(values[order], 0.0)
            listed, of = np.frombuffer(own, np.int64), np.frombuffer(numbers, np.int32)
            at = np.searchsorted(keys[:-1], listed)
            found = (at < len(keys) - 1) & (keys[at] == listed)
            sums = np.bincount(of[found], values[at[found]])
            texts = np.flatnonzero(np.bincount(of[found]))
            n = np.fromiter((counts.get(w, 0) for w in words), np.float64, len(words))
            of = np.frombuffer(times, np.int32)[n > 0]
            known, logs = np.bincount(of), np.bincount(of, np.log10(n[n > 0] + 1))
            some = np.flatnonzero(known)
            parts_ = [texts.astype(np.int32), sums[texts], some.astype(np.int32), np.stack([known[some].astype(np.float64), logs[some]])]
            yield _packed([(bucket, LISTS, block, *parts_)], SHEETS)


def score(documents: DataFrame) -> DataFrame:
    """Scores of each row of ``documents``, learned from rows that are not held out.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (the end included), ``n_known``,
    ``train_tokens``, ``base_score`` by token counts and ``score`` by the tree, both log10 of
    the text's probability. A null or empty text is the end alone; a row without an id is
    learned from; repeated rows are each returned and counted; other columns are not
    read. Without training rows every token is unknown.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    docs = _documents(documents)
    with settings(spark, TIDY):
        model = Model(docs, scratch)
    total, letters = model.total, model.letters
    sent = spark.sparkContext.broadcast(Tree(model))
    denominator = math.log10(total + model.distinct + 1)
    most = max(model.others.many, model.distinct) / BUCKET_VALUES
    buckets = max(BUCKETS, 1 << math.ceil(math.log2(max(most, 1))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, tree = letters.value, sent.value
        rest, end = len(alphabet.tokens), alphabet.end
        logs = np.log10(alphabet.counts + 1.0)
        for k, batch in enumerate(text_pieces(batches, "text")):
            block = (TaskContext.get().partitionId() << 32) + k
            many = batch.num_rows
            words = split_words(batch.column("text"))
            of = np.repeat(np.arange(many), words.sizes)
            hashed, numbers = token_hashes(words.distinct), alphabet.encode(words.distinct)
            symbols = Symbols(words, hashed)
            sums, texts, keys = tree.score(symbols, many)
            numbers = numbers[words.numbers]
            base = np.bincount(of, np.where(numbers < rest, logs[numbers], 0.0), many) + math.log10(end + 1)
            known = np.bincount(of[numbers < rest], minlength=many) + (end > 0)
            rare = np.flatnonzero(numbers == rest)
            tokens = words.numbers[rare]
            sheets = _sheets(keys, texts.astype(np.int32), words.distinct.take(pa.array(tokens)), hashed[tokens], of[rare].astype(np.int32), buckets)
            rows = [(b, LISTS, block, *sheet) for b, *sheet in sheets]
            ids = batch.column("doc_id")
            flags = np.stack([batch.column("held_out").to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)])
            whole = np.stack([ids.fill_null(0).to_numpy(), words.sizes + 1, known]).astype(np.int64)
            rows.append((block % buckets, ROWS, block, whole, np.stack([base, sums]), flags, b""))
            yield _packed(rows, SHEETS)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(_unpacked(batches), lambda row: row[2]):
            for _, kind, _, first, second, third, fourth in rows:
                # What is known of the rows is the first of their block.
                if kind == ROWS:
                    ids, n_tokens, known = np.frombuffer(first, np.int64).reshape(3, -1).copy()
                    base, value = np.frombuffer(second, np.float64).reshape(2, -1).copy()
                    held, null = np.frombuffer(third, bool).reshape(2, -1)
                    continue
                value[np.frombuffer(first, np.int32)] += np.frombuffer(second, np.float64)
                of, (times, logs) = np.frombuffer(third, np.int32), np.frombuffer(fourth, np.float64).reshape(2, -1)
                known[of] += times.astype(np.int64)
                base[of] += logs
            base -= n_tokens * denominator
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(held), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(base + value)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    with settings(spark, TIDY):
        values = scratch.write(_model_sheets(model, buckets), "values")
        scored = []
        for number in range(PASSES):
            own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES)) == number)
            sheets = own.mapInArrow(run, SHEET).unionByName(values)
            found = sheets.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_joined, SHEET)
            found = found.repartition("block").sortWithinPartitions("block", F.desc("kind")).mapInArrow(finish, schema)
            scored.append(scratch.write(found, f"scored-{number}"))
        scratch.drop("values")
    whole = scored[0]
    for part in scored[1:]:
        whole = whole.unionByName(part)
    return whole
