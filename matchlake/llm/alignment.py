"""Alignment of the tokens of two tokenizers by an associative composition of fragments.

Both tokenizers cut the same bytes. Where tokens of both end, a group closes, and tokens of a group
whose byte ranges overlap are linked. A byte range gives a fragment: tokens up to its first common
end (open prefix), the groups after it (closed), tokens after its last common end (open
suffix). Composing two fragments closes the group that the first one's suffix and the
second one's prefix make, and is associative. Texts of one chunk are whole fragments; longer
ones are cut, their chunks become fragments in tasks of their own and are composed in
a tree, a fixed number at a time.

The links of a block of texts refer to the block's dictionary of id pairs. Dictionaries are what is
counted over the corpus; the counts go back to the blocks, not to the links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, settings

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a text that make one fragment, and fragments composed by one task of a round.
CHUNK, FAN_IN = 32_768, 16
#: Bytes of texts that share a dictionary, about.
BLOCK = 4_000_000
#: Rows passed to a task at once: they are held by the executor, the task and on the way between them.
AT_ONCE = 1_000
#: An id pair as one number: A's id times this plus B's id.
WIDTH = 1 << 20

#: Fixed value: how a byte-level tokenizer splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Vocabularies:
    """Both tokenizers by the contents of their files, loaded where they are used."""

    byte_level: bytes
    pieces: bytes
    _loaded: tuple = field(default=(), repr=False)

    @classmethod
    def read(cls, folder: str = FOLDER) -> Vocabularies:
        with open(f"{folder}/{BYTE_LEVEL}", "rb") as a, open(f"{folder}/{PIECES}", "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self) -> dict:  # what is loaded stays where it is
        return {"byte_level": self.byte_level, "pieces": self.pieces, "_loaded": ()}

    def load(self) -> tuple:
        """(encode A, encode B, A's tokens as bytes, B's)."""
        if not self._loaded:
            self._loaded = (*_byte_level(self.byte_level), *_pieces(self.pieces))
            self._loaded = tuple(self._loaded[i] for i in (0, 2, 1, 3))
        return self._loaded


def _byte_level(content: bytes) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """Encoder and token bytes of a byte-level vocabulary; its ids are the order of merges."""
    import tiktoken

    model = json.loads(content)["model"]
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printed}
    letters |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printed))}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if [model["vocab"].get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # No string is special to this encoding, so that all of a text is ordinary.
    encode = lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    return encode, [token for token, _ in sorted(ranks.items(), key=lambda r: r[1])]


def _pieces(content: bytes) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of texts, and the bytes of its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return (lambda texts: model.encode(texts, num_threads=1)), plain


def _lengths(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


def links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End and id pair of every link: of two tokens that overlap, one begins where the stretch they share begins."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs, merged in linear time
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    pair = a[np.searchsorted(a_ends, ends)] * WIDTH + b[np.searchsorted(b_ends, ends)]
    return ends, pair


_WRITTEN: dict[int, np.ndarray] = {}


def _written(ids: int) -> np.ndarray:
    """Every id with each sign after it, padded with zero bytes."""
    if not ids <= max(_WRITTEN, default=0):
        _WRITTEN.clear()
        _WRITTEN[ids] = np.array([b"%d%c" % (i, sign) for i in range(ids) for sign in b",|;"])
    return next(iter(_WRITTEN.values()))


def groups_text(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, common: np.ndarray) -> bytes:
    """Ids with the sign after each, ``,`` in a run, ``|`` after A's and ``;`` after B's, group by group."""
    ids = int(max(a.max(initial=0), b.max(initial=0))) + 1
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=len(common)))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=len(common)))])
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + b_before[a_group]] = 3 * a + (common[a_group] == a_ends)
    out[np.arange(len(b)) + a_before[b_group + 1]] = 3 * b + 2 * (common[b_group] == b_ends)
    return _written(-(-ids // 65_536) * 65_536)[out].tobytes().translate(None, b"\0")


@dataclass
class Fragment:
    """What a byte range knows: ids before its first common end, its groups, ids after its last."""

    head: tuple[np.ndarray, np.ndarray]
    cut: bool
    groups: int
    text: bytes
    pairs: np.ndarray
    tail: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Fragment:
        """Of the tokens that end in a byte range, with their ends in the text."""
        none = np.zeros(0, np.int64)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return cls((a, b), False, 0, b"", none, (none, none))
        i, j = (np.searchsorted(e, common[0], side="right") for e in (a_ends, b_ends))
        k, m = (np.searchsorted(e, common[-1], side="right") for e in (a_ends, b_ends))
        inner = a[i:k], b[j:m], a_ends[i:k], b_ends[j:m]
        text = groups_text(*inner, common[1:])
        return cls((a[:i], b[:j]), True, len(common) - 1, text, links(*inner)[1], (a[k:], b[m:]))

    def then(self, other: Fragment, sizes: tuple[np.ndarray, np.ndarray]) -> Fragment:
        """The fragment of both ranges, ``other`` being the next one."""
        if not self.cut:
            head = _joined(self.head, other.head)
            return Fragment(head, other.cut, other.groups, other.text, other.pairs, other.tail)
        if not other.cut:
            return Fragment(self.head, True, self.groups, self.text, self.pairs, _joined(self.tail, other.head))
        text, pairs = _closed(_joined(self.tail, other.head), sizes)
        return Fragment(
            self.head, True, self.groups + 1 + other.groups, self.text + text + other.text,
            np.concatenate([self.pairs, pairs, other.pairs]), other.tail,
        )

    def finished(self, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes, np.ndarray]:
        """Groups, their text and links of a whole text, whose end is a common one."""
        text, pairs = _closed(self.head, sizes)
        return self.groups + 1, text + self.text, np.concatenate([pairs, self.pairs])


def _joined(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def _closed(group: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Text and links of one group."""
    a_ends, b_ends = np.cumsum(sizes[0][group[0]]), np.cumsum(sizes[1][group[1]])
    return groups_text(*group, a_ends, b_ends, a_ends[-1:]), links(*group, a_ends, b_ends)[1]


#: Rows of three kinds: the tokens of one chunk of a long text; an aligned text with its links by place
#: in the block's dictionary; the dictionary of a block.
_FIELDS = (
    ("kind", "string"), ("block", "bigint"), ("doc_id", "bigint"), ("chunk", "bigint"), ("n_chunks", "bigint"), ("a", "array<int>"), ("b", "array<int>"), ("start", "bigint"),
    ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string"), ("places", "binary"), ("times", "binary"),
    ("pairs", "array<bigint>"), ("counts", "array<bigint>"),
)
_ROWS = ", ".join(f"{n} {k}" for n, k in _FIELDS)
_PART = (
    "block bigint, doc_id bigint, chunk bigint, n_a bigint, n_b bigint, cut boolean, groups bigint, text binary, pairs binary,"
    " head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _small(values: np.ndarray) -> bytes:
    """Whole numbers in two bytes each with a mark of that, else in four."""
    narrow = not len(values) or values.max() < 1 << 16
    return (b"\2" if narrow else b"\4") + values.astype("<u2" if narrow else "<u4").tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1).astype(np.int64)


def _block(block: int, texts: list[dict], pairs: list[np.ndarray]) -> list[dict]:
    """Aligned texts of one block with its dictionary."""
    if not texts:
        return []
    # Each text's distinct pairs come first: they are far fewer than its links.
    own = [np.unique(p, return_counts=True) for p in pairs]
    known, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
    counts, at = np.zeros(len(known), np.int64), 0
    for row, linked, (distinct, times) in zip(texts, pairs, own, strict=True):
        places = place[at : at + len(distinct)]
        at += len(distinct)
        counts[places] += times
        row |= {"kind": "text", "block": block, "n_links": len(linked), "places": _small(places), "times": _small(times)}
    return [*texts, {"kind": "dictionary", "block": block, "pairs": known, "counts": counts}]


def _encoded(texts: list[str], vocabularies: Vocabularies) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Ids of A and B; none where either's bytes are not a space and the text."""
    a_of, b_of, a_bytes, b_bytes = vocabularies.load()
    a_sizes = _lengths(a_bytes)
    result = []
    for text, b in zip(texts, b_of(texts), strict=True):
        whole = f" {text}".encode()
        a = a_of(f" {text}")
        # A's tokens are bytes of the text in order: they are all of it if none is missing.
        same = int(a_sizes[a].sum()) == len(whole) and b"".join(map(b_bytes.__getitem__, b)) == whole
        result.append((a, np.array(b, np.int64)) if same else None)
    return result


def _aligner(vocabularies: Vocabularies, longest: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text) to rows of ``_ROWS``."""
    schema = _schema(_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tuple(_lengths(t) for t in vocabularies.load()[2:4])
        number = TaskContext.get().partitionId() << 32
        texts: list[dict] = []
        pairs: list[np.ndarray] = []
        size = 0
        for batch in pieces(batches, 200):
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            given = [(i, t) for i, t in zip(ids, values, strict=True)]
            coded = iter(_encoded([t for _, t in given if t], vocabularies))
            for doc_id, text in given:
                found = next(coded) if text else None
                if found is None:
                    rows.append({"kind": "nothing", "block": number, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
                    continue
                a, b = found
                a_ends, b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
                size += int(a_ends[-1])
                if a_ends[-1] > longest:
                    number += 1
                    rows += _chunks(number, doc_id, a, b, a_ends, b_ends, longest)
                    continue
                groups, written, linked = Fragment.of(a, b, a_ends, b_ends).finished(sizes)
                digest = hashlib.sha256(written[:-1]).hexdigest()
                texts.append({"doc_id": doc_id, "n_a": len(a), "n_b": len(b), "n_groups": groups, "groups_sha256": digest})
                pairs.append(linked)
            if size >= block:
                number += 1
                rows += _block(number, texts, pairs)
                texts, pairs, size = [], [], 0
            if rows:
                yield _batch(rows, schema)
        if texts:
            yield _batch(_block(number + 1, texts, pairs), schema)

    return run


def _chunks(block: int, doc_id: int | None, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, longest: int) -> list[dict]:
    """The tokens that end in each byte range of a long text; ``start`` is how far A's are ahead of B's where they begin."""
    count = int(-(-a_ends[-1] // longest))
    borders = longest * np.arange(count + 1)
    cuts = [np.searchsorted(e, borders, side="right") for e in (a_ends, b_ends)]
    reached = [np.concatenate([[0], e])[c] for e, c in zip((a_ends, b_ends), cuts, strict=True)]
    return [
        {
            "kind": "chunk", "block": block, "doc_id": doc_id, "chunk": k, "n_chunks": count, "start": int(reached[0][k] - reached[1][k]),
            "a": a[cuts[0][k] : cuts[0][k + 1]], "b": b[cuts[1][k] : cuts[1][k + 1]],
        }
        for k in range(count)
    ]


def _row(key: dict, fragment: Fragment) -> dict:
    (head_a, head_b), (tail_a, tail_b) = fragment.head, fragment.tail
    return key | {
        "cut": fragment.cut, "groups": fragment.groups, "text": fragment.text, "pairs": fragment.pairs.tobytes(),
        "head_a": head_a, "head_b": head_b, "tail_a": tail_a, "tail_b": tail_b,
    }


def _fragment(row: dict) -> Fragment:
    ids = lambda name: np.array(row[name], np.int64)
    return Fragment((ids("head_a"), ids("head_b")), row["cut"], row["groups"], row["text"], np.frombuffer(row["pairs"], np.int64), (ids("tail_a"), ids("tail_b")))


def _fragments(vocabularies: Vocabularies) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From chunks to their fragments."""
    schema = _schema(_PART)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = (_lengths(t) for t in vocabularies.load()[2:4])
        for batch in pieces(batches, 50):
            rows = []
            for row in batch.to_pylist():
                a, b = np.array(row["a"], np.int64), np.array(row["b"], np.int64)
                parts = a, b, np.cumsum(a_size[a]) + row["start"], np.cumsum(b_size[b])
                key = {"block": row["block"], "doc_id": row["doc_id"], "chunk": row["chunk"], "n_a": len(a), "n_b": len(b)}
                rows.append(_row(key, Fragment.of(*parts)))
            yield _batch(rows, schema)

    return run


def _composed(vocabularies: Vocabularies, fan_in: int) -> Callable[[pa.Table], pa.Table]:
    """From at most ``fan_in`` neighbouring fragments of a text to one."""
    schema = _schema(_PART)

    def run(table: pa.Table) -> pa.Table:
        sizes = tuple(_lengths(t) for t in vocabularies.load()[2:4])
        rows = table.sort_by("chunk").to_pylist()
        whole = _fragment(rows[0])
        for row in rows[1:]:
            whole = whole.then(_fragment(row), sizes)
        key = {"block": rows[0]["block"], "doc_id": rows[0]["doc_id"], "chunk": rows[0]["chunk"] // fan_in}
        key |= {n: sum(r[n] for r in rows) for n in ("n_a", "n_b")}
        return pa.Table.from_pylist([_row(key, whole)], schema=schema)

    return run


def _finished(vocabularies: Vocabularies) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the one fragment of a long text to its row and dictionary; it is a block of its own."""
    schema = _schema(_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tuple(_lengths(t) for t in vocabularies.load()[2:4])
        for batch in pieces(batches, 20):
            rows = []
            for row in batch.to_pylist():
                groups, written, linked = _fragment(row).finished(sizes)
                found = {n: row[n] for n in ("doc_id", "n_a", "n_b")} | {"n_groups": groups, "groups_sha256": hashlib.sha256(written[:-1]).hexdigest()}
                rows += _block(row["block"], [found], [linked])
            if rows:
                yield _batch(rows, schema)

    return run


def _aligned(documents: DataFrame, vocabularies: Vocabularies, scratch: Scratch, chunk: int, fan_in: int, block: int) -> DataFrame:
    """Texts and dictionaries of all blocks."""
    texts = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    with settings(documents.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(AT_ONCE)}):
        first = scratch.write(texts.mapInArrow(_aligner(vocabularies, chunk, block), _ROWS), "aligned")
    chunks = first.where("kind = 'chunk'")
    longest = chunks.agg(F.max("n_chunks")).first()[0]
    if longest is None:
        return first
    # Chunks of one text go to different tasks.
    parts = chunks.select("block", "doc_id", "chunk", "start", "a", "b").repartition("block", "chunk").mapInArrow(_fragments(vocabularies), _PART)
    while longest > 1:
        parts = parts.groupBy("block", F.expr(f"chunk div {fan_in}")).applyInArrow(_composed(vocabularies, fan_in), _PART)
        longest = -(-longest // fan_in)
    long = scratch.write(parts.mapInArrow(_finished(vocabularies), _ROWS), "long")
    return first.where("kind <> 'chunk'").unionByName(long)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of the corpus that hold an id pair, and whether no other pair of its B id has more."""
    entries = aligned.where("kind = 'dictionary'").select(F.explode(F.arrays_zip("pairs", "counts")).alias("e"))
    counts = entries.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.counts").alias("n"))
    # At most as many rows as A has ids share a B id.
    most = F.max("n").over(Window.partitionBy(F.col("pair") % WIDTH))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def _scored(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts, each block's counts before them, to texts with sums over their links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = best = np.zeros(0, np.int64)
        for batch in pieces(batches, 200):
            out = []
            for row in batch.to_pylist():
                if row["totals"] is not None:
                    totals, best = np.array(row["totals"], np.int64), np.array(row["best"], np.int64)
                    continue
                sums = {"n_best": 0, "count_sum": 0}
                if row["places"] is not None:
                    places, times = _numbers(row["places"]), _numbers(row["times"])
                    sums = {"n_best": int(best[places] @ times), "count_sum": int(totals[places] @ times)}
                out.append({n: row[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | sums)
            if out:
                yield _batch(out, schema)

    return run


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned(documents: DataFrame, folder: str = FOLDER, chunk: int = CHUNK, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """Tokens, groups and links of each row of ``documents``, and how usual its links are in the corpus.

    ``n_a`` and ``n_b`` count tokens, ``n_groups`` groups, ``n_links`` pairs of overlapping tokens;
    ``count_sum`` adds up the links of the corpus that hold the same id pair, and ``n_best`` counts
    links whose pair is the most frequent of its B id, ties included. ``groups_sha256`` digests
    the groups. Null and empty texts, and texts that a tokenizer does not give
    back byte for byte, have no tokens, zeros and an empty digest. Repeated rows and rows
    without an id count like others; other columns are not read; an empty table gives no rows.
    The tokenizers' files are read from ``folder`` by the driver and sent to the tasks.
    """
    vocabularies = Vocabularies.read(folder)
    scratch = Scratch(documents.sparkSession, "alignment")
    rows = _aligned(documents, vocabularies, scratch, chunk, fan_in, block)
    counts = scratch.write(pair_counts(rows), "counts")
    places = rows.where("kind = 'dictionary'").select("block", F.posexplode("pairs").alias("place", "pair"))
    entry = F.sort_array(F.collect_list(F.struct("place", "n", "best")))  # as long as the block's dictionary
    looked_up = places.join(counts, "pair").groupBy("block").agg(entry.alias("e"))
    looked_up = looked_up.select("block", F.col("e.n").alias("totals"), F.col("e.best").cast("array<int>").alias("best"), F.lit(0).alias("order"))
    texts = rows.where("kind IN ('text', 'nothing')").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", F.lit(1).alias("order")
    )
    both = texts.unionByName(looked_up, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "order")
    return both.drop("block", "order").mapInArrow(_scored(_schema(_RESULT)), _RESULT)


def grouped(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``doc_id`` and ``groups`` of each row, an array of (a, b) id lists: the alignment itself, null without tokens."""
    vocabularies = Vocabularies.read(folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tuple(_lengths(t) for t in vocabularies.load()[2:4])
        for batch in pieces(batches, 100):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            coded = iter(_encoded([t for t in texts if t], vocabularies))
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                found, groups = next(coded) if text else None, None
                if found is not None:
                    ends = [np.cumsum(s[t]) for s, t in zip(sizes, found, strict=True)]
                    common = np.intersect1d(*ends, assume_unique=True)
                    split = [np.split(t, np.searchsorted(e, common[:-1], side="right")) for t, e in zip(found, ends, strict=True)]
                    groups = [{"a": a, "b": b} for a, b in zip(*split, strict=True)]
                rows.append({"doc_id": doc_id, "groups": groups})
            yield _batch(rows, schema)

    kinds = "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>"
    schema = _schema(kinds)
    return documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text")).mapInArrow(run, kinds)
