"""Personal data found by patterns and by a semi-Markov conditional random field.

The patterns give base spans, which always stay. The random field reads stretches of text
that hold digits or an at sign as sequences of atoms (digit runs, letter runs, single
symbols). Each candidate segment of up to ``MOST_ATOMS`` atoms is scored by features of the whole
segment, and dynamic programming over segments chooses boundaries and types together, over a whole stretch
of any length. Its
weights are fitted by gradient steps on the conditional likelihood of the base spans of a
bounded sample, with some numbers also shown without their country code, so it adds
what resembles them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, thinned

KINDS = ("email", "ip", "card", "phone")
#: Documents looked at for fitting, about, and stretches taken from them, at most.
SAMPLE_DOCS, SAMPLE_STRETCHES = 16_000, 600
EPOCHS, RATE, DECAY = 4, 0.3, 1e-4
#: Characters of a stretch that is fitted on; a longer one is shown in pieces, where possible cut at spaces.
MOST_CHARS = 256
#: Atoms of a segment.
MOST_ATOMS = 16

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_WORD = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with the run before it and the domain behind it, leftmost first."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    found: list[Span] = [(0, *span) for span in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """Runs of words that all hold a digit or an at sign, with one space between them."""
    done = 0
    while trigger := _TRIGGER.search(text, done):
        start = trigger.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = _WORD.match(text, start).end()
        while text[end : end + 1] == " " and (word := _WORD.match(text, end + 1)):
            if not _TRIGGER.search(word[0]):
                break
            end = word.end()
        yield start, text[start:end]
        done = end


def _examples(text: str) -> Iterator[str]:
    """Stretches to fit on, long ones in pieces."""
    for _, stretch in stretches(text):
        start = 0
        while len(stretch) - start > MOST_CHARS:
            cut = stretch.rfind(" ", start + 1, start + MOST_CHARS)
            cut = cut if cut > start else start + MOST_CHARS
            yield stretch[start:cut]
            start = cut
        yield stretch[start:]


class Stretch:
    """Atoms of a stretch of text, and its candidate segments with their features."""

    def __init__(self, text: str, start: int = 0):
        self.text, self.start = text, start
        self.starts, self.stops = array("q"), array("q")
        for m in _ATOM.finditer(text):
            self.starts.append(m.start())
            self.stops.append(m.end())

    def ending(self, j: int) -> Iterator[tuple[int, tuple[str, ...]]]:
        """First atom and features of the candidate segments that end before atom ``j``."""
        text, last = self.text, self.stops[j - 1]
        if not text[last - 1].isalnum():
            return
        low = max(0, j - MOST_ATOMS)
        # A digit or at sign begins its atom.
        trigger = next((k for k in range(j - 1, low - 1, -1) if _TRIGGER.match(text, self.starts[k])), -1)
        for i in range(low, trigger + 1):
            first = self.starts[i]
            if text[first].isalnum() or text[first] in "+(":
                yield i, self._features(first, last, j - i)

    @functools.cached_property
    def segments(self) -> dict[tuple[int, int], tuple[str, ...]]:
        """Features of all candidate segments, which only fitting holds at once."""
        return {(i, j): features for j in range(1, len(self.starts) + 1) for i, features in self.ending(j)}

    def _features(self, first: int, last: int, atoms: int) -> tuple[str, ...]:
        """What the whole segment looks like."""
        text = self.text
        piece = text[first:last]
        digits = _digits(piece)
        symbols = "".join(sorted({"a" if c.isalpha() else "0" if c.isdigit() else c for c in piece}))
        dots, ats = piece.count("."), piece.count("@")
        before = text[first - 1] if first else " "
        after = text[last] if last < len(text) else " "
        side = lambda c: "w" if c.isalnum() else "_" if c.isspace() else c
        features = [
            "bias",
            f"symbols={symbols if len(symbols) < 6 else 'many'}",
            f"digits={min(len(digits), 20)}",
            f"dots={min(dots, 4)}",
            f"ats={min(ats, 2)}",
            f"atoms={min(atoms, 12)}",
            f"before={side(before)}",
            f"after={side(after)}",
            f"first={'0' if piece[0].isdigit() else 'a' if piece[0].isalpha() else piece[0]}",
        ]
        if not symbols.strip("0 -"):
            features.append(f"luhn={13 <= len(digits) <= 19 and luhn(digits)}")
        if ats == 1:
            domain = piece.rpartition("@")[2]
            features.append(f"domain={'.' in domain.strip('.') and domain[-1].isalpha()},{before in _LOCAL},{after.isalnum() or after == '-'}")
        if dots == 3 and not symbols.strip("0."):
            features.append(f"parts={all(p and len(p) <= 3 and int(p) <= 255 for p in piece.split('.'))}")
        return tuple(features)


class Field:
    """Weights of segment features by kind, of single outside atoms, and of neighbours."""

    def __init__(self) -> None:
        self.weights: list[dict[str, float]] = [{} for _ in KINDS]
        self.follows = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def score(self, kind: int, features: tuple[str, ...]) -> float:
        weights = self.weights[kind]
        return sum(weights.get(f, 0.0) for f in features)

    def _scored(self, stretch: Stretch) -> list[list[tuple[int, int, float]]]:
        """By end: (start, kind, score) of the segments; the last kind is an outside atom."""
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(stretch.starts) + 1)]
        for (i, j), features in stretch.segments.items():
            for kind in range(len(KINDS)):
                ends[j].append((i, kind, self.score(kind, features)))
        for j in range(1, len(ends)):
            ends[j].append((j - 1, len(KINDS), 0.0))
        return ends

    def decode(self, stretch: Stretch) -> list[Span]:
        """The best segmentation's spans, placed in the whole text.

        Scores are held for the last ``MOST_ATOMS`` ends; of all others only the way back, a byte each.
        """
        outside, count, size = len(KINDS), len(KINDS) + 1, len(stretch.starts)
        recent = deque([[-math.inf] * outside + [0.0]], maxlen=MOST_ATOMS)
        back = bytearray(count)
        follows = self.follows.tolist()
        for j in range(1, size + 1):
            best, way = [-math.inf] * count, bytearray(count)

            def reach(i: int, kind: int, score: float, j: int = j, best: list[float] = best, way: bytearray = way) -> None:
                for before, so_far in enumerate(recent[i - j]):
                    value = so_far + follows[before][kind] + score
                    if value > best[kind]:
                        best[kind], way[kind] = value, (j - i) * count + before

            for i, features in stretch.ending(j):
                for kind in range(outside):
                    reach(i, kind, self.score(kind, features))
            reach(j - 1, outside, 0.0)
            recent.append(best)
            back += way
        spans: list[Span] = []
        at, kind = size, max(range(count), key=lambda k: recent[-1][k])
        while at:
            atoms, before = divmod(back[at * count + kind], count)
            if kind < outside:
                spans.append((kind, stretch.start + stretch.starts[at - atoms], stretch.start + stretch.stops[at - 1]))
            at, kind = at - atoms, before
        return spans[::-1]

    def learn(self, stretch: Stretch, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of ``gold``: (first atom, end atom, kind)."""
        outside, count = len(KINDS), len(KINDS) + 1
        ends = self._scored(stretch)
        size = len(ends) - 1
        forward = np.full((size + 1, count), -np.inf)
        forward[0, outside] = 0.0
        for j in range(1, size + 1):
            for i, kind, score in ends[j]:
                value = np.logaddexp.reduce(forward[i] + self.follows[:, kind]) + score
                forward[j, kind] = np.logaddexp(forward[j, kind], value)
        backward = np.full((size + 1, count), -np.inf)
        backward[size] = 0.0
        for j in range(size, 0, -1):
            for i, kind, score in ends[j]:
                backward[i] = np.logaddexp(backward[i], self.follows[:, kind] + score + backward[j, kind])
        total = np.logaddexp.reduce(forward[size])
        change = np.zeros_like(self.follows)
        covered = {k for i, j, _ in gold for k in range(i, j)}
        truth = {(i, j): kind for i, j, kind in gold}
        path = sorted([(i, j, k) for i, j, k in gold] + [(k, k + 1, outside) for k in range(size) if k not in covered])
        for (_, _, a), (_, _, b) in zip([(0, 0, outside), *path], path, strict=False):
            change[a, b] += 1
        for j in range(1, size + 1):
            for i, kind, score in ends[j]:
                through = forward[i] + self.follows[:, kind] + (score + backward[j, kind] - total)
                shares = np.exp(np.minimum(through, 0))
                change[:, kind] -= shares
                if kind < outside:
                    step = (truth.get((i, j)) == kind) - float(shares.sum())
                    if abs(step) > 1e-4:
                        weights = self.weights[kind]
                        for f in stretch.segments[i, j]:
                            weights[f] = weights.get(f, 0.0) * (1 - rate * DECAY) + rate * step
        self.follows += rate * change * 0.2


def _gold(stretch: Stretch, spans: list[Span]) -> set[tuple[int, int, int]]:
    """Base spans as atoms; of overlapping ones the first stays."""
    starts = {a: k for k, a in enumerate(stretch.starts)}
    stops = {b: k + 1 for k, b in enumerate(stretch.stops)}
    found: set[tuple[int, int, int]] = set()
    taken: set[int] = set()
    for kind, start, end in spans:
        i, j = starts.get(start), stops.get(end)
        if i is None or j is None or j - i > MOST_ATOMS or taken & set(range(i, j)) or (i, j) not in stretch.segments:
            continue
        taken |= set(range(i, j))
        found.add((i, j, kind))
    return found


def fit(texts: Iterable[str]) -> Field:
    """Weights from the base spans of these texts, for at most ``SAMPLE_STRETCHES`` stretches."""
    examples: dict[str, list[Span]] = {}
    for text in texts:
        for piece in _examples(text):
            examples.setdefault(piece, base_spans(piece))
    order = sorted(examples, key=lambda t: hashlib.sha256(t.encode("utf-8", "replace")).digest())
    with_spans = [t for t in order if examples[t]][: SAMPLE_STRETCHES * 2 // 3]
    without = [t for t in order if not examples[t]][: SAMPLE_STRETCHES // 3]
    data = []
    for k, text in enumerate(with_spans + without):
        spans = examples[text]
        data.append((stretch := Stretch(text), _gold(stretch, spans)))
        # A number in brackets is as private without its country code.
        if k % 3 == 0 and len(spans) == 1 and spans[0][0] == 3 and "(" in text[spans[0][1] : spans[0][2]]:
            cut = text.index("(", spans[0][1])
            local = Stretch(text[cut:])
            data.append((local, _gold(local, [(3, 0, spans[0][2] - cut)])))
    field, random = Field(), np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for k in random.permutation(len(data)):
            field.learn(*data[k], RATE / (1 + epoch))
    return field


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind, then start."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    spans = list(base)
    # Base spans of several kinds may overlap; together they are disjoint stretches in order.
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(base, key=lambda b: b[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for start, piece in stretches(text):
        for span in field.decode(Stretch(piece, start)):
            near = bisect_left(starts, span[2]) - 1
            if near < 0 or ends[near] <= span[1]:
                spans.append(span)
    return base, sorted(spans)


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def train(documents: DataFrame) -> Field:
    """Weights from a bounded sample of documents, chosen by a hash of their text."""
    rows = documents.select(F.col("`text`").cast("string").alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    rank = F.xxhash64("text")
    thin = rows.where(thinned("text", share)).where(F.length("text") < 20_000)
    found = thin.where(F.col("text").rlike("[0-9@]")).orderBy(rank).limit(SAMPLE_DOCS)
    return fit(row[0] for row in found.toLocalIterator())


_FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
)


def personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Spans of personal data in each row of ``documents``.

    Returns ``doc_id``, the number of base spans of each kind, the SHA-256 of the base spans and
    all spans as ``kind:start:end`` in code points, the end exclusive. A null or empty text has
    none; rows without an id and repeated rows are each returned; no other column is read.
    """
    field = field or train(documents)
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, digests, all_spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, spans = find(text, sent.value)
                for kind in range(len(KINDS)):
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_text(base).encode()).hexdigest())
                all_spans.append(_text(spans))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(all_spans)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def masked(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    spans = sorted(find(text, field)[1], key=lambda s: (s[1], -s[2]))
    parts, done, end = [], 0, -1
    for kind, start, stop in spans:
        if start < end:
            end = max(end, stop)
            done = end
            continue
        parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end = stop
    return "".join([*parts, text[done:]]) if parts else text


def redacted(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with personal data masked; ``n_chars`` follows the text, other columns stay."""
    field = field or train(documents)
    sent = documents.sparkSession.sparkContext.broadcast(field)
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = functools.partial(masked, field=sent.value)
        for batch in pieces(batches):
            column = batch.column(at)
            yield batch.set_column(at, batch.schema.field(at), pa.array(map(mask, column.to_pylist()), column.type))

    done = documents.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return done
