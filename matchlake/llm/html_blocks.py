"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, each
with the path of tags (and their class and id words) that holds it. A block is read as
a vector of hashed path words, hashed text words and a few measures. A bidirectional
LSTM runs over all blocks of the page, so every block is labelled with the whole document in
view. It is trained by gradient steps on a bounded sample of pages, whose blocks are labelled by
what their markup says. Each is also shown in another layout, its texts put in containers
that other sites use, and telling tags are hidden at random, so that names, position,
wording and neighbours are all learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thinned

#: Pages that the weights are fitted on, about, and passes over them.
SAMPLE_PAGES, EPOCHS, RATE = 300, 6, 0.02
#: Hashed path words, hashed text words, measures; width of each direction's state.
PATHS, WORDS, MEASURES, WIDTH = 128, 32, 8, 16
#: Share of training pages whose telling tags are hidden.
HIDDEN = 0.15
#: Blocks read at a time; in a longer page the states pass from piece to piece.
PIECE = 2048

#: Tags of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template iframe svg canvas audio video textarea button select".split())
#: A tag that opens ends an open one of these.
ENDS_P = BLOCK_TAGS - {"option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
MAIN_WORDS = frozenset("article main content post entry story body text h1".split())
SIDE_WORDS = frozenset(
    "nav header footer aside menu sidebar ad ads advert advertisement banner notice cookie consent form comment comments reply "
    "replies respond social share related promo sponsor sponsored breadcrumb breadcrumbs pager pagination widget newsletter "
    "subscribe popup modal legal copyright title head".split()
)
#: Containers of pages, as tag and class. The empty tag is no container.
MAIN_BOXES = (
    ("article", ""), ("main", ""), ("div", "main-content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"),
    ("div", "article text"), ("div", "content"), ("div", "post"), ("", ""),
)
SIDE_BOXES = {
    "menu": (("nav", ""), ("div", "menu"), ("ul", "nav-list"), ("div", "breadcrumbs"), ("div", "top-menu navigation")),
    "header": (("header", ""), ("div", "header"), ("div", "site-header masthead"), ("div", "banner top")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer legal"), ("div", "copyright")),
    "sidebar": (("aside", ""), ("div", "sidebar"), ("div", "related widget"), ("div", "promo")),
    "notice": (("div", "cookie-notice"), ("div", "consent popup"), ("div", "notice"), ("section", "banner alert")),
    "advert": (("div", "ad"), ("div", "advert"), ("div", "sponsored"), ("aside", "advertisement")),
    "comments": (("div", "comments"), ("section", "comment-list"), ("ol", "replies"), ("div", "comment"), ("section", "responses")),
    "form": (("form", ""), ("div", "newsletter subscribe"), ("form", "search"), ("div", "login form")),
}
_MARK = "\ue000"
_NAME = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its path's words, and its text with white space made single."""

    __slots__ = ("links", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, links: int):
        self.path, self.text, self.links = path, text, links


class BlockParser(HTMLParser):
    """Splits a page into leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.links = self.silent = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(w for _, words in self.open for w in words)
            self.blocks.append(Block(path, text, self.links))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCK_TAGS:
            self._flush()
            if tag in ENDS_P:
                self._close_open("p", "li" if tag == "li" else None)
        names = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                names += [f".{w}" for w in _NAME.findall(value.lower())]
        self.open.append((tag, tuple(names)))
        self.silent += tag in SILENT_TAGS

    def _close_open(self, *tags: str | None) -> None:
        """Close an open paragraph, with the inline tags in it, before a block begins."""
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in tags:
                for gone, _ in self.open[k:]:
                    self.silent -= gone in SILENT_TAGS
                del self.open[k:]
                return
            if tag in BLOCK_TAGS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for gone, _ in self.open[k:]:
                    self.silent -= gone in SILENT_TAGS
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.silent == 0:
            self.parts.append(data)
            if self.open and self.open[-1][0] == "a":
                self.links += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.blocks


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def features(blocks: list[Block], hidden: bool = False, first: int = 0, count: int | None = None) -> np.ndarray:
    """A row for each block: hashed path, all hashed words, measures.

    The blocks may be a part of their page, which has ``count`` blocks, from block ``first`` on.
    """
    count = count or len(blocks)
    table = np.zeros((len(blocks), PATHS + WORDS + MEASURES), np.float32)
    slots: dict[tuple[str, ...], list[int]] = {}
    for k, block in enumerate(blocks):
        if block.path not in slots:
            words = [w for w in block.path if not hidden or w.lstrip(".") not in MAIN_WORDS | SIDE_WORDS]
            slots[block.path] = [_slot(w, PATHS) for w in words]
        for at in slots[block.path]:
            table[k, at] = 1
        words = block.text.lower().encode("utf-8", "replace").split(b" ")
        table[k, PATHS : PATHS + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS) / len(words)
        size = len(block.text)
        stops = sum(block.text.count(c) for c in ".,;!?")
        table[k, PATHS + WORDS :] = (
            1, np.log1p(size) / 8, block.links / size, min(1, 10 * stops / size), block.text[-1] in ".!?", "\xa9" in block.text,
            (first + k) / count, 1 - (first + k + 1) / count,
        )
    return table


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 where the markup says main text, 0 where it says otherwise; the nearest saying counts."""
    labels = np.zeros(len(blocks))
    for k, block in enumerate(blocks):
        for word in reversed(block.path):
            name = word.lstrip(".")
            if name in SIDE_WORDS:
                break
            if name in MAIN_WORDS and word not in ("body", ".body"):
                labels[k] = 1
                break
    return labels


def relaid(main: list[str], side: list[str], other: list[str], random: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a page in a random layout.

    ``main`` becomes its article, ``side`` its short texts; ``other``, main text of another
    page, becomes comments and sidebars, so that wording alone does not decide.
    """
    def pick(texts: list[str], most: int) -> list[str]:
        return [texts[k] for k in random.integers(0, len(texts), random.integers(1, most + 1))] if texts else []

    def box(tag: str, name: str, inner: str) -> str:
        attribute = f' {random.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>" if tag else inner

    def part(kind: str) -> str:
        tag, name = SIDE_BOXES[kind][random.integers(len(SIDE_BOXES[kind]))]
        texts = pick(other if kind in ("comments", "sidebar") and random.random() < 0.7 else side, 4)
        inside = random.choice(["p", "li", "div", "span"])
        linked = random.random() < 0.5 if kind in ("menu", "sidebar") else random.random() < 0.1
        return box(tag, name, "".join(f"<{inside}>{f'<a>{escape(t)}</a>' if linked else escape(t)}</{inside}>" for t in texts))

    present = {kind for kind in SIDE_BOXES if random.random() < 0.5}
    tag, name = MAIN_BOXES[random.integers(len(MAIN_BOXES))]
    first = "".join(f"<h1>{_MARK}{escape(t)}</h1>" for t in main[:1]) if random.random() < 0.8 else ""
    rest = [f"<p>{_MARK}{escape(t)}</p>" for t in main[1 if first else 0 :]]
    if rest and random.random() < 0.3:
        rest.insert(int(random.integers(len(rest))), part(random.choice(["advert", "notice", "sidebar"])))
    body = [part(k) for k in ("notice", "header", "menu") if k in present]
    body.append(box(tag, name, first + "".join(rest)))
    body += [part(k) for k in ("advert", "form", "comments", "sidebar", "footer") if k in present]
    if random.random() < 0.5:
        body = [box("div", str(random.choice(["wrapper", "page", "container", "site"])), "".join(body))]
    title = f"<title>{escape(main[0][:60])}</title>" if main else ""
    blocks = blocks_of(f"<html><head>{title}</head><body>{''.join(body)}</body></html>" if random.random() < 0.9 else "".join(body))
    labels = np.array([float(_MARK in b.text) for b in blocks])
    for block in blocks:
        block.text = block.text.replace(_MARK, "") or "-"
    return blocks, labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction of the labeller; sequences are rows of a batch, padded at the end."""

    def __init__(self, random: np.random.Generator, inputs: int, width: int):
        self.width = width
        self.weights = random.normal(0, 0.15, (inputs + width, 4 * width)).astype(np.float32)
        self.bias = np.zeros(4 * width, np.float32)
        self.bias[width : 2 * width] = 1

    def run(self, table: np.ndarray, alive: np.ndarray, keep: bool = False, carried: list | None = None) -> tuple[np.ndarray, list]:
        """States after each step; where ``alive`` is 0 the state stays.

        ``carried`` holds the state to begin with, if any, and then the last one.
        """
        batch, steps, inputs = table.shape
        w = self.width
        into = table @ self.weights[:inputs] + self.bias
        h, c = carried or (np.zeros((batch, w), np.float32),) * 2
        out, tape = np.zeros((batch, steps, w), np.float32), []
        for t in range(steps):
            gates = into[:, t] + h @ self.weights[inputs:]
            i, f, o = (_sigmoid(gates[:, k * w : (k + 1) * w]) for k in (0, 1, 2))
            g = np.tanh(gates[:, 3 * w :])
            m = alive[:, t, None]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            if keep:
                tape.append((h, c, i, f, o, g, squashed, m))
            h, c = m * (o * squashed) + (1 - m) * h, m * fresh + (1 - m) * c
            out[:, t] = h
        if carried is not None:
            carried[:] = h, c
        return out, tape

    def back(self, table: np.ndarray, tape: list, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of weights and bias for the gradients of the states."""
        inputs, w = table.shape[2], self.width
        weights, bias = np.zeros_like(self.weights), np.zeros_like(self.bias)
        dh = dc = np.zeros((len(table), w), np.float32)
        for t in range(table.shape[1] - 1, -1, -1):
            h, c, i, f, o, g, squashed, m = tape[t]
            dh = dh + change[:, t]
            own, own_c = dh * m, dc * m
            inner = own_c + own * o * (1 - squashed**2)
            gates = np.hstack([inner * g * i * (1 - i), inner * c * f * (1 - f), own * squashed * o * (1 - o), inner * i * (1 - g**2)])
            weights[:inputs] += table[:, t].T @ gates
            weights[inputs:] += h.T @ gates
            bias += gates.sum(axis=0)
            dh = gates @ self.weights[inputs:].T + dh * (1 - m)
            dc = inner * f + dc * (1 - m)
        return weights, bias


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        inputs = PATHS + WORDS + MEASURES
        self.sides = (Lstm(random, inputs, WIDTH), Lstm(random, inputs, WIDTH))
        self.output = random.normal(0, 0.15, 2 * WIDTH + 1).astype(np.float32)

    @staticmethod
    def _padded(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(t) for t in tables)
        stack = np.zeros((len(tables), steps, tables[0].shape[1]), np.float32)
        alive = np.zeros((len(tables), steps), np.float32)
        for k, table in enumerate(tables):
            stack[k, : len(table)], alive[k, : len(table)] = table, 1
        return stack, alive

    def _states(self, stack: np.ndarray, alive: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        ahead, tape = self.sides[0].run(stack, alive, keep)
        behind, other = self.sides[1].run(stack[:, ::-1], alive[:, ::-1], keep)
        ones = np.ones((*alive.shape, 1), np.float32)
        return np.concatenate([ahead, behind[:, ::-1], ones], axis=2), [tape, other]

    def chances(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        stack, alive = self._padded(tables)
        states, _ = self._states(stack, alive)
        chance = _sigmoid(states @ self.output)
        return [chance[k, : len(table)] for k, table in enumerate(tables)]

    def long_chances(self, blocks: list[Block]) -> np.ndarray:
        """Probability of main text for each block of one page, read in pieces from both ends.

        Of the whole page only one number a block is held beside the blocks.
        """
        ahead, behind = self.sides
        inner = np.full(len(blocks), self.output[-1])
        parts = _pieces(blocks)
        for side, output, order, turn in ((ahead, self.output[:WIDTH], parts, 1), (behind, self.output[WIDTH : 2 * WIDTH], parts[::-1], -1)):
            carried: list[np.ndarray] = []
            for first, last, _, _ in order:
                table = features(blocks[first:last], first=first, count=len(blocks))[None, ::turn]
                states, _ = side.run(table, np.ones(table.shape[:2], np.float32), carried=carried)
                inner[first:last] += states[0, ::turn] @ output
        return _sigmoid(inner)

    def learn(self, tables: list[np.ndarray], labels: list[np.ndarray], moments: dict, step: int) -> None:
        """One Adam step on the cross entropy of a batch of pages."""
        stack, alive = self._padded(tables)
        truth = np.zeros_like(alive)
        for k, label in enumerate(labels):
            truth[k, : len(label)] = label
        states, tapes = self._states(stack, alive, keep=True)
        error = (_sigmoid(states @ self.output) - truth) * alive / alive.sum()
        gradients = {"output": np.einsum("bt,btw->w", error, states)}
        change = error[:, :, None] * self.output[None, None, :]
        gradients["w0"], gradients["b0"] = self.sides[0].back(stack, tapes[0], change[:, :, :WIDTH])
        gradients["w1"], gradients["b1"] = self.sides[1].back(stack[:, ::-1], tapes[1], change[:, ::-1, WIDTH : 2 * WIDTH])
        held = {"output": self.output, "w0": self.sides[0].weights, "b0": self.sides[0].bias, "w1": self.sides[1].weights, "b1": self.sides[1].bias}
        for name, gradient in gradients.items():
            gradient = np.clip(gradient, -1, 1)
            first, second = moments.setdefault(name, (np.zeros_like(gradient), np.zeros_like(gradient)))
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            moments[name] = (first, second)
            held[name] -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)


def fit(pages: list[str]) -> Labeller:
    """A labeller trained on weak labels of these pages."""
    labeller, random = Labeller(), np.random.default_rng(3)
    data = [(b, weak_labels(b)) for b in (blocks_of(p)[:PIECE] for p in pages) if b]
    mains = [[b.text for b, y in zip(*page, strict=True) if y] for page in data]
    sides = [[b.text for b, y in zip(*page, strict=True) if not y] for page in data]
    for k in range(len(data)):
        blocks, labels = relaid(mains[k], sides[k], mains[k - 1], random)
        if blocks:
            data.append((blocks[:PIECE], labels[:PIECE]))
    data.sort(key=lambda page: len(page[0]))
    batches = [data[k : k + 16] for k in range(0, len(data), 16)]
    moments: dict = {}
    step = 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(batches)):
            step += 1
            tables = [features(b, hidden=random.random() < HIDDEN) for b, _ in batches[k]]
            labeller.learn(tables, [y for _, y in batches[k]], moments, step)
    return labeller


def train(pages: DataFrame) -> Labeller:
    """A labeller from a bounded sample of pages, chosen by a hash of their html."""
    rows = pages.select(F.col("`html`").cast("string").alias("html")).where("html IS NOT NULL")
    share = min(1.0, SAMPLE_PAGES / max(1, rows.count()))
    rank = F.xxhash64("html")
    thin = rows.where(thinned("html", share)).where(F.length("html") < 100_000)
    return fit([r[0] for r in thin.orderBy(rank).limit(2 * SAMPLE_PAGES).toLocalIterator()])


def _pieces(blocks: list[Block] | np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, first to use, last to use) of the pieces of a page."""
    return [(k, stop, k, stop) for k in range(0, len(blocks), PIECE) for stop in [min(len(blocks), k + PIECE)]]


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """Main text of each page: its main blocks in order, one on a line."""
    blocks = [blocks_of(html) for html in pages]
    chances = [labeller.long_chances(b) if len(b) > PIECE else np.zeros(0) for b in blocks]
    order = sorted((k for k, b in enumerate(blocks) if 0 < len(b) <= PIECE), key=lambda k: len(blocks[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        # The longest of a batch is its last.
        while stop < len(order) and (stop - at + 1) * len(blocks[order[stop]]) <= 16_384:
            stop += 1
        for k, chance in zip(order[at:stop], labeller.chances([features(blocks[k]) for k in order[at:stop]]), strict=True):
            chances[k] = chance
        at = stop
    return ["\n".join(b.text for b, c in zip(blocks[k], chances[k], strict=True) if c >= 0.5) for k in range(len(pages))]


def extracted(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row of ``pages``.

    A null or empty html has an empty text; pages are read whole; rows without an id or url and
    repeated rows are each returned; other columns are not read; an empty table gives no
    rows.
    """
    labeller = labeller or train(pages)
    sent = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = main_texts(batch.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col("`page_id`").cast("bigint").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
