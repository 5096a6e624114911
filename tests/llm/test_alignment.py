"""Alignment against a token-by-token version, the composition of fragments, and odd tables."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import sentencepiece
from corpus import MIDDLE, documents, odd_rows, table
from tokenizers import Tokenizer

from matchlake.llm import alignment as al

PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in PRINTED} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in PRINTED)}


class Plain:
    """Both tokenizers by their own libraries, and the contract word for word."""

    def __init__(self):
        self.a = Tokenizer.from_file(f"{al.FOLDER}/{al.BYTE_LEVEL}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{al.FOLDER}/{al.PIECES}")

    def tokens(self, text):
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(coded.ids, coded.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", name)
            b.append((i, bytes.fromhex(byte[1]) if byte else name.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    def align(self, text):
        found = self.tokens(text) if text else None
        if found is None:
            return None
        spans = []
        for tokens in found:
            at, own = 0, []
            for i, data in tokens:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        common = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        written = []
        for own in spans:
            groups = [[]]
            for i, _, e in own:
                groups[-1].append(str(i))
                if e in common:
                    groups.append([])
            written.append([",".join(g) for g in groups[:-1]])
        text = ";".join(f"{a}|{b}" for a, b in zip(*written, strict=True))
        links, first = [], 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        return len(found[0]), len(found[1]), len(common), links, hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    plain = Plain()
    found = [(i, plain.align(t)) for i, t in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i, f in found:
        if f is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
        else:
            yield (i, *f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4])


ODD = [
    (50, "<|endoftext|> and <s> and </s> <unk>"), (51, "▁ is a space to one of them"), (52, "漢字 and 😀 é é"), (53, " lead and trail "),
    (54, "a\x00b\r\n\tc d e"), (55, "a" * 70_000 + " b" * 9_000), (56, "ﬁ Ａ ½ ²"),
]


def test_equals_plain_version(spark):
    rows = odd_rows() + ODD + [(r.doc_id, r.text) for r in table(spark, MIDDLE, "documents").collect()]
    found = al.aligned(documents(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected(rows))


def test_small_chunks_and_blocks_change_nothing(spark):
    rows = [r for r in odd_rows() + ODD if r[1] is None or len(r[1]) < 80_000]
    whole = Counter(tuple(r) for r in al.aligned(documents(spark, rows)).collect())
    in_trees = al.aligned(documents(spark, rows), chunk=300, fan_in=3, block=1_000)
    assert Counter(tuple(r) for r in in_trees.collect()) == whole


def test_composition_is_associative():
    vocabularies = al.Vocabularies.read()
    sizes = tuple(al._lengths(t) for t in vocabularies.load()[2:4])
    rng = random.Random(8)
    text = " ".join(rng.choice(["straightforward", "漢字", "x", "internationalisation", "<|endoftext|>", "\t\t", "3.14159"]) for _ in range(400))
    (a, b), = al._encoded([text], vocabularies)
    ends = [np.cumsum(s[t]) for s, t in zip(sizes, (a, b), strict=True)]
    whole = al.Fragment.of(a, b, *ends).finished(sizes)
    for _ in range(20):
        borders = sorted({0, int(ends[0][-1]), *(rng.randrange(int(ends[0][-1])) for _ in range(12))})
        parts = []
        for low, high in zip(borders, borders[1:], strict=False):
            own = [(e > low) & (e <= high) for e in ends]
            parts.append(al.Fragment.of(a[own[0]], b[own[1]], ends[0][own[0]], ends[1][own[1]]))
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], sizes)]
        groups, written, pairs = parts[0].finished(sizes)
        assert (groups, written, Counter(pairs.tolist())) == (whole[0], whole[1], Counter(whole[2].tolist()))


def test_groups_give_back_the_text(spark):
    rows = ODD + [(r.doc_id, r.text) for r in table(spark, MIDDLE, "documents").limit(30).collect()]
    a_bytes, b_bytes = al.Vocabularies.read().load()[2:4]
    texts = dict(rows)
    for r in al.grouped(documents(spark, rows)).collect():
        if r.groups is None:
            assert r.doc_id == 51
            continue
        assert all(b"".join(a_bytes[i] for i in g.a) == b"".join(b_bytes[i] for i in g.b) for g in r.groups)
        assert b"".join(a_bytes[i] for g in r.groups for i in g.a) == (" " + texts[r.doc_id]).encode()


def test_empty_table(spark):
    assert al.aligned(documents(spark, [])).collect() == []


def test_a_block_holds_little_more_than_its_links():
    rng = np.random.default_rng(4)
    pairs = [rng.integers(0, 500, 10_000) for _ in range(100)]
    texts = [{"doc_id": k} for k in range(len(pairs))]
    tracemalloc.start()
    *found, dictionary = al._block(7, texts, pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(p.nbytes for p in pairs)
    known, counts = np.unique(np.concatenate(pairs), return_counts=True)
    assert (dictionary["pairs"] == known).all() and (dictionary["counts"] == counts).all()
    for row, own in zip(found, pairs, strict=True):
        back = np.repeat(known[al._numbers(row["places"])], al._numbers(row["times"]))
        assert (back == np.sort(own)).all() and row["n_links"] == len(own)


def test_tasks_get_few_rows_at_once(spark):
    batches = spark.sparkContext.accumulator(0)

    def counted(given):
        for batch in given:
            batches.add(1)
            yield batch

    rows = documents(spark, [(k, "a b") for k in range(3 * al.AT_ONCE)]).coalesce(1)
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = al.aligned(rows.select("doc_id", "text").mapInArrow(counted, "doc_id bigint, text string"))
    assert batches.value == 3 and found.count() == 3 * al.AT_ONCE
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting
