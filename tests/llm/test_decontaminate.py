"""Test phrases in documents against a plain search."""

import hashlib
import random

import numpy as np
from corpus import ALNUM, MIDDLE, documents, lower, odd_rows, table

from matchlake.llm import decontaminate


def brute(rows, items, window=10):
    phrases = {}
    for item_id, text in items:
        words = ALNUM.findall(lower(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            phrases.setdefault(tuple(words[k : k + size]), set()).add(item_id)
    found = []
    for doc_id, text in rows:
        words, hit, names = ALNUM.findall(lower(text)), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(words) - size + 1):
                if owners := phrases.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    names |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        found.append((doc_id, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(found, key=str)


def result(found):
    return sorted((tuple(r)[:6] for r in decontaminate.summary(found).collect()), key=str)


def test_whole_tables(spark):
    docs, items = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "benchmark")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = [(r.item_id, r.text) for r in items.collect()]
    assert result(decontaminate.contamination(docs, items)) == brute(rows, pairs)


def test_small_shards_and_blocks(spark):
    """Short items, repeats, and words that few letters make; many shards and passes."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cd e") for _ in range(n)) + " " + " ".join(rng.choice(["ab", "cd", "e", "x-y"]) for _ in range(n))
    rows = [(k, text(rng.randrange(0, 60))) for k in range(60)] + [(3, "ab cd")]
    items = [(k, text(rng.randrange(0, 12))) for k in range(30)] + [(99, "Cd"), (100, None), (101, "..."), (5, "e e")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(rows, items, 5)
    assert result(decontaminate.contamination(docs, bench, window=5)) == expected
    assert result(decontaminate.contamination(docs, bench, window=5, shard_symbols=50, block_phrases=20)) == expected


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark, odd_rows())
    items = [(1, "same text here for ties"), (2, None), (3, ""), (None, "no id at"), (4, "straße i")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.summary(decontaminate.contamination(docs, bench)).collect()
    assert len(found) == len(odd_rows())
    assert {r.doc_id for r in found if r.contaminated} == {6, 7, None}
    unnamed = next(r for r in found if r.doc_id is None and r.contaminated)
    assert (unnamed.n_hit, unnamed.n_items) == (3, 0)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.summary(decontaminate.contamination(docs, none)).collect())
    assert decontaminate.contamination(documents(spark, []), bench).collect() == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for alphabet, size in ((2, 50), (3, 400), (40, 1500)):
        symbols = rng.integers(0, alphabet, size).astype(np.int32)
        symbols[-1] = 0
        index = decontaminate.FMIndex(symbols, alphabet)
        whole = symbols.tolist()
        for length in (1, 2, 3):
            phrases = rng.integers(1, alphabet, (20, length))
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases.tolist(), low, high, strict=True):
                places = [k for k in range(size) if whole[k : k + length] == phrase]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_suffixes_are_sorted():
    symbols = np.array([1, 2, 1, 2, 1, 0, 1, 2, 1, 0])
    order = decontaminate.suffix_order(symbols)
    assert sorted(order.tolist()) == list(range(10))
    # Separators come first, by place; a repeat is ordered by the separator behind it.
    assert order.tolist()[:2] == [5, 9]
    assert order.tolist().index(0) > order.tolist().index(2)
