"""Near-duplicates against all pairs."""

import random

import pytest
from corpus import MIDDLE, SPACED, documents, lower, odd_rows, table
from pyspark.sql import functions as F

from matchlake.llm import neardup


def brute(rows, length=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; ids are unique."""
    sets = {}
    for doc_id, text in rows:
        words = SPACED.findall(lower(text))
        size = min(length, len(words))
        sets[doc_id] = frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()
    ids = sorted(sets)
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, x in enumerate(ids):
        for y in ids[:a]:
            both, one = len(sets[x] & sets[y]), len(sets[x]) + len(sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (one - both):
                p, q = sorted((find(x), find(y)))
                least[q] = p
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_whole_table(spark):
    docs = table(spark, MIDDLE, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(neardup.near_duplicates(docs, 4, 80)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    """Large groups of copies with random edits, around the least similarity, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(120)]
    for doc_id in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = word()
        rows.append((doc_id, " ".join(words[: rng.choice([120, 120, 110, 100])])))
    for doc_id in range(200, 260):
        rows.append((doc_id, " ".join(passage + [word() for _ in range(rng.randrange(5, 80))])))
    rng.shuffle(rows)
    assert result(neardup.near_duplicates(documents(spark, rows), 4, 80)) == brute(rows)


def test_odd_rows(spark):
    found = neardup.near_duplicates(documents(spark, odd_rows()), 4, 80).collect()
    assert len(found) == len(odd_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert by_id[7].component_id == 6 and not by_id[7].kept and by_id[9].component_id == 8
    assert by_id[12].n_shingles == 1  # white space outside ASCII is part of a word
    assert sorted(r.n_shingles for r in found if r.doc_id is None) == [0, 2]
    kept = neardup.deduplicated(documents(spark, odd_rows()), 4, 80)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6, 8, 10, 11, 12]
    assert kept.columns == documents(spark, []).columns


def test_empty_table(spark):
    empty = documents(spark, [])
    assert neardup.near_duplicates(empty).collect() == []
    assert neardup.deduplicated(empty).collect() == []


def test_keys_are_tensored():
    """Tables pair signatures of two collections."""
    assert neardup.signatures(neardup.shingle_set(b"a b c d e", 4, neardup.WordHashes()), *neardup._parameters()).shape == (2 * neardup.SIDE,)
    miss = 2 * (1 - 0.8**neardup.ROWS) ** neardup.SIDE
    assert miss < 2e-4


def test_default_is_five_words(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f g")])
    assert [r.n_shingles for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [2, 3]
    assert neardup.near_duplicates(docs).where(F.col("kept")).count() == 2
