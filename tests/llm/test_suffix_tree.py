"""Suffix tree: base and tree scores by brute force, distributions that add to one, held-out gain."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from corpus import MIDDLE, SPACED, documents, lower, odd_rows, table

from matchlake.llm import suffix_tree
from matchlake.llm.common import Scratch


def training(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def brute(rows):
    tokens = [(i, [*SPACED.findall(lower(t)), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if training(i) for w in ws)
    whole, distinct = sum(counts.values()), len(counts)
    score = lambda ws: sum(math.log10((counts[w] + 1) / (whole + distinct + 1)) for w in ws)
    return [(i, not training(i), len(ws), sum(counts[w] > 0 for w in ws), whole, score(ws)) for i, ws in tokens]


def check(found, rows):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    pairs = list(zip(sorted((tuple(r)[:6] for r in found), key=key), sorted(brute(rows), key=key), strict=True))
    for mine, theirs in pairs:
        assert mine[:5] == theirs[:5] and mine[5] == pytest.approx(theirs[5], abs=1e-6)


def test_whole_table(spark):
    docs = table(spark, MIDDLE, "documents")
    found = suffix_tree.score(docs).collect()
    check(found, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_tree(rows, context, transition, depth):
    """Probability of a token after others, by the definition: (distributions, kept contexts)."""
    texts = [["<", *SPACED.findall(lower(t)), ">"] for i, t in rows if training(i)]
    counts = Counter(w for t in texts for w in t[1:])
    size = sum(counts.values()) + len(counts) + 1
    follow = defaultdict(Counter)
    for t in texts:
        for d in range(1, depth + 1):
            for k in range(d, len(t)):
                follow[tuple(t[k - d : k])][t[k]] += 1
    kept = {}

    def chance(before, word, most):
        for d in range(min(most, len(before)), 0, -1):
            if before[-d:] in kept:
                gains, fall = kept[before[-d:]]
                return gains.get(word, 0.0) + fall * chance(before, word, d - 1)
        return (counts[word] + 1) / size

    tried = {(): True}
    for d in range(1, depth + 1):
        for c in sorted(x for x in follow if len(x) == d):
            total = sum(follow[c].values())
            if total < context or c[:-1] not in tried or (d > 1 and c[1:] not in kept):
                continue
            tried[c] = True
            listed = {w: n for w, n in follow[c].items() if n >= transition}
            fall = (total + suffix_tree.SMOOTH - sum(listed.values())) / (total + suffix_tree.SMOOTH)
            gains = {w: n / (total + suffix_tree.SMOOTH) for w, n in listed.items()}
            above = {w: chance(c, w, d - 1) for w in listed}
            mine = {w: gains[w] + fall * above[w] for w in listed}
            left, base = max(1 - sum(mine.values()), 1e-12), max(1 - sum(above.values()), 1e-12)
            divergence = sum(mine[w] * math.log(mine[w] / above[w]) for w in listed) + left * math.log(left / base)
            if listed and total * divergence > suffix_tree.KEEP * math.log(max(total, 2)):
                kept[c] = (gains, fall)
    return lambda before, word: chance(before, word, depth), kept, counts


def ordered_texts(rng, many):
    """Words that depend on the two before, among some that do not."""
    for _ in range(many):
        words = [rng.choice("abc") for _ in range(2)]
        for _ in range(60):
            after = "abc"["abc".index(words[-1]) - "abc".index(words[-2])] if set(words[-2:]) <= set("abc") else "a"
            words.append(after if rng.random() < 0.9 else rng.choice(["a", "b", "c", f"w{rng.randrange(40)}"]))
        yield " ".join(words)


@pytest.mark.parametrize("common", [4e-6, 0.02, 2.0])
def test_tree_by_brute_force(spark, monkeypatch, common):
    """Whatever is sent and whatever is joined, scores are those of the definition."""
    for name, value in (("CONTEXT", 20), ("TRANSITION", 3), ("COMMON", common), ("HELD", 50), ("HELD_GRAMS", 100)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = list(enumerate(ordered_texts(random.Random(3), 120)))
    rows += [(200, "a b never seen"), (201, ""), (202, None), (None, "a b c a b c"), (203, "c " * 400)]
    chance, kept, counts = brute_tree(rows, 20, 3, suffix_tree.DEPTH)
    assert max(map(len, kept)) >= 3
    # Each kept context's distribution adds to one, all unseen words being one.
    for before in kept:
        assert sum(chance(before, w) for w in [*counts, "unseen"]) == pytest.approx(1)
    found = suffix_tree.score(documents(spark, rows)).collect()
    check(found, rows)

    def whole(text):
        words = ["<", *SPACED.findall(lower(text)), ">"]
        return sum(math.log10(chance(tuple(words[:k]), words[k])) for k in range(1, len(words)))

    expected = {i: whole(t) for i, t in rows}
    assert {r.doc_id: r.score for r in found} == pytest.approx(expected, abs=1e-6)


def test_tree_grows_with_the_corpus(spark, monkeypatch):
    """More of the same kind of text gives more contexts and transitions: no number of them is fixed."""
    monkeypatch.setattr(suffix_tree, "CONTEXT", 20)
    docs = table(spark, MIDDLE, "documents")

    def sizes(rows):
        model = suffix_tree.Model(suffix_tree._documents(rows), Scratch(spark, "test-tree"))
        return [sum(t.count() for t in column) for column in zip(*model.levels, strict=True)]

    few, many = sizes(docs.where("doc_id % 5 = 0")), sizes(docs)
    assert many[0] > 2 * few[0] and many[1] > 2 * few[1]


def test_rows_of_the_shuffles_are_blocks(spark):
    """What is listed goes through shuffles packed, and a text is in one pass: no written table has a row for each key."""
    docs = table(spark, MIDDLE, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    found = suffix_tree.score(docs)
    read = sorted({f.rsplit("/", 2)[-2] for f in found.inputFiles()})
    assert folder and set(read) <= {f"scored-{k}" for k in range(suffix_tree.PASSES)} and len(read) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and found.count() == docs.count()


def test_tables_that_nothing_reads_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CONTEXT", 20)
    docs = table(spark, MIDDLE, "documents").where("doc_id % 5 = 0")
    scratch = Scratch(spark, "test-tree")
    scratch.folder = str(tmp_path / "tree")
    model = suffix_tree.Model(suffix_tree._documents(docs), scratch)
    left = {p.name.split("-")[0] for p in (tmp_path / "tree").iterdir()}
    assert left == {"tokens", "contexts", "transitions"} and all(t.count() for level in model.levels for t in level)


def test_hashes_are_those_of_sql(spark):
    words = [b"", b"a", b"0123456789" * 9, "äé".encode()]
    found = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", F.xxhash64("w").alias("h"))
    assert {bytes(r.w): r.h for r in found.collect()} == {w: suffix_tree.token_hash(w) for w in words}


def test_hashes_of_a_column_are_those_of_its_words():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(size)) for size in [*range(70), 8, 0, 31]]
    column = suffix_tree.pa.array(words, suffix_tree.pa.binary())
    for found, own in ((column, words), (column.slice(5, 40), words[5:45]), (column.slice(0, 0), [])):
        assert suffix_tree.token_hashes(found).tolist() == [suffix_tree.token_hash(w) for w in own]


def test_sent_values():
    rng = suffix_tree.np.random.default_rng(3)
    # Many of the same place, zero among them.
    keys = suffix_tree.np.unique(suffix_tree.np.concatenate([rng.integers(-(1 << 63), 1 << 63, 3000), suffix_tree.np.arange(300)]))
    sent = suffix_tree.Sent(keys, keys % 1000 + 0.5)
    asked = suffix_tree.np.concatenate([keys, suffix_tree.np.arange(300, 900), [sent.free]])
    values, there = sent.look_up(asked)
    assert there.tolist() == [True] * len(keys) + [False] * 601
    assert values.tolist() == [*(keys % 1000 + 0.5), *[0.0] * 601]
    assert not suffix_tree.Sent(keys[:0], keys[:0] + 0.5).look_up(keys)[1].any()


def test_pairs_are_summed_and_dealt_whole():
    """Pairs that share a key and contexts in several buckets are counted apart, each once."""
    np = suffix_tree.np
    rng = np.random.default_rng(4)
    context, suffix = rng.integers(0, 40, 5000), rng.integers(0, 40, 5000)
    suffix[:2000] ^= suffix_tree._turned(context[:2000])
    expected = Counter(zip(context.tolist(), suffix.tolist(), strict=True))
    found = suffix_tree._summed(context, suffix, np.ones(5000, np.int64))
    assert {(c, s): n for c, s, n in zip(*(f.tolist() for f in found), strict=True)} == expected and len(found[0]) == len(expected)
    for bits in (0, 1, 5):
        rows = list(suffix_tree._unpacked([suffix_tree._dealt(*found, bits)]))
        dealt = []
        for bucket, *packed in rows:
            contexts, sizes, suffixes, counts = (np.frombuffer(p, t) for p, t in zip(packed, (np.int64, np.int32, np.int64, np.int64), strict=True))
            dealt += [(bucket, (c, s), n) for c, s, n in zip(np.repeat(contexts, sizes).tolist(), suffixes.tolist(), counts.tolist(), strict=True)]
        assert len({b for b, *_ in rows}) == len(rows) <= 1 << bits and Counter(p for _, p, _ in dealt) == Counter(expected.keys())
        assert all(expected[p] == n for _, p, n in dealt)


def test_bit_table_has_all_keys(spark):
    keys = [random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, 63, 64]
    table_ = suffix_tree.BitTable(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert table_.has(suffix_tree.np.array(keys)).all()
    assert table_.has(suffix_tree.np.arange(1000, 11_000)).sum() < 100


def test_buckets_and_passes_change_no_score(spark, monkeypatch):
    for name, value in (("CONTEXT", 20), ("TRANSITION", 3), ("COMMON", 0.02), ("HELD", 50), ("HELD_GRAMS", 100)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = list(enumerate(ordered_texts(random.Random(6), 60)))
    rows += [(None, "a b c"), (None, None), (70, " \t a  b \x0b"), (70, "x" * 50 + " a"), (71, "")]

    def found(buckets, values, runs, passes):
        for name, value in (("BUCKETS", buckets), ("BUCKET_VALUES", values), ("BUCKET_RUNS", runs), ("PASSES", passes)):
            monkeypatch.setattr(suffix_tree, name, value)
        return sorted((str(r[0]), *map(float, r[1:5]), round(r[5], 6), round(r[6], 6)) for r in suffix_tree.score(documents(spark, rows)).collect())

    one = found(1, 100_000, 500_000, 1)
    assert len(one) == len(rows) and found(64, 1, 10, 3) == one


def test_bit_table_grows_with_its_keys(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BITS", 1 << 8)
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    others = suffix_tree.np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 10_000)
    wide = suffix_tree.BitTable(keys)
    assert wide.many == 4000 and wide.bits == 1 << 16 and wide.has(others).mean() < 0.1
    monkeypatch.setattr(suffix_tree, "MOST_BITS", 1 << 10)
    full = suffix_tree.BitTable(keys)
    assert full.bits == 1 << 10
    for table_ in (wide, full):
        assert table_.has(suffix_tree.np.array([r.key for r in keys.collect()])).all()


def test_common_and_rare_tokens_agree(spark, monkeypatch):
    """Counts that are sent and counts that are joined give one result."""
    docs = table(spark, MIDDLE, "documents").limit(200)
    monkeypatch.setattr(suffix_tree, "COMMON", 1e-3)
    monkeypatch.setattr(suffix_tree, "HELD", 500)
    check(suffix_tree.score(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [*odd_rows(), (40, "Unseen"), (41, "one one two")]
    found = suffix_tree.score(documents(spark, rows)).collect()
    check(found, rows)
    assert all(math.isfinite(r.score) for r in found)
    assert suffix_tree.score(documents(spark, [])).collect() == []
    # Only held-out rows: nothing is known.
    only = next(k for k in range(100) if not training(k))
    alone = suffix_tree.score(documents(spark, [(only, "a b")])).collect()
    check(alone, [(only, "a b")])
    assert math.isfinite(alone[0].score)
