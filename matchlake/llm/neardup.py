"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``SIDE`` short signatures, each of ``ROWS`` minhashes, are computed for
every distinct shingle set. A table key pairs a signature of the first collection with one
of the second, so ``SIDE * SIDE`` tables of ``2 * ROWS`` rows need ``2 * SIDE * ROWS``
minhashes instead of ``SIDE * SIDE * 2 * ROWS``. Two sets meet in a table exactly if both
collections agree somewhere; at similarity 0.8 that fails with probability
2 * (1 - 0.8^3)^14 = 0.00009. Candidates are confirmed on their whole sets.

Only connections matter, so a table bucket is never expanded into all its pairs. First
each set proposes to one hub of its buckets and to a few others; what has become connected is
left alone. Then, as long as a bucket holds sets of different components, its members of
the smallest components are compared with all others and leave it.

Pairs in those rounds pass an exact bound first. Let x and y both have been compared with
hub h. Their overlap is at most min(|x & h|, |y & h|) plus the shingles outside h that they
share; where few shingles differ from h, these are carried along and give the overlap
itself: |x & h| + |y & h| - |h| plus what both lack of h plus what both have outside it.
So heavily edited copies of one text are told apart without reading their sets again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mixed, pieces, shingle_hashes, space_words, texts_of

#: Words of a shingle, and the least similarity in percent, unless the caller says otherwise.
SHINGLE, PERCENT = 5, 80
#: Short signatures on each side, and minhashes of each.
SIDE, ROWS = 14, 3
#: Members of a bucket that are compared with all others in one round.
HUBS = 256
#: Differences from the hub that are carried with a set; with more, only their number is used.
MOST_CARRIED = 64
#: Shingles hashed at a time.
_CHUNK = 4096


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 4 * SIDE * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = 2 * SIDE * ROWS
    return seeds[:half, None] | np.uint64(1), seeds[half:, None]


def shingle_set(text: bytes | None, length: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a shorter text is one shingle."""
    words = space_words(text or b"")
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(hashes.of(words), min(length, len(words))))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``2 * SIDE`` hashes of ``ROWS`` minhashes each."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _CHUNK):
        part = shingles[None, start : start + _CHUNK]
        np.minimum(least, (part * a + b).min(axis=1), out=least)
    rows = least.reshape(2 * SIDE, ROWS)
    folded = np.arange(2 * SIDE, dtype=np.uint64)
    for k in range(ROWS):
        folded = mixed(folded ^ (rows[:, k] >> np.uint64(16)))
    return folded.view(np.int64)


def _signed(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _parameters()
        for batch in pieces(batches):
            counts, keys, signed = [], [], []
            for text in texts_of(batch, "text"):
                shingles = shingle_set(text, length, hashes)
                counts.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                signed.append(signatures(shingles, a, b) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, signature array<bigint>")


def _sets(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            found = [shingle_set(text, length, hashes) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                ["set_key", "shingles"],
            )

    return docs.mapInArrow(run, "set_key binary, shingles array<bigint>")


def _sides(classes: DataFrame) -> DataFrame:
    """Classes that share a signature with another on both sides, with those signatures."""
    sides = []
    for side in (0, 1):
        entries = classes.select(
            "id", F.posexplode(F.slice("signature", side * SIDE + 1, SIDE)).alias("place", "value")
        )
        shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
        sides.append(entries.join(shared, "value").groupBy("id").agg(F.collect_list("value").alias(f"side{side}")))
    return sides[0].join(sides[1], "id").join(classes.select("id", F.col("n_shingles").alias("size")), "id")


def _table_keys(sides: DataFrame) -> DataFrame:
    """(key, id, size) for each pair of a signature of one side with one of the other."""
    pairs = sides.withColumn("x", F.explode("side0")).withColumn("y", F.explode("side1"))
    return pairs.select(F.xxhash64("x", "y").alias("key"), "id", "size")


def _live(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component, of buckets that hold more than one component."""
    known = keys.join(labels, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
    mixed_buckets = (
        known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    )
    return known.join(mixed_buckets, "key")


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * 100 >= high * percent


def _popularity(live: DataFrame) -> DataFrame:
    """How many members the buckets of each set hold together; the centre of a group has most."""
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    return live.join(sizes, "key").groupBy("id").agg(F.sum("members").alias("popularity"))


def _proposals(live: DataFrame, ranks: list[Column], percent: int) -> DataFrame:
    """(a, b, way): one hub a for each member b and each way to choose a bucket's hub."""
    hub = [F.min(F.struct(rank.alias("rank"), F.col("id"), F.col("comp"), F.col("size"))).alias(f"h{k}") for k, rank in enumerate(ranks)]
    chosen = live.groupBy("key").agg(*hub)
    other = [F.when((F.col(f"h{k}.comp") != F.col("comp")) & _fits("size", f"h{k}.size", percent), F.col(f"h{k}")) for k in range(len(ranks))]
    best = live.join(chosen, "key").groupBy("id").agg(*[F.min(h).alias(f"h{k}") for k, h in enumerate(other)])
    offers = best.select("id", F.explode(F.array(*[F.col(f"h{k}.id") for k in range(len(ranks))])).alias("a"))
    return offers.where("a IS NOT NULL").select("a", F.col("id").alias("b")).distinct()


def _profiles(compared: DataFrame) -> DataFrame:
    """How sets that were compared with a hub differ from it.

    ``inside`` counts the shingles shared with the hub, ``novel`` holds those outside it
    that another set of the same hub has too, ``removed`` those of the hub that are missing.
    """
    base = compared.select(
        F.col("b").alias("id"), F.col("a").alias("hub"), F.col("both").alias("inside"), "hub_size", "outside", "removed"
    )
    outside = base.select("hub", "id", F.explode("outside").alias("shingle"))
    shared = outside.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "shingle")
    novel = outside.join(shared, ["hub", "shingle"]).groupBy("id").agg(F.collect_list("shingle").alias("novel"))
    none = F.expr("cast(array() as array<bigint>)")
    few = lambda name: F.when(F.size(name) <= MOST_CARRIED, F.col(name)).alias(name)
    whole = base.drop("outside").join(novel, "id", "left").withColumn("novel", F.coalesce("novel", none))
    return whole.select("id", "hub", "inside", "hub_size", F.size("novel").alias("n_novel"), few("novel"), few("removed"))


def _all_of_smallest(live: DataFrame, sides: DataFrame, profiles: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's first members with all others, and those members by bucket.

    First come the members of the bucket's smallest components. A pair that meets in
    several buckets is given in one: that of the smallest signatures it shares.
    """
    profiles = sides.select("id", "side0", "side1").join(profiles, "id", "left")
    counts = live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("peers"))
    placed = live.join(counts, ["key", "comp"])
    order = Window.partitionBy("key").orderBy("peers", "comp", "id")
    hubs = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HUBS).select("key", "id", "comp", "size")
    first, rest = hubs.join(profiles, "id").alias("x"), live.join(profiles, "id").alias("y")
    shared = [F.array_min(F.array_intersect(f"x.side{k}", f"y.side{k}")) for k in (0, 1)]
    here = F.xxhash64(*shared) == F.col("x.key")
    enough = lambda overlap: overlap * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent
    least = F.least("x.inside", "y.inside")
    kept = F.col("x.inside") + F.col("y.inside") - F.col("x.hub_size") + F.size(F.array_intersect("x.removed", "y.removed"))
    may = F.when(F.coalesce(F.col("x.hub") != F.col("y.hub"), F.lit(True)), True)
    may = may.when(~enough(least + F.least("x.n_novel", "y.n_novel")), False)
    may = may.when(F.col("x.novel").isNull() | F.col("y.novel").isNull(), True)
    both_novel = F.size(F.array_intersect("x.novel", "y.novel"))
    inside = F.when(F.col("x.removed").isNull() | F.col("y.removed").isNull(), least).otherwise(kept)
    may = may.otherwise(enough(inside + both_novel))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
    pairs = rest.join(first, same & _fits("x.size", "y.size", percent) & may & here)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return pairs, hubs.select("key", "id")


def _compared(pairs: DataFrame, sets: DataFrame, outside: bool = False) -> DataFrame:
    """Sizes of the whole sets of each pair and of what they share."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    more = []
    if outside:
        more = [
            F.array_except("set_b", "set_a").alias("outside"),
            F.array_except("set_a", "set_b").alias("removed"),
            F.size("set_a").cast("bigint").alias("hub_size"),
        ]
    sizes = (F.size("set_a") + F.size("set_b")).cast("bigint")
    return pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("both"), sizes.alias("sizes"), *more)


def _similar(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent


def _components(scratch: Scratch, links: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Smallest node of each component of the links, for nodes that have any.

    ``labels`` holds what was connected before. Labels pass along the links, and each
    label then takes the label of its own node, so paths halve in length every round.
    """
    both = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a", "left")
    both = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b", "left")
    edges = both.select(F.coalesce("x", "a").alias("u"), F.coalesce("y", "b").alias("v")).where("u != v")
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = scratch.write(edges, f"{name}-edges")
    current = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        around = (
            edges.join(current.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        nearer = current.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = current.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        moved = nearer.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("farther", "label")).alias("label"))
        step += 1
        moved = scratch.write(moved, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        current = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            break
    own = current.select(F.col("node").alias("label"), F.col("label").alias("new"))
    kept = labels.join(own, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    fresh = current.select(F.col("node").alias("id"), "label").join(labels.select("id"), "id", "left_anti")
    done = scratch.write(kept.unionByName(fresh), f"{name}-labels")
    scratch.drop(f"{name}-edges")
    return done


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    ``shingle``-word runs (A-Z lower-cased, words between ASCII white space); fewer words are
    one run. ``component_id`` is the smallest id that links reach, ``kept`` says that it
    is the row's own.

    Null, empty and blank texts have an empty set and no links. A row whose id is null is
    linked like others, but cannot be named: it is kept only if its component has
    no id at all. Repeated rows are each returned with the same answer. Other columns
    are not read; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "neardup")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(_signed(docs, shingle), "signed")

    grouped = signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = scratch.write(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    sides = scratch.write(_sides(classes), "sides")
    keys = scratch.write(_table_keys(sides), "keys")
    met = classes.join(sides.select("id"), "id", "left_semi").select("id", "set_key", "doc_id")
    met = scratch.write(met, "met")
    sets = _class_sets(scratch, docs, met, shingle)

    labels = scratch.spark.createDataFrame([], "id bigint, label bigint")
    profiles, number = None, 0
    while True:
        live = _live(keys, labels).select("key", "id", "comp", "size")
        if number == 0:
            popular = scratch.write(_popularity(live), "popularity")
        if number < 2:
            live = live.join(popular, "id")
        live = scratch.write(live, f"live-{number}")
        if live.isEmpty():
            break
        retired = None
        if number == 0:
            pairs = _proposals(live, [-F.col("popularity")], percent)
        elif number == 1:
            pairs = _proposals(live, [-F.col("popularity"), F.col("id"), F.xxhash64("id")], percent)
        else:
            pairs, retired = _all_of_smallest(live, sides, profiles, percent)
            retired = scratch.write(retired, f"retired-{number}")
        compared = scratch.write(_compared(scratch.write(pairs, f"pairs-{number}"), sets, number == 0), f"compared-{number}")
        if number == 0:
            profiles = scratch.write(_profiles(compared), "profiles")
        links = compared.where(_similar(percent)).select("a", "b")
        if not links.isEmpty():
            labels = _components(scratch, links, labels, f"components-{number}")
        keys = live.select("key", "id", "size")
        if retired is not None:
            keys = keys.join(retired, ["key", "id"], "left_anti")
        number += 1

    whole = classes.select("set_key", "id", "doc_id").join(labels, "id", "left")
    whole = whole.select("set_key", F.col("doc_id").alias("least"), F.coalesce("label", "id").alias("label"))
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.write(whole.join(least, "label").select("set_key", "component_id"), "named")
    rows = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _class_sets(scratch: Scratch, docs: DataFrame, met: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the classes that met another in a table."""
    named = docs.join(met.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    unnamed = docs.where("doc_id IS NULL")
    found = _sets(named.unionByName(unnamed).where("text IS NOT NULL").select("text"), shingle)
    sets = found.join(met, "set_key").groupBy("id").agg(F.first("shingles").alias("shingles"))
    return scratch.write(sets, "sets")


def deduplicated(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, with its columns.

    Of repeated rows of one id one stays; rows without an id all stay, as do texts
    without words.
    """
    scratch = Scratch(documents.sparkSession, "neardup-kept")
    found = near_duplicates(documents, shingle, percent)
    gone = scratch.write(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    repeated = scratch.write(documents.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    rest = documents.join(gone, "doc_id", "left_anti")
    single = rest.join(repeated, "doc_id", "left_anti")
    several = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.select(*documents.columns).unionByName(several.select(*documents.columns))
