"""Quality rules by robust multivariate outliers, in DataFrame operations.

A text's statistics become a vector of four transformed numbers on an integer grid. For each
language and source the minimum covariance determinant is estimated: from two starts, the
half of the rows with the smallest Mahalanobis distances gives the next mean and covariance,
and the start that ends with the smaller determinant wins; one reweighting follows. A row whose
distance is above the cutoff is rejected.

Rows with equal vectors are one row with a count, and sums over the grid are whole
numbers, so that estimates do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50

DIMENSIONS = ("length", "symbols", "lines", "repeats")
PAIRS = [(a, b) for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[: i + 1]]
#: Steps of the grid in one unit of a transformed statistic.
GRID = 128
#: Deviations, in units, that are always allowed for; more than half of the rows may hold
#: the same value in a dimension, and the determinant would be zero without them.
FLOOR = {"length": 0.05, "symbols": 0.06, "lines": 0.18, "repeats": 0.18}
#: A language and source with fewer rows is pooled with its like.
LEAST_ROWS = 200
STEPS = 6
STARTS = ("all", "median")
#: Distances are binned to order them: bins in one unit, and the last bin.
BINS, LAST_BIN = 64, 4095

# Fixed values of the chi-square distribution with four degrees of freedom: factors that make the
# covariance of the inner half, and of the inner 97.5 percent, that of a normal distribution; the
# 97.5 percent point; the point that one in a million passes.
HALF_FACTOR = 2.1124
REWEIGHTED_FACTOR = 1.0646
REWEIGHTING = 11.143
CUTOFF = 33.377


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``words``, windows compared by 64-bit hash."""
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)

    def covered(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
        found = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def repeated(each: Column) -> Column:
        ordered = F.sort_array(F.transform(each, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(each)) == F.size(each), 0).otherwise(_bound(ordered, covered))

    return F.when(F.size(words) < 3, 0).otherwise(_bound(hashes, repeated))


def statistics(text: Column) -> dict[str, Column]:
    """Counts over whole texts; null and empty texts have none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    of_words = lambda w: F.struct(
        F.size(w).alias("words"), F.length(F.array_join(w, "")).alias("chars"), _repeated_words(w).alias("repeated")
    )
    of_lines = lambda ls: F.struct(F.size(ls).alias("lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("doubled"))
    return {
        "by_word": _bound(words, of_words),
        "by_line": _bound(lines, of_lines),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("bigint"),
    }


def described(documents: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns, the counts of each text, ``base_failed`` and the row's vector on the grid."""
    row = documents.select(*kept, *[c.alias(n) for n, c in statistics(F.col("`text`")).items()])
    found = {
        "n_words": "by_word.words", "word_chars": "by_word.chars", "n_repeat_words": "by_word.repeated",
        "n_lines": "by_line.lines", "n_dup_lines": "by_line.doubled",
    }
    row = row.select(
        *[F.col(c) for c in row.columns if c not in ("by_word", "by_line")],
        *[F.col(c).cast("bigint").alias(n) for n, c in found.items()],
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = lambda part, whole: F.asin(F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1))))
    units = {
        "length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }
    return row.select("*", failed.alias("base_failed"), *[F.floor(c * GRID + 0.5).cast("bigint").alias(n) for n, c in units.items()])


def _grouped(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pool, vector, n) of rows that pass the base rules, and the pool of each language and source.

    A language and source of too few rows joins its language's pool of such, and if that
    is too small too, the pool of all such; a pool that is still too small gives no verdict.
    """
    sound = rows.where(~F.col("base_failed"))
    vectors = scratch.write(sound.groupBy("lang", "source", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n")), "vectors")
    sizes = vectors.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    own = F.col("n") >= LEAST_ROWS
    small = sizes.where(~own).groupBy("lang").agg((F.sum("n") >= LEAST_ROWS).alias("enough"))
    sized = sizes.join(small.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    pool = F.when(own, F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")))
    pool = pool.when(F.col("enough"), F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")))
    nothing = F.lit(None).cast("string")
    pool = pool.otherwise(F.struct(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source")))
    # As one text, so that pools with nulls compare as equal.
    pools = scratch.write(sized.select("lang", "source", F.to_json(pool).alias("pool")), "pools")
    return vectors, pools


def _with_pool(df: DataFrame, pools: DataFrame) -> DataFrame:
    of = pools.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "pool")
    return df.join(of, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def _sums() -> list[Column]:
    n = F.col("n")
    first = [F.sum(n * F.col(d)).alias(f"s_{d}") for d in DIMENSIONS]
    return [F.sum(n).alias("n"), *first, *[F.sum(n * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in PAIRS]]


def _fitted(sums: DataFrame, factor: float) -> DataFrame:
    """Means ``m_``, the lower triangle ``l_`` of the covariance and ``volume``, its determinant's root, from sums."""
    fitted = sums.withColumns({f"m_{d}": F.col(f"s_{d}") / F.col("n") for d in DIMENSIONS})
    for j, b in enumerate(DIMENSIONS):

        def left(a: str, b: str = b, j: int = j) -> Column:
            value = (F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")) * factor
            value = value + (FLOOR[a] * GRID) ** 2 if a == b else value
            return reduce(lambda x, c: x - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}"), DIMENSIONS[:j], value)

        fitted = fitted.withColumn(f"l_{b}_{b}", F.sqrt(left(b)))
        fitted = fitted.withColumns({f"l_{a}_{b}": left(a) / F.col(f"l_{b}_{b}") for a in DIMENSIONS[j + 1 :]})
    volume = reduce(lambda x, y: x * y, [F.col(f"l_{d}_{d}") for d in DIMENSIONS])
    kept = [c for c in fitted.columns if not c.startswith("s_")]
    return fitted.select(*kept, volume.alias("volume"))


def squared_distance() -> Column:
    """Squared Mahalanobis distance of a row's vector, by means and triangle beside it."""
    solved: dict[str, Column] = {}
    for a in DIMENSIONS:
        rest = F.col(a) - F.col(f"m_{a}")
        for b in solved:
            rest = rest - F.col(f"l_{a}_{b}") * solved[b]
        solved[a] = rest / F.col(f"l_{a}_{a}")
    return reduce(lambda x, y: x + y, [z * z for z in solved.values()])


def _medians(vectors: DataFrame) -> DataFrame:
    """(pool, m_...): the middle value in each dimension, the lower one of two."""
    values = vectors.select("pool", "n", F.explode(F.array(*[F.struct(F.lit(d).alias("at"), F.col(d).alias("x")) for d in DIMENSIONS])).alias("v"))
    counts = values.groupBy("pool", "v.at", "v.x").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("pool", "at")
    upto = counts.select("pool", "at", "x", F.sum("n").over(whole.orderBy("x")).alias("upto"), F.sum("n").over(whole).alias("all"))
    middle = upto.where(2 * F.col("upto") >= F.col("all"))
    at = lambda d: F.min(F.when(F.col("at") == d, F.col("x"))).cast("double").alias(f"m_{d}")
    return middle.groupBy("pool").agg(*[at(d) for d in DIMENSIONS])


def estimates(vectors: DataFrame, scratch: Scratch, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> DataFrame:
    """Mean and covariance triangle of each pool by the minimum covariance determinant."""
    whole = vectors.groupBy("pool").agg(*_sums()).where(F.col("n") >= least_rows)
    whole = scratch.write(whole, "sums")
    half = whole.select("pool", F.floor((F.col("n") + len(DIMENSIONS) + 1) / 2).alias("half"))
    spread = {f"l_{a}_{b}": F.lit(FLOOR[a] * GRID if a == b else 0.0) for a, b in PAIRS}
    first = _fitted(whole, 1.0).drop("n", "volume").withColumn("start", F.lit(STARTS[0]))
    second = _medians(vectors.join(half, "pool", "left_semi")).withColumns(spread).withColumn("start", F.lit(STARTS[1]))
    model = scratch.write(first.unionByName(second), "start")
    position = Window.partitionBy("pool", "start").orderBy("bin")
    for step in range(steps):
        bins = F.least(F.floor(F.sqrt(squared_distance()) * BINS), F.lit(LAST_BIN))
        binned = vectors.join(model.drop("n", "volume"), "pool").withColumn("bin", bins).groupBy("pool", "start", "bin").agg(*_sums())
        # Sums of the nearest bins that together hold half of the rows.
        before = F.sum("n").over(position) - F.col("n")
        inner = binned.withColumn("before", before).join(half, "pool").where(F.col("before") < F.col("half"))
        sums = [F.sum(c).alias(c) for c in binned.columns if c not in ("pool", "start", "bin")]
        model = scratch.write(_fitted(inner.groupBy("pool", "start").agg(*sums), HALF_FACTOR), f"step-{step}")
    least = F.min_by(F.struct(*[F.col(c) for c in model.columns if c not in ("pool", "start")]), F.struct("volume", "start"))
    best = model.groupBy("pool").agg(least.alias("best")).select("pool", "best.*").drop("n", "volume")
    near = vectors.join(best, "pool").where(squared_distance() <= REWEIGHTING)
    return scratch.write(_fitted(near.groupBy("pool").agg(*_sums()), REWEIGHTED_FACTOR).drop("n", "volume"), "estimates")


def _judged(documents: DataFrame, *kept: Column) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "outliers")
    label = lambda name: F.col(f"`{name}`").cast("string").alias(name)
    rows = scratch.write(described(documents, label("lang"), label("source"), *kept), "described")
    vectors, pools = _grouped(rows, scratch)
    model = estimates(_with_pool(vectors, pools).drop("lang", "source"), scratch)
    # Every language and source stands once in this table; it is as long as there are of them.
    limits = pools.join(model, "pool").drop("pool").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    known = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    judged = rows.join(limits, known, "left").withColumn("distance", F.when(~F.col("base_failed"), squared_distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def outliers(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts of each text, ``base_failed``, ``distance`` and ``kept``, for every row.

    ``distance`` is the squared Mahalanobis distance within the row's language and source; it is
    null for rows that fail the base rules and for those whose pool is too small, which
    the base rules alone decide. Null and empty texts have no words and fail. Null
    languages and sources are values of their own. Repeated rows and ties are judged alike,
    other columns are not read, an empty table gives no rows.
    """
    return _judged(documents, F.col("`doc_id`").alias("doc_id")).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def inliers(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    whole = F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("whole")
    return _judged(documents, whole).where("kept").select("whole.*")


def sql() -> str:
    """The same verdicts as one SQL statement over ``documents``."""
    dims = list(DIMENSIONS)
    space = r"[\x20\x09-\x0D]+"
    sums = ", ".join(
        ["sum(n) AS n", *[f"sum(n * {d}) AS s_{d}" for d in dims], *[f"sum(n * {a} * {b}) AS s_{a}_{b}" for a, b in PAIRS]]
    )

    def distance() -> str:
        solved: list[str] = []
        for i, a in enumerate(dims):
            rest = f"{a} - m_{a}" + "".join(f" - l_{a}_{b} * {solved[k]}" for k, b in enumerate(dims[:i]))
            solved.append(f"(({rest}) / l_{a}_{a})")
        return " + ".join(f"{z} * {z}" for z in solved)

    def fitted(name: str, source: str, factor: float, keys: str) -> list[str]:
        means = ", ".join(f"CAST(s_{d} AS DOUBLE) / CAST(n AS DOUBLE) AS m_{d}" for d in dims)
        parts = [f"{name}_0 AS MATERIALIZED (SELECT *, {means} FROM {source})"]
        for i, a in enumerate(dims):
            for j, b in enumerate(dims[: i + 1]):
                value = f"(CAST(s_{a}_{b} AS DOUBLE) / CAST(n AS DOUBLE) - m_{a} * m_{b}) * {factor}"
                value += f" + {(FLOOR[a] * GRID) ** 2!r}" if a == b else ""
                value += "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in dims[:j])
                value = f"sqrt({value})" if a == b else f"({value}) / l_{b}_{b}"
                k = len(parts)
                parts.append(f"{name}_{k} AS MATERIALIZED (SELECT *, {value} AS l_{a}_{b} FROM {name}_{k - 1})")
        volume = " * ".join(f"l_{d}_{d}" for d in dims)
        shown = ", ".join([*[f"m_{d}" for d in dims], *[f"l_{a}_{b}" for a, b in PAIRS]])
        parts.append(f"{name} AS MATERIALIZED (SELECT {keys}, {shown}, {volume} AS volume FROM {name}_{len(parts) - 1})")
        return parts

    parts = [
        "t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents)",
        f"w AS MATERIALIZED (SELECT r, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w FROM t)",
        "p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))",
        "c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM p)",
        "q AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM c WHERE n > 1) GROUP BY r)",
        f"s AS (SELECT r, doc_id, lang, source, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,"
        f" length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,"
        f" list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS ls FROM t)",
        "b AS (SELECT s.*, len(w) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines"
        " FROM s JOIN w USING (r) LEFT JOIN q USING (r))",
        f"""rows_ AS MATERIALIZED (SELECT * EXCLUDE (ls), n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
            CAST(floor(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * {GRID} + 0.5) AS BIGINT) AS length,
            CAST(floor(asin(sqrt(n_symbols / greatest(word_chars, 1))) * {GRID} + 0.5) AS BIGINT) AS symbols,
            CAST(floor(asin(sqrt(n_dup_lines / greatest(n_lines, 1))) * {GRID} + 0.5) AS BIGINT) AS lines,
            CAST(floor(asin(sqrt(n_repeat_words / greatest(n_words, 1))) * {GRID} + 0.5) AS BIGINT) AS repeats FROM b)""",
        "sizes AS (SELECT lang, source, count(*) AS n FROM rows_ WHERE NOT base_failed GROUP BY ALL)",
        f"small AS (SELECT lang, sum(n) >= {LEAST_ROWS} AS enough FROM sizes WHERE n < {LEAST_ROWS} GROUP BY lang)",
        f"pools AS MATERIALIZED (SELECT z.lang, source, CASE WHEN n >= {LEAST_ROWS} THEN {{'level': 0, 'lang': z.lang, 'source': source}}"
        " WHEN enough THEN {'level': 1, 'lang': z.lang, 'source': NULL} ELSE {'level': 2, 'lang': NULL, 'source': NULL} END::VARCHAR AS pool"
        " FROM sizes z LEFT JOIN small ON small.lang IS NOT DISTINCT FROM z.lang)",
        f"v AS MATERIALIZED (SELECT pool, {', '.join(dims)}, count(*) AS n FROM rows_ d JOIN pools o ON o.lang IS NOT DISTINCT FROM d.lang"
        " AND o.source IS NOT DISTINCT FROM d.source WHERE NOT base_failed GROUP BY ALL)",
        f"whole AS MATERIALIZED (SELECT * FROM (SELECT pool, {sums} FROM v GROUP BY pool) WHERE n >= {LEAST_ROWS})",
        f"half AS (SELECT pool, (n + {len(dims) + 1}) // 2 AS half FROM whole)",
        *fitted("first", "whole", 1.0, "pool"),
    ]
    middle = ", ".join(
        f"(SELECT CAST(min(x) AS DOUBLE) FROM (SELECT x, sum(n) OVER (ORDER BY x) AS upto FROM (SELECT {d} AS x, sum(n) AS n FROM v WHERE v.pool = half.pool GROUP BY {d}))"
        f" WHERE 2 * upto >= (SELECT w.n FROM whole w WHERE w.pool = half.pool)) AS m_{d}"
        for d in dims
    )
    spread = ", ".join(f"{(FLOOR[a] * GRID if a == b else 0.0)!r}::DOUBLE AS l_{a}_{b}" for a, b in PAIRS)
    parts.append(
        f"model AS MATERIALIZED (SELECT *, '{STARTS[0]}' AS start FROM (SELECT * EXCLUDE (volume) FROM first)"
        f" UNION ALL BY NAME SELECT pool, {middle}, {spread}, '{STARTS[1]}' AS start FROM half)"
    )
    added = ", ".join([f"sum({c}) AS {c}" for c in ["n", *[f"s_{d}" for d in dims], *[f"s_{a}_{b}" for a, b in PAIRS]]])
    last = "model"
    for step in range(STEPS):
        parts += [
            f"bins{step} AS MATERIALIZED (SELECT pool, start, least(floor(sqrt({distance()}) * {BINS}), {LAST_BIN}) AS bin, {sums}"
            f" FROM v JOIN {last} USING (pool) GROUP BY ALL)",
            f"inner{step} AS MATERIALIZED (SELECT pool, start, {added} FROM (SELECT *, sum(n) OVER (PARTITION BY pool, start ORDER BY bin) - n AS before"
            f" FROM bins{step}) JOIN half USING (pool) WHERE before < half GROUP BY pool, start)",
            *fitted(f"step{step}", f"inner{step}", HALF_FACTOR, "pool, start"),
        ]
        last = f"step{step}"
    parts += [
        f"best AS MATERIALIZED (SELECT * FROM {last} QUALIFY row_number() OVER (PARTITION BY pool ORDER BY volume, start) = 1)",
        f"near AS MATERIALIZED (SELECT pool, {sums} FROM v JOIN best USING (pool) WHERE {distance()} <= {REWEIGHTING} GROUP BY pool)",
        *fitted("final", "near", REWEIGHTED_FACTOR, "pool"),
        f"judged AS (SELECT d.*, coalesce({distance()}, 0) <= {CUTOFF} AS near FROM rows_ d LEFT JOIN (SELECT lang AS l, source AS o, f.* FROM pools JOIN final f USING (pool))"
        " ON l IS NOT DISTINCT FROM lang AND o IS NOT DISTINCT FROM source)",
    ]
    shown = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {shown}, base_failed, NOT base_failed AND near AS kept FROM judged"
