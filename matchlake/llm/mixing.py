"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Tokens are counted by cell, a cell being one source, language and topic. Raking scales the
cells' weights so that the marginal of each dimension meets its target, one dimension
after the other. No cell can give more tokens than it has: each step of the raking takes full
cells at what they hold and scales the others to fill the rest. A document is kept with the
probability that brings its cell to its weight, decided by a hash of its id.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the tokens to this power, which lifts small sources, languages and topics.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 15
#: Tokens to keep, as a share of all; fewer where targets ask for more of a value than there is.
BUDGET = 0.8
#: Largest relative distance between a marginal and its target, and the budgets tried to reach it.
TOLERANCE = 1e-3
LOWER, ATTEMPTS = 0.8, 4
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Spaces and line ends plus one; none in null and empty texts."""
    gaps = F.length(text) * 2 - F.length(F.replace(text, F.lit(" "), F.lit(""))) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, gaps + 1).otherwise(0).cast("bigint")


def topic(text: Column) -> Column:
    """Coarse topic by what a text mentions first in this order."""
    return (
        F.when(text.contains('= "'), "code")
        .when(text.contains("icense"), "legal")
        .when(text.contains("@") | text.contains("+"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


def _described(documents: DataFrame) -> list[Column]:
    text = F.col("`text`").cast("string")
    label = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(NONE)).alias(name)
    return [label("source"), label("lang"), topic(text).alias("topic"), token_count(text).alias("n_tokens")]


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): target shares by the tokens' power."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raised"))
    whole = sums.agg(F.sum("raised")).first()[0] or 1.0
    return sums.select("value", (F.col("raised") / F.lit(whole)).alias("share"))


def aims(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """The cells with a goal in tokens for each dimension, and the budget that their marginals allow.

    Cells with a value without a target are left out; shares are taken relative to those of the
    values that are left. The budget is the largest share of all tokens at which no single value
    needs more than its tokens.
    """
    aimed = cells
    for name, target in targets.items():
        share = target.where("share > 0").select(F.col("value").alias(name), F.col("share").alias(f"share_{name}"))
        aimed = aimed.join(share, name)
    total = aimed.agg(F.sum("tokens")).first()[0] or 0.0
    budget = 1.0
    for name in targets:
        share = F.col(f"share_{name}")
        values = aimed.groupBy(name, share).agg(F.sum("tokens").alias("held"))
        row = values.agg(F.sum(share).alias("whole"), F.min(F.col("held") / share).alias("least")).first()
        whole = row.whole or 1.0
        budget = min(budget, row.least * whole / total) if total else budget
        aimed = aimed.withColumn(f"goal_{name}", share * F.lit(total / whole)).drop(f"share_{name}")
    return aimed, budget


def _raked(cells: DataFrame, name: str) -> DataFrame:
    """``open`` scaled by one factor for each value of a dimension, so that the weights meet its goal.

    With cells by the factor that fills them, and the first k full, the factor of the others is
    (goal - what the k hold) / (open of the rest). The factor sought is the largest of these over
    all k, because weights can only stay below the line that any one k draws.
    """
    value = Window.partitionBy(name)
    others = [d for d in DIMENSIONS if d != name]
    filled = F.col("cap") / F.col("open")
    rising = value.orderBy(filled, *others).rowsBetween(Window.unboundedPreceding, -1)
    falling = value.orderBy(filled.desc(), *[F.desc(d) for d in others]).rowsBetween(Window.unboundedPreceding, 0)
    root = (F.col(f"goal_{name}") - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / F.sum("open").over(falling)
    scaled = cells.withColumn("root", root).withColumn("factor", F.max("root").over(value))
    return scaled.withColumn("open", F.col("open") * F.col("factor")).drop("root", "factor")


def rake(aimed: DataFrame, rounds: int, scratch: Scratch, limit: float = math.inf) -> DataFrame:
    """Cells of :func:`aims` with ``weight``: token weights whose marginals meet the goals.

    A weight is at most ``limit`` times the cell's tokens. Windows hold the cells of one value,
    which are counts and not rows of the corpus.
    """
    fitted = aimed.withColumn("open", F.col("tokens")).withColumn("cap", F.col("tokens") * F.lit(limit))
    for number in range(rounds):
        for name in DIMENSIONS:
            fitted = _raked(fitted, name)
        fitted = scratch.write(fitted, f"round-{number}")
        if number:
            scratch.drop(f"round-{number - 1}")
    return fitted.withColumn("weight", F.least("open", "cap")).drop("open", "cap")


def deviation(fitted: DataFrame) -> float:
    """Largest relative distance between a marginal of the weights and its goal."""
    parts = None
    for name in DIMENSIONS:
        sums = fitted.groupBy(F.col(f"goal_{name}").alias("goal"), name).agg(F.sum("weight").alias("have"))
        apart = sums.select(F.abs(F.col("have") / F.col("goal") - 1).alias("apart"))
        parts = apart if parts is None else parts.unionByName(apart)
    return parts.agg(F.max("apart")).first()[0] or 0.0


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _calibrated(
    documents: DataFrame, targets: dict[str, DataFrame] | None, budget: float, rounds: int, powers: dict[str, float]
) -> DataFrame:
    """Probability to keep a document, by cell."""
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = documents.select(*_described(documents))
    tokens = F.sum(F.greatest("n_tokens", F.lit(1))).cast("double")
    cells = scratch.write(rows.groupBy(*DIMENSIONS).agg(tokens.alias("tokens")), "cells")
    aimed, most = aims(cells, {d: (targets or {}).get(d) or tempered(cells, d, powers[d]) for d in DIMENSIONS})
    aimed = scratch.write(aimed, "aims")
    budgets = [min(budget, most) * LOWER**n for n in range(ATTEMPTS)]
    for number, share in enumerate(budgets):
        fitted = rake(aimed, rounds, scratch, 1 / share)
        chance = F.round(F.lit(share) * F.col("weight") / F.col("tokens"), 6)
        chances = scratch.write(fitted.select(*DIMENSIONS, chance.alias("probability")), f"fit-{number}")
        if deviation(fitted) <= TOLERANCE:
            break
    else:
        # Targets that contradict each other: what the wanted budget came to.
        warnings.warn("the cells cannot meet all marginals at once; the last dimension's are met", stacklevel=3)
        chances = documents.sparkSession.read.schema(chances.schema).parquet(scratch.path("fit-0"))
    whole = cells.select(*DIMENSIONS).join(chances, list(DIMENSIONS), "left")
    return scratch.write(whole.fillna(0.0, ["probability"]), "probabilities")


def _kept() -> Column:
    key = F.coalesce(F.col("`doc_id`").cast("string"), F.col("`text`").cast("string"), F.lit(""))
    return _uniform(key) < F.col("probability")


def mixture(
    documents: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    powers: dict[str, float] = POWERS,
) -> DataFrame:
    """``doc_id``, its cell, ``n_tokens``, ``probability`` and ``kept`` of each row of ``documents``.

    ``targets`` may give (value, share) for ``source``, ``lang`` or ``topic``; without,
    shares are the tokens to ``powers``. ``budget`` is lowered to the largest one at which no value
    needs more tokens than it has, and further where cells cannot meet all marginals; so the kept
    tokens have the target shares in expectation. Targets that contradict each other at every budget
    (as where one source is all of a language) are met for the last dimension, with a
    warning. Values without a target are not kept. Null sources and languages are a value of their own, an empty
    text weighs one token, a row without an id is decided by its text, repeated rows alike.
    Other columns are not read; an empty table gives no rows.
    """
    chances = _calibrated(documents, targets, budget, rounds, powers)
    rows = documents.select("doc_id", F.col("`text`"), *_described(documents))
    joined = rows.join(chances, list(DIMENSIONS))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", "probability", _kept().alias("kept"))


def mixed(
    documents: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    powers: dict[str, float] = POWERS,
) -> DataFrame:
    """The documents that :func:`mixture` keeps, with their columns; nulls and repeats as there."""
    chances = _calibrated(documents, targets, budget, rounds, powers)
    whole = F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("whole")
    rows = documents.select(whole, *_described(documents))
    joined = rows.join(chances, list(DIMENSIONS))
    key = F.coalesce(F.col("whole.doc_id").cast("string"), F.col("whole.text").cast("string"), F.lit(""))
    return joined.where(_uniform(key) < F.col("probability")).select("whole.*")


def sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same mixture as one SQL statement over ``documents``."""
    parts = [
        f"""d AS (SELECT doc_id, text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE WHEN contains(text, '= "') THEN 'code' WHEN contains(text, 'icense') THEN 'legal'
             WHEN contains(text, '@') OR contains(text, '+') THEN 'contact'
             WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS topic,
        CAST(CASE WHEN length(text) > 0 THEN 1 + 2 * length(text) - length(replace(text, ' ', ''))
             - length(replace(text, chr(10), '')) ELSE 0 END AS BIGINT) AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(greatest(n_tokens, 1)) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for name in DIMENSIONS:
        parts.append(
            f"g_{name} AS (SELECT {name}, raised / sum(raised) OVER () * sum(held) OVER () AS goal, held / goal AS most"
            f" FROM (SELECT {name}, sum(tokens) AS held, pow(held, {POWERS[name]}) AS raised FROM c GROUP BY {name}))"
        )
    mosts = ", ".join(f"(SELECT min(most) FROM g_{name})" for name in DIMENSIONS)
    parts.append(f"b AS (SELECT least({budget}, {mosts}) AS budget)")
    parts.append("w0 AS (SELECT c.*, tokens AS weight, tokens / budget AS cap FROM c, b)")
    step = 0
    for _ in range(rounds):
        for name in DIMENSIONS:
            # The factor is found as the first by which the next cell is not filled.
            parts.append(
                f"""o{step} AS (SELECT w.{name} AS value, cap / weight AS filled, (goal - coalesce(sum(cap) OVER (PARTITION BY w.{name}
                ORDER BY cap / weight, {', '.join('w.' + d for d in DIMENSIONS)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER
                (PARTITION BY w.{name} ORDER BY cap / weight, {', '.join('w.' + d for d in DIMENSIONS)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS root
                FROM w{step} w JOIN g_{name} g ON g.{name} = w.{name})"""
            )
            parts.append(
                f"f{step} AS (SELECT value, coalesce(arg_min(root, filled) FILTER (WHERE root <= filled * (1 + 1e-12)), max(filled)) AS factor"
                f" FROM o{step} GROUP BY value)"
            )
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT w.* REPLACE (weight * factor AS weight) FROM w{step} w JOIN f{step} f ON f.value = w.{name})"
            )
            step += 1
    return (
        "WITH " + ",\n".join(parts) + f""",
        p AS (SELECT source, lang, topic, round(budget * least(weight, cap) / tokens, 6) AS probability FROM w{step}, b)
        SELECT d.doc_id, source, lang, topic, d.n_tokens, p.probability,
               CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0
               < p.probability AS kept
        FROM d JOIN p USING (source, lang, topic)"""
    )
