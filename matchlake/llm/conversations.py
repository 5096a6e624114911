"""Repair of conversation structure at least cost, streamed in the order of turns.

A repaired conversation has the role initials ``(s?(ua)+)?``. Which edits are cheapest depends on
what follows, so the rows of a conversation are read twice. A first stream, from the last turn to
the first, carries the least cost of the rest for each of four states and writes one byte a
row: what to do with it in each state. A second stream, from the first turn on, meets
those bytes in chunks that are sorted in before their rows, and edits. Both streams are a
repartition by conversation with a sort inside; a task holds four costs and one chunk,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces

SPACES = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Edits in the order in which equal costs are decided.
EDITS = "DIKR"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant turn that is inserted or given its role.
FOLLOWING = (USER, USER, ASSISTANT, USER)
#: States in which a turn of this initial can stay, and the state after it.
STAYS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
#: Costs of what must follow the last row, by state.
ENDING = (0, 2 * INSERT, INSERT, 0)
#: Rows whose bytes share one chunk.
CHUNK = 65_536


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of conversation and turn gives them, and the null-free role and text."""
    space = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("`conv_id`").alias("conv_id"), F.col("`turn`").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


def examined(conversations: DataFrame) -> DataFrame:
    """Rows with their position, first fault, and what they add to the counts of the conversation."""
    space = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("`conv_id`").alias("conv_id"), F.col("`turn`").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "*",
        F.row_number().over(order).cast("bigint").alias("position"),
        F.lag(initial).over(order).alias("before"),
        F.lag("turn").over(order).alias("last_turn"),
    )
    # Partitioned by conversation already: the second window needs no shuffle of its own.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("position")) > 1
    said = F.btrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(said, F.lit(1)).isin(*".!?"), "truncated")
    return rows.withColumn("seen", seen).select(
        "conv_id", "turn", "role", "text", "position", fault.alias("fault"),
        (F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("new_turn"),
    )


def _step(costs: tuple[int, ...], initial: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Least costs from a row on, by state, less the smallest; and the edit in each state, two bits each."""
    extra = TRUNCATED if fault == 2 else 0
    stays = STAYS[INITIALS[initial]] if initial < len(INITIALS) else {}
    least = []
    for state in range(4):
        options = [(DELETE + costs[state], 0)]
        if fault != 1:
            if state in stays:
                options.append((extra + costs[stays[state]], 2))
            options.append((REROLE + extra + costs[FOLLOWING[state]], 3))
        least.append(min(options))
    # An insertion is followed by one of the others, or at the start by another insertion.
    inserted = lambda of, state: min(of[state], (INSERT + of[FOLLOWING[state]][0], 1))
    user, assistant = inserted(least, USER), inserted(least, ASSISTANT)
    later = [least[START], least[SYSTEM], user, assistant]
    later[START], later[SYSTEM] = inserted(later, START), inserted(later, SYSTEM)
    smallest = min(c for c, _ in later)
    return tuple(c - smallest for c, _ in later), sum(edit << 2 * state for state, (_, edit) in enumerate(later))


def _pointers(schema: pa.Schema, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (conv_id, position, signs), last position first, to chunks of one byte a row in forward order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # few differences of costs ever occur
        current, costs, held, first = None, ENDING, bytearray(), 0
        ready: list[tuple] = []

        def flush() -> None:
            if held:
                ready.append((current, first, bytes(reversed(held))))
                held.clear()

        for batch in batches:
            for conversation, position, signs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if conversation != current or not first:
                    flush()
                    current, costs = conversation, ENDING
                found = known.get((costs, signs))
                if found is None:
                    found = known[costs, signs] = _step(costs, signs & 3, signs >> 2)
                costs, edits = found
                held.append(edits)
                first = position
                if len(held) == chunk:
                    flush()
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
                ready.clear()
        flush()
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)

    return run


def _edits(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows with their chunks sorted in before them to edits."""
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, step, chunk, base, open_ = None, START, 0, b"", 0, False
        rows: dict[str, list] = {}

        def put(source: int | None, edit: str, cost: int, turn: int | None, role: str) -> None:
            nonlocal step
            step += 1
            for name, value in zip(("source", "conv_id", "step", "edit", "cost", "turn", "role"), (source, current, step, edit, cost, turn, role), strict=True):
                rows[name].append(value)

        def insert() -> None:
            nonlocal state
            state = FOLLOWING[state]
            put(None, "I", INSERT, None, ROLES[state])

        def end() -> None:
            while open_ and state in (SYSTEM, USER):
                insert()

        def table(texts: pa.Array) -> pa.RecordBatch:
            chosen = pc.fill_null(texts.take(pa.array(rows["source"], pa.int64())), "")
            columns = [chosen if n == "text" else pa.array(rows[n], schema.field(n).type) for n in names]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in pieces(batches, 2_000):
            rows = {n: [] for n in ("source", "conv_id", "step", "edit", "cost", "turn", "role")}
            columns = {n: batch.column(n).to_pylist() for n in ("conv_id", "position", "pointers", "turn", "role", "signs")}
            for at, (conversation, position, pointers, turn, role, signs) in enumerate(zip(*columns.values(), strict=True)):
                if pointers is not None:  # a chunk; the first one of a conversation opens it
                    if position == 1:
                        end()
                        current, state, step, open_ = conversation, START, 0, True
                    chunk, base = pointers, position
                    continue
                edits = chunk[position - base]
                while (edit := EDITS[edits >> 2 * state & 3]) == "I":
                    insert()
                if edit == "D":
                    put(at, edit, DELETE, turn, role)
                    continue
                extra = TRUNCATED if signs >> 2 == 2 else 0
                if edit == "K":
                    state = STAYS[INITIALS[signs & 3]][state]
                    put(at, edit, extra, turn, role)
                else:
                    state = FOLLOWING[state]
                    put(at, edit, REROLE + extra, turn, ROLES[state])
            if rows["edit"]:
                yield table(batch.column("text"))
        rows = {n: [] for n in rows or ("source", "conv_id", "step", "edit", "cost", "turn", "role")}
        end()
        if rows["edit"]:
            yield table(pa.array([], schema.field("text").type))

    return run


def _arrow(*fields: tuple[str, str], like: DataFrame) -> tuple[str, pa.Schema]:
    """A Spark schema of the conversation's id and ``fields``, and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = [("conv_id", like.schema["conv_id"].dataType.simpleString()), *fields]
    return ", ".join(f"{n} {k}" for n, k in kinds), pa.schema([(n, to_arrow_type(_parse_datatype_string(k))) for n, k in kinds])


def repaired(rows: DataFrame, scratch: Scratch | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edits of ``examined`` rows: ``conv_id``, ``step`` from 1, ``edit``, ``cost``, ``turn``, ``role``, ``text``.

    ``edit`` is K (keep), R (new role), D (delete) or I (insert, with an empty text and no turn);
    ``role`` and ``text`` are those after the edit. The rows of a conversation come together and in
    order; without those of D they are the repaired conversation. Of equally cheap
    repairs, the one whose edits are first in ASCII order is taken. Blank and duplicate rows are
    always deleted; a truncated row that stays costs more, but stays as it is. An empty role, as any
    role that does not begin with s, u or a, is never kept. A null id is a conversation like others.
    """
    scratch = scratch or Scratch(rows.sparkSession, "repair")
    initial = F.when(F.col("role") == "", len(INITIALS)).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(len(INITIALS))))
    signs = (initial + 4 * F.when(F.col("fault") == "truncated", 2).when(F.col("fault").isNotNull(), 1).otherwise(0)).cast("int").alias("signs")
    narrow = rows.select("conv_id", "position", signs).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("position"))
    kinds, schema = _arrow(("position", "bigint"), ("pointers", "binary"), like=rows)
    chunks = scratch.write(narrow.mapInArrow(_pointers(schema, chunk), kinds), "pointers")
    full = rows.select("conv_id", "position", F.lit(None).cast("binary").alias("pointers"), "turn", "role", "text", signs, F.lit(1).alias("kind"))
    both = full.unionByName(chunks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind").drop("kind")
    kinds, schema = _arrow(("step", "bigint"), ("edit", "string"), ("cost", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"), like=rows)
    return ordered.mapInArrow(_edits(schema), kinds)


def _digests(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From edits in order to a row for each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cost, audit, digest, lines = None, 0, bytearray(), hashlib.sha256(), 0
        done: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        for batch in pieces(batches):
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "step", "edit", "cost", "role", "text"))
            for conversation, step, edit, paid, role, text in zip(*columns, strict=True):
                if step == 1:
                    if audit:
                        done.append((current, cost, audit.decode(), digest.hexdigest()))
                    current, cost, audit, digest, lines = conversation, 0, bytearray(), hashlib.sha256(), 0
                cost += paid
                audit += edit.encode()
                if edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            if done:
                yield table()
                done.clear()
        if audit:
            done.append((current, cost, audit.decode(), digest.hexdigest()))
            yield table()

    return run


def digested(edits: DataFrame) -> DataFrame:
    """``cost``, ``audit`` and ``repaired_sha256`` of each conversation from its edits as ``repaired`` gives them."""
    kinds, schema = _arrow(("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string"), like=edits)
    return edits.select("conv_id", "step", "edit", "cost", "role", "text").mapInArrow(_digests(schema), kinds)


FAULTS = ("blank", "duplicate", "truncated")


def audited(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``conversations``, its rows being ``rows``.

    One row for every distinct ``conv_id``, null among them. A conversation without rows has no
    faults, no edits and the digest of an empty text; an empty table gives no rows. Turns
    that are null come first and count for no gap; rows of one turn are ordered by role and
    text, repeated rows are duplicates. Null roles and texts are one space. Other columns are
    not read.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = scratch.write(examined(rows), "examined")
    digests = digested(repaired(rows, scratch, chunk))
    number = lambda condition: F.sum(condition.cast("bigint"))
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - number(F.col("new_turn"))).alias("gaps"),
        *[number(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in FAULTS],
        number(F.col("illegal")).alias("illegal"),
    )
    every = conversations.select(F.col("`conv_id`").alias("conv_id")).distinct()
    parts = every.unionByName(counts, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    found = lambda name, none: F.coalesce(F.max(name), F.lit(none)).alias(name)
    return parts.groupBy("conv_id").agg(
        *[found(n, 0).cast("bigint").alias(n) for n in ("gaps", *FAULTS, "illegal", "cost")],
        found("audit", ""),
        found("repaired_sha256", hashlib.sha256(b"").hexdigest()),
    )


_SPACE = r"[\x20\x09-\x0D]"
#: The same faults and repairs as SQL: a recursion from the last row of a conversation to the first that
#: carries cost, edits and text of the best repair of the rest for each state.
SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes
  FROM conversations),
h AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, codes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS h
  FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS b, count(*) OVER (PARTITION BY conv_id) AS n
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*\z') THEN 'truncated' END AS fault FROM o),
r AS (
  SELECT conv_id, CAST(n + 1 AS BIGINT) AS i,
    {{'c': 0, 'a': '', 't': ''}} AS e0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS e1,
    {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} AS e2, {{'c': 0, 'a': '', 't': ''}} AS e3
  FROM (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id)
  UNION ALL
  SELECT conv_id, i,
    list_sort([b0, {{'c': u.c + 3, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}}])[1],
    list_sort([b1, {{'c': u.c + 3, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}}])[1], u, a
  FROM (
    SELECT conv_id, i, b0, b1,
      list_sort([b2, {{'c': b3.c + 3, 'a': 'I' || b3.a, 't': chr(10) || 'assistant:' || b3.t}}])[1] AS u,
      list_sort([b3, {{'c': b2.c + 3, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}}])[1] AS a
    FROM (
      SELECT conv_id, i,
        list_sort([{{'c': e0.c + 4, 'a': 'D' || e0.a, 't': e0.t}}, {{'c': CASE WHEN role[1] = 's' THEN e1.c WHEN role[1] = 'u' THEN e2.c ELSE 99999999 END + p,
          'a': 'K' || CASE WHEN role[1] = 's' THEN e1.a ELSE e2.a END, 't': chr(10) || role || ':' || text || CASE WHEN role[1] = 's' THEN e1.t ELSE e2.t END}}, ru])[1] AS b0,
        list_sort([{{'c': e1.c + 4, 'a': 'D' || e1.a, 't': e1.t}}, ku, ru])[1] AS b1,
        list_sort([{{'c': e2.c + 4, 'a': 'D' || e2.a, 't': e2.t}}, {{'c': CASE WHEN role[1] = 'a' THEN e3.c ELSE 99999999 END + p, 'a': 'K' || e3.a, 't': chr(10) || role || ':' || text || e3.t}},
          {{'c': e3.c + 3 + p, 'a': 'R' || e3.a, 't': chr(10) || 'assistant:' || text || e3.t}}])[1] AS b2,
        list_sort([{{'c': e3.c + 4, 'a': 'D' || e3.a, 't': e3.t}}, ku, ru])[1] AS b3
      FROM (
        SELECT r.*  REPLACE (f.i AS i), role, text, p,
          {{'c': CASE WHEN role[1] = 'u' THEN e2.c ELSE 99999999 END + p, 'a': 'K' || e2.a, 't': chr(10) || role || ':' || text || e2.t}} AS ku,
          {{'c': e2.c + 3 + p, 'a': 'R' || e2.a, 't': chr(10) || 'user:' || text || e2.t}} AS ru
        FROM r JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 99999999 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS p FROM f) f
          ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1)))),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND b || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT conv_id, e0 FROM r WHERE i = 1)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e0.c, 0) AS BIGINT) AS cost,
  coalesce(e0.a, '') AS audit, sha256(coalesce(e0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id"""
