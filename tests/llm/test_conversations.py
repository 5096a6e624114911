"""Conversation repair against SQL, brute force over all edits, giant conversations and odd tables."""

import binascii
import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

from corpus import MIDDLE, SPACED, table

from matchlake.llm import conversations as repair

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparison import connect, normal, rows_of_sql  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string, step string, edit int, position string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "p") for r in rows], SCHEMA)


def audit(spark, rows, damage=True):
    given = frame(spark, rows)
    return {r.conv_id: r for r in repair.audited(given, repair.damaged(given) if damage else given).collect()}


def hurt(rows):
    """The rows after damage, one by one."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def faults(rows):
    """Rows of one conversation in order, with their first fault."""
    seen = set()
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        said = SPACED.findall(text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1][-1] not in ".!?" else None
        seen.add((role, text))
        yield turn, role, text, fault


def brute(rows):
    """The cheapest edits over all choices, with up to two insertions before each row and at the end."""
    rows, best = list(faults(rows)), None
    gaps = [n for n in range(3)]
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and r[3] in ("blank", "duplicate") for e, r in zip(edits, rows, strict=True)):
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(ins) + edits.count("R")):
                given, cost, marks, out = iter(roles), 0, "", []
                for i in range(len(rows) + 1):
                    for _ in range(ins[i]):
                        cost, marks = cost + 3, marks + "I"
                        out.append((next(given), ""))
                    if i < len(rows):
                        _, role, text, fault = rows[i]
                        marks += edits[i]
                        cost += {"D": 4, "K": 0, "R": 3}[edits[i]] + (3 if edits[i] != "D" and fault == "truncated" else 0)
                        if edits[i] != "D":
                            out.append((next(given) if edits[i] == "R" else role, text))
                if best and (cost, marks) >= best[:2]:
                    continue
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                    best = cost, marks, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return best


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Fine.", "Yes!", "cut of", " ", "", "Why? ", "Other.", "And\n."]
    roles = ["user", "assistant", "system", "tool", "unknown", ""]
    for conv in range(conversations):
        for turn in range(rng.randrange(longest + 1)):
            yield conv, turn, rng.choices(roles, [5, 5, 2, 1, 1, 0.3])[0], rng.choice(texts)


def test_equals_sql(spark):
    given = table(spark, MIDDLE, "conversations")
    found = repair.audited(given, repair.damaged(given))
    assert normal(found.columns, [tuple(r) for r in found.collect()]) == normal(*rows_of_sql(connect(MIDDLE), repair.SQL))


def test_equals_brute_force(spark):
    rows = list(random_rows(1, 150, 3))
    found = audit(spark, rows, damage=False)
    for conv, given in itertools.groupby(rows, key=lambda r: r[0]):
        assert (found[conv].cost, found[conv].audit, found[conv].repaired_sha256) == brute(given)


def test_damage_faults_and_edge_cases(spark):
    rows = [(i, t, r, x) for i, t, r, x in random_rows(2, 60, 3)]
    rows += [(900, None, "user", "No turn."), (900, None, "assistant", None), (900, 7, None, "x."), (None, 1, "user", "Hm."), (None, None, None, None)]
    rows += [(901, 5, "user", "Hi."), (901, 5, "user", "Hi."), (901, 5, "assistant", "Ho."), (902, None, "user", "a" * 300_000 + ".")]
    found = audit(spark, rows)
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        left = list(hurt(r for r in rows if r[0] == conv))
        known = list(faults(left))
        turns = [t for t, *_ in known if t is not None]
        assert found[conv].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        for fault in repair.FAULTS:
            assert found[conv][fault] == sum(k[3] == fault for k in known)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(known)]
        assert found[conv].illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        if len(left) <= 4:
            assert (found[conv].cost, found[conv].audit, found[conv].repaired_sha256) == brute(left)


def test_giant_conversation_passes_chunks(spark):
    """The same repair whatever the chunk, and one that meets the grammar at the cost it says."""
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "system"]) for _ in range(9_000)]
    rows = [(1, i, r, f"Text {i}." if i % 7 else "cut") for i, r in enumerate(roles)] + [(2, 0, "user", "Hi.")]
    whole = audit(spark, rows, damage=False)
    given = frame(spark, rows)
    assert {r.conv_id: r for r in repair.audited(given, given, chunk=64).collect()} == whole
    edits = sorted(repair.repaired(repair.examined(frame(spark, rows))).where("conv_id = 1").collect(), key=lambda r: r.step)
    assert [e.step for e in edits] == list(range(1, len(edits) + 1))
    assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in edits if e.edit != "D"))
    assert sum(e.cost for e in edits) == whole[1].cost and "".join(e.edit for e in edits) == whole[1].audit
    text = "\n".join(f"{e.role}:{e.text}" for e in edits if e.edit != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == whole[1].repaired_sha256
    assert whole[2].audit == "KI" and whole[2].cost == 3


def test_empty_table(spark):
    assert audit(spark, []) == {}
