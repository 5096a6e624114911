"""Personal data: base spans against plain patterns, the random field on its own, odd rows."""

import hashlib
import random
import re
import time

import pytest
from corpus import MIDDLE, documents, odd_rows, table

from matchlake.llm import common, pii


def checksum(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    text = text or ""
    found = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(f"ip:{m.start()}:{m.end()}")
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or checksum(digits)):
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(table(spark, "/root/testdata/sf0.1", "documents"))


def test_base_spans_of_random_texts():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B9", "@", ".", "+", "-", " ", "1", "255", "4111 1111 1111 1111", "%", "(", ")", "é", "x@y.z", "٣"]) for _ in range(rng.randrange(30)))
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == brute(text), text


def test_whole_table(spark, field):
    docs = table(spark, MIDDLE, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in pii.personal_data(docs, field).collect():
        base = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        assert set(base) <= set(row.spans.split(",") if row.spans else [])


def test_field_alone_finds_base_spans(spark, field):
    """Decoding knows boundaries and types without the patterns."""
    whole = found = extra = 0
    for row in table(spark, MIDDLE, "documents").collect():
        base = set(pii.base_spans(row.text))
        decoded = {s for start, piece in pii.stretches(row.text) for s in field.decode(pii.Stretch(piece, start))}
        whole, found, extra = whole + len(base), found + len(base & decoded), extra + len(decoded - base)
    assert whole > 30 and found / whole > 0.95 and extra / whole < 0.2


def test_field_adds_local_numbers(field):
    assert pii.masked("ask (301) 555-0199 now", field) == "ask [PHONE] now"
    assert pii.masked("mail a.b@c.org, ip 1.2.3.4.", field) == "mail [EMAIL], ip [IP]."
    clean = "in 2019 we sold 35 of 120 units at 9.99 each, see page 4"
    assert pii.masked(clean, field) == clean
    assert pii.masked(None, field) is None and pii.masked("", field) == ""


def test_odd_rows(spark, field):
    docs = documents(spark, [*odd_rows(), (20, "a@b.co a@b.co"), (20, "a@b.co a@b.co"), (21, "1" * 300_000), (22, "9 " * 30_000), (23, "x@" * 30_000)])
    found = pii.personal_data(docs, field).collect()
    assert len(found) == len(odd_rows()) + 5
    assert [r.n_email for r in found if r.doc_id == 20] == [2, 2]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in found if r.doc_id in (1, 2, 3))
    done = pii.redacted(docs, field)
    assert done.columns == docs.columns
    rows = {r.doc_id: r for r in done.collect()}
    assert rows[20].text == "[EMAIL] [EMAIL]" and rows[20].n_chars == 15 and rows[1].text is None and rows[1].n_chars is None
    assert pii.personal_data(documents(spark, [])).collect() == []
    assert pii.redacted(documents(spark, [])).collect() == []


def test_long_texts_take_linear_time(field):
    for text in ("x" * 1_000_000, "1" * 1_000_000, "a@" * 50_000):
        began = time.perf_counter()
        pii.find(text, field)
        assert time.perf_counter() - began < 30


def test_many_spans_take_linear_time():
    """Half of 100,000 spans are the field's; those that touch a pattern's are left out."""

    class Stub:
        def decode(self, stretch):
            return [(3, m.start() + shift, m.end() + shift) for m in re.finditer("n[0-9]+|x", stretch.text)]

    class Stretches:
        def __init__(self, text, start=0):
            global shift
            self.text, shift = text, start

    text = " ".join(f"n{k} ax{k}@b.com" for k in range(50_000))
    began = time.perf_counter()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "Stretch", Stretches)
        base, spans = pii.find(text, Stub())
    assert time.perf_counter() - began < 20
    assert len(base) == 50_000 and len(spans) == 100_000
    assert all(text[s] == "n" for k, s, _ in spans if k == 3)


def test_thinned_keeps_the_share(spark):
    rows = spark.range(200_000)
    assert rows.where(common.thinned("id", 1.0)).count() == 200_000
    assert 800 < rows.where(common.thinned("id", 0.005)).count() < 1_200
    # What a sample of 300 of 10^10 rows asks for is not rounded to nothing.
    parts = rows.select(common.thinned("id", 300 / 1e10).alias("kept"))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "0.03" in plan and rows.where(common.thinned("id", 3e-5)).count() > 0


def test_spans_at_every_offset_of_long_stretches(field):
    """A number is found whole wherever it stands in a stretch of over 256 characters."""
    number = "(301) 555-0199"
    for offset in range(225, 290):
        before = "9.99 " * (offset // 5) + "7" * (offset % 5 - 1) + " " * (offset % 5 > 1)
        text = before + number + " 9.99" * 80
        assert len(list(pii.stretches(text))) == 1
        added = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.find(text, field)[1] if e > len(before) and s < len(before) + len(number)]
        assert added == [("phone", number)], offset
    listed = " ".join(f"({200 + k}) 555-0{100 + k}" for k in range(300))
    assert pii.masked(listed, field) == " ".join(["[PHONE]"] * 300)


def test_decodes_the_best_segmentation(field):
    """Rows of scores that are let go do not change the result."""
    rng = random.Random(3)
    outside, count = len(pii.KINDS), len(pii.KINDS) + 1
    for _ in range(30):
        stretch = pii.Stretch(" ".join(rng.choice(["(301) 555-0199", "1.2.3.4", "a@b.co", "9", "x7-", "4111 1111"]) for _ in range(25)))
        ends = field._scored(stretch)
        best = [[0.0 if k == outside else -float("inf") for k in range(count)]]
        for found in ends[1:]:
            best.append([max((best[i][b] + field.follows[b, k] + s for i, kind, s in found if kind == k for b in range(count)), default=-float("inf")) for k in range(count)])
        value, at, last = 0.0, 0, outside
        starts, stops = {a: k for k, a in enumerate(stretch.starts)}, {b: k + 1 for k, b in enumerate(stretch.stops)}
        path = [(starts[s], stops[e], k) for k, s, e in field.decode(stretch)]
        for i, j, kind in [*path, (len(stretch.starts), None, None)]:
            for _ in range(at, i):
                value, last = value + field.follows[last, outside], outside
            if j:
                value, last, at = value + field.follows[last, kind] + field.score(kind, stretch.segments[i, j]), kind, j
        assert value == pytest.approx(max(best[-1]))
