"""Licence scans: base places against a plain search, quoted templates, odd rows."""

from corpus import ALNUM, MIDDLE, documents, lower, odd_rows, table

from matchlake.llm import licences


def brute(text):
    words, places = ALNUM.findall(lower(text)), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def test_whole_table(spark):
    docs = table(spark, MIDDLE, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = licences.licences(docs).collect()
    assert len(found) == len(texts)
    for row in found:
        assert base(row) == brute(texts[row.doc_id])
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_quoted_templates(spark):
    mit = licences.TEMPLATES[1][1]
    words = mit.split()
    changed = " ".join(words[:20] + ["really"] + words[20:30] + words[31:])
    rows = [
        (1, mit), (2, f"so: {changed} end"), (3, " ".join(words[:6])), (4, " ".join(reversed(words))),
        (5, f"{mit} ... " * 3), (6, "MIT License"), (7, "licensed under cc by nc 4.0"), (8, "the software is free of charge to any person"),
    ]
    found = {r.doc_id: r for r in licences.licences(documents(spark, rows)).collect()}
    assert [found[k].labels for k in range(1, 9)] == ["mit", "mit", "", "", "mit", "mit", "cc-by-nc", ""]
    assert found[1].score == 1.0 and 0.8 < found[2].score < 1.0 and found[6].score == 0.9 and found[8].score == 0.0
    spans = licences.licence_spans(documents(spark, rows[:2])).orderBy("first_word").collect()
    # An inserted and a missing word shift the diagonal; the parts are one span.
    count = len(ALNUM.findall(lower(mit)))
    assert [(s.first_word, s.last_word) for s in spans] == [(0, count - 1), (1, count)]


def test_odd_rows(spark):
    rows = [*odd_rows(), (30, "mit license"), (30, "mit license"), (None, "Apache License!"), (31, "MIT-License apache\nLICENSE general public license" * 2000)]
    found = licences.licences(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted(base(r) for r in found if r.doc_id == 30) == [brute("mit license")] * 2
    assert next(r for r in found if r.doc_id == 31).n_base == brute(rows[-1][1])[1]
    assert [r.labels for r in found if r.doc_id is None and r.n_base] == ["apache"]
    assert all(base(r) == (0, 0, None, None, "") and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert licences.licences(documents(spark, [])).collect() == []


def test_spans_are_verified(spark):
    notice = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    mit = licences.TEMPLATES[1][1]
    drift = "the software to deal in " * 12
    kinds = ["", "-NonCommercial", "-ShareAlike", "-NonCommercial-ShareAlike", "-NoDerivatives", "-Non-Commercial"]
    rows = [(k, f"Text. {notice.format(kind)}. More text.") for k, kind in enumerate(kinds)]
    rows += [(6, notice.format("") + " and " + notice.format("-ShareAlike")), (7, "CC: Licensed under CC BY-NC-SA 4.0.")]
    rows += [(8, f"{drift} {mit} {drift}"), (9, "of the software " * 200)]
    found = {r.doc_id: r.labels for r in licences.licences(documents(spark, rows)).collect()}
    assert found == {0: "cc-by", 1: "cc-by-nc", 2: "cc-by-sa", 3: "", 4: "", 5: "cc-by-nc", 6: "cc-by,cc-by-sa", 7: "", 8: "mit", 9: ""}


def test_chains_that_are_not_compact_are_cut():
    line = lambda d, votes: {"diagonal": d, "votes": votes, "first": d, "last": d + 9}
    far = [line(d, 1) for d in range(0, 100, 3)] + [line(50, 10)]
    regions = list(licences._regions(sorted(far, key=lambda v: v["diagonal"]), 10))
    assert regions[0] == (47, 65) and len(regions) > 5
    assert list(licences._regions([line(5, 8), line(6, 2)], 10)) == [(5, 18)]
