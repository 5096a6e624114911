"""The pipeline: each stage on its predecessor's documents, against brute force."""

import sys
from pathlib import Path

import test_decontaminate
import test_neardup
from corpus import MIDDLE, documents, odd_rows, table

from matchlake.llm import decontaminate, mixing, neardup, pii, rules

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def test_stages_in_turn(spark):
    docs = table(spark, MIDDLE, "documents")
    columns, kinds = docs.columns, docs.dtypes
    labels, items = table(spark, MIDDLE, "labels"), table(spark, MIDDLE, "benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = corpus_pipeline.quality(spark, docs, MIDDLE)
    accepted = {r.doc_id for r in rules.quality(docs, labels).where("predicted = 1").collect()}
    assert good.dtypes == kinds and {r.doc_id for r in good.collect()} == accepted
    assert 0.7 < len(accepted) / len(texts) < 1

    single = corpus_pipeline.near_duplicates(spark, good, MIDDLE)
    alone = {i for i, _, _, kept in test_neardup.brute([(i, texts[i]) for i in accepted], 5) if kept}
    assert single.dtypes == kinds and sorted(r.doc_id for r in single.collect()) == sorted(alone)

    clean = corpus_pipeline.decontamination(spark, single, MIDDLE)
    pairs = [(r.item_id, r.text) for r in items.collect()]
    unseen = {r[0] for r in test_decontaminate.brute([(i, texts[i]) for i in alone], pairs) if not r[5]}
    assert clean.dtypes == kinds and sorted(r.doc_id for r in clean.collect()) == sorted(unseen)

    field = pii.train(clean)
    masked = corpus_pipeline.personal_data(spark, clean, MIDDLE)
    rows = masked.collect()
    assert masked.columns == columns and sorted(r.doc_id for r in rows) == sorted(unseen)
    assert all(r.text == pii.masked(texts[r.doc_id], field) and r.n_chars == len(r.text) for r in rows)
    assert not any(pii.base_spans(r.text) for r in rows)

    final = corpus_pipeline.mixture(spark, masked, MIDDLE)
    kept = {r.doc_id for r in mixing.mixture(masked).where("kept").collect()}
    assert final.columns == columns and {r.doc_id for r in final.collect()} == kept and 0 < len(kept) < len(unseen)
    assert {r.doc_id for r in corpus_pipeline.run(spark, MIDDLE).collect()} == kept


def test_names_and_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    assert all(callable(x) for x in (neardup.deduplicated, decontaminate.decontaminated))


def test_odd_documents(spark):
    """Every stage takes odd rows and an empty table, with columns that clash."""
    for rows in (odd_rows(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, MIDDLE)
            assert docs.columns == documents(spark, []).columns
            docs.collect()
