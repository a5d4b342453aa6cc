"""Every stage of the pipeline against a plain version on its own input."""

import pandas as pd

import corpus_pipeline
from tests.llm.test_corpus import documents, linked_by_force, plain_fingerprint, plain_spans
from traceloom.llm import quality_rules, secret_scan
from traceloom.session import pin

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = pin(stage["quality_rules"](spark, docs, FOLDER))
    book = quality_rules.ledger(docs).where(quality_rules.kept(quality_rules.STANDARD))
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in book.select("doc_id").collect())
    assert good.columns == docs.columns and 0 < good.count() < docs.count()

    one = pin(stage["simhash_near_dedup"](spark, good, FOLDER))
    before = good.toPandas().sort_values("doc_id")
    roots = linked_by_force([plain_fingerprint(t) for t in before.text])
    least = {}
    for doc, r in zip(before.doc_id, roots):
        least.setdefault(r, doc)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(least.values())

    clean = pin(stage["benchmark_decontamination"](spark, one, FOLDER))
    items = [" ".join(t.lower().split()) for t in pd.read_parquet(f"{FOLDER}/benchmark.parquet").text]
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    leaking = {d for d, t in rows.items() if any(i in " ".join((t or "").lower().split()) for i in items)}
    assert {r[0] for r in clean.select("doc_id").collect()} == set(rows) - leaking and leaking

    safe = pin(stage["secret_scan"](spark, clean, FOLDER))
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert not any(plain_spans(r["text"] or "") for r in safe.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect() if "<secret>" in (r["text"] or ""))

    packed = stage["best_fit_packing"](spark, safe, FOLDER).toPandas()
    assert set(packed.doc_id) == {r[0] for r in safe.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_run_ends_with_sequences_of_kept_documents(spark):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert len(got) and set(got.doc_id) <= set(documents().doc_id)
    assert secret_scan.KINDS[:3] == ("assign", "access", "hex")
