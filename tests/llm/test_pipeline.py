from __future__ import annotations

import math

import numpy as np
from test_quality import base_counts, brute_ratio
from test_simhash import similar_groups
from test_tokens import check_packing, ids_of

import corpus_pipeline
from doclake.llm import common, pii, quality_classifier, quality_rules
from doclake.llm.queries import PII_KEY


def test_stages_against_brute_force(spark, sf_dir):
    """Every stage over all that the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        made = common.stage(stage(spark, docs, sf_dir), "test")
        inputs[name], outputs[name] = [r.asDict() for r in docs.collect()], made.collect()
        if name != "best_fit_packing":
            assert made.columns == columns
        docs = made
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "pii_pseudonyms", "best_fit_packing"]

    rows = inputs["quality_rules"]
    ratio = brute_ratio(rows, {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}, quality_rules.BUCKETS)
    good = {r["doc_id"] for r in rows if not base_counts(r["text"])[5] and ratio[r["doc_id"]] >= quality_rules.THRESHOLD}
    assert {r.doc_id for r in outputs["quality_rules"]} == good and len(good) < len(rows)

    rows = inputs["quality_classifier"]
    source = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    weights = quality_classifier.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = set()
    for r in rows:
        x = np.bincount(quality_classifier.indices(r["text"]), minlength=len(weights)).astype(float)
        x /= max(math.sqrt(x.sum()), 1e-300)
        x[-1] = 1
        if 1 / (1 + math.exp(-weights @ x)) >= 0.3:
            kept.add(r["doc_id"])
    assert {r.doc_id for r in outputs["quality_classifier"]} == kept

    rows = inputs["simhash_near_dedup"]
    group = similar_groups({r["doc_id"]: r["text"] for r in rows})
    assert len(set(group.values())) < len(group)
    assert {r.doc_id for r in outputs["simhash_near_dedup"]} == set(group.values())

    tool, rows = pii.Pseudonyms(PII_KEY), inputs["pii_pseudonyms"]
    assert {(r.doc_id, r.text, r.n_chars) for r in outputs["pii_pseudonyms"]} == {(r["doc_id"], t, len(t)) for r in rows for t in [tool.replace(r["text"])[0]]}

    want = {r["doc_id"]: [*ids_of("byte_bpe_50k.json", r["text"]), 2] for r in inputs["best_fit_packing"]}
    check_packing(list(map(tuple, outputs["best_fit_packing"])), want, 1024)


def test_odd_rows(spark, sf_dir):
    text = "Some quite ordinary words about gardens, rivers and old houses near the long road to town. " * 3
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (None, text, "en", "b", 1), (4, "x " * 50_000, "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    deduped = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert len(deduped) == 3 and sum(r.text == text for r in deduped) == 1
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.where("false"), sf_dir).collect() == []
