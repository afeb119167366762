from __future__ import annotations

import math
import re
import zlib

import numpy as np
import regex
import xxhash

from doclake.llm import queries, quality_classifier, quality_rules


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen: dict = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    repeated = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def buckets_of(text: str | None, n: int) -> list[int]:
    pieces = regex.findall(r"\p{Ll}+|[\p{L}--\p{Ll}]+|[^\p{L}\x20\x09-\x0D]+", text or "", flags=regex.V1)
    hashes = [signed(xxhash.xxh64_intdigest(p.encode(), seed=42)) for p in pieces]
    chained = lambda a, b: signed(xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), seed=42)))
    return [h % n for h in hashes] + [chained(a, b) % n for a, b in zip(hashes, hashes[1:])]


def brute_ratio(documents, trusted: set, n: int) -> dict:
    grams = {d["doc_id"]: buckets_of(d["text"], n) for d in documents}
    every = np.bincount([b for g in grams.values() for b in g], minlength=n)
    good = np.bincount([b for i, g in grams.items() if i in trusted for b in g], minlength=n)
    p, q = (good + 1) / (good.sum() + n), (every + 1) / (every.sum() + n)
    w = np.log(p) - np.log(q)
    return {i: math.fsum(w[g]) / len(g) if g else 0.0 for i, g in grams.items()}


def test_op5_equals_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    ratio = brute_ratio(documents, {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}, quality_rules.BUCKETS)
    for d in documents:
        counts = base_counts(d["text"])
        assert tuple(got[d["doc_id"]])[1:7] == counts
        if abs(ratio[d["doc_id"]] - quality_rules.THRESHOLD) > 1e-9:
            assert got[d["doc_id"]].kept == (not counts[5] and ratio[d["doc_id"]] >= quality_rules.THRESHOLD)
    assert len(got) == len(documents)
    good = [got[r.doc_id] for r in labels if r.quality == 1 and r.doc_id in got and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id] for r in labels if r.quality == 0 and r.doc_id in got]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_the_ratio_refuses_what_base_counts_let_pass(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, sf_dir).collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got and not got[r.doc_id].base_failed]
    good, bad = ([got[r.doc_id].kept for r in labels if r.quality == y] for y in (1, 0))
    assert len(bad) > 20 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)


def test_rules_on_odd_rows(spark, odd_documents, no_documents):
    extra = odd_documents.selectExpr("*", "true as kept", "1 as n_words")
    trusted = spark.createDataFrame([(0,), (None,), (0,)], "doc_id long")
    got = quality_rules.quality_rules(extra, trusted)
    rows = got.collect()
    assert len(rows) == extra.count() and got.columns.count("kept") == 1 and got.columns.count("n_words") == 1
    want = sorted(((r.doc_id, *base_counts(r.text)) for r in extra.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr) == want
    assert quality_rules.quality_rules(no_documents, trusted).collect() == []
    nobody = quality_rules.quality_rules(extra, trusted.where("doc_id = 99")).collect()
    assert all(r.llr == 0 for r in nobody)


def test_all_trusted_documents_count(spark):
    """More of them than any fixed number of ids: each has a word of its own, and a null id is never trusted."""
    n, buckets = 9_000, 1 << 20
    rows = [(i, f"w{chr(97 + i % 26)} {i}") for i in range(n)] + [(None, "nameless"), (n, "distrusted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = quality_rules.fit_weights(docs, spark.createDataFrame([(i,) for i in [*range(n), None]], "doc_id long"), buckets=buckets)
    every = np.bincount([b for _, t in rows for b in buckets_of(t, buckets)], minlength=buckets)
    good = np.bincount([b for i, t in rows if i is not None and i < n for b in buckets_of(t, buckets)], minlength=buckets)
    want = np.log((good + 1) / (good.sum() + buckets)) - np.log((every + 1) / (every.sum() + buckets))
    assert np.abs(weights - want).max() < 1e-12


def test_repeats_and_lines(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "x\ny\nx\n\n\nx ", "l1\nl1\nl2", "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z aa bb cc"]
    rows = quality_rules.with_base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows] == list(map(base_counts, texts))


# ── classifier ───────────────────────────────────────────────────────────────────────────────────────────────────────────


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op8_is_right_on_rows_it_has_not_seen(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op8_quality_classifier(spark, sf_dir).collect()
    assert all(r.held_out == is_held_out(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    right = sum(r.predicted == y for r, y in held)
    assert len(held) > 30 and right >= 0.9 * len(held)


def test_scores_see_nothing_but_texts(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = labels.withColumn("quality", (1 - labels.quality)).where(quality_classifier.held_out("doc_id"))
    other = labels.where(~quality_classifier.held_out("doc_id")).unionByName(held)
    score = lambda d, y: {r.doc_id: r.score for r in quality_classifier.quality_classifier(d, y).select("doc_id", "score").collect()}
    assert score(docs, labels) == score(docs.drop("lang", "source"), other)


def test_scores_equal_a_dense_product(spark, documents):
    weights = np.random.default_rng(1).standard_normal(quality_classifier.DIMENSIONS)
    rows = [(d["doc_id"], d["text"]) for d in documents[:40]]
    got = quality_classifier.with_score(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()
    for r in got:
        x = np.bincount(quality_classifier.indices(r.text), minlength=quality_classifier.DIMENSIONS).astype(float)
        x /= max(np.sqrt(x.sum()), 1e-300)
        x[-1] = 1
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, weights @ x))))) < 1e-9


def plain_ftrl(rows: list[tuple[dict[int, float], int]], epochs: int) -> dict[int, float]:
    """Proximal follow-the-regularised-leader for logistic loss, one coordinate after the other, from its definition."""
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 1.0
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(k: int) -> float:
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def plain_features(text: str | None) -> dict[int, float]:
    """Counts of hashed words, pairs and repeats over the square root of all of them, and the bias."""
    words = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
    pairs = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32 for a, b in zip(words, words[1:])]
    runs = (text or "").split()
    same = [zlib.crc32(b"\0same word") for a, b in zip(runs, runs[1:]) if a == b]
    last = quality_classifier.DIMENSIONS - 1
    counts: dict[int, float] = {}
    for f in words + pairs + same:
        counts[f % last] = counts.get(f % last, 0) + 1
    total = math.sqrt(max(1, sum(counts.values())))
    return {k: v / total for k, v in counts.items()} | {last: 1.0}


def test_training_is_plain_ftrl(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_classifier.train(docs, labels)
    order = labels.join(docs.select("doc_id", "text"), "doc_id").selectExpr("doc_id", "quality", "text", "xxhash64(doc_id) as h").orderBy("h", "doc_id").collect()
    rows = [(plain_features(r.text), r.quality) for r in order if not is_held_out(r.doc_id)]
    want = plain_ftrl(rows, quality_classifier.EPOCHS)
    dense = np.zeros(quality_classifier.DIMENSIONS)
    dense[list(want)] = list(want.values())
    assert len(rows) > 40 and np.abs(got - dense).max() < 1e-9 and np.count_nonzero(dense) > 10
    few = quality_classifier.train(docs, labels, rows=10)
    want = plain_ftrl(rows[:10], quality_classifier.EPOCHS)
    assert abs(few[-1] - want[quality_classifier.DIMENSIONS - 1]) < 1e-9 and np.count_nonzero(few) <= len(want)


def test_classifier_on_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    extra = odd_documents.selectExpr("*", "'mine' as score", "1 as y")
    got = quality_classifier.quality_classifier(extra, labels).collect()
    assert len(got) == extra.count() and all(0 <= r.score <= 1 for r in got)
    by_text: dict = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality_classifier.quality_classifier(no_documents, labels).collect() == []
    unlabelled = quality_classifier.quality_classifier(extra, labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}
