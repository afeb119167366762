from __future__ import annotations

import math

import numpy as np
import pytest
from llm_help import components

from doclake.llm import embedding_dedup as near
from doclake.llm.queries import op7_embedding_near_dedup


def brute(rows, threshold=0.93):
    """Links between rows (id, vector, label) by place."""
    usable = [i for i, (_, v, y) in enumerate(rows) if y is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for y in {rows[i][2] for i in usable}:
        for n in {len(rows[i][1]) for i in usable}:
            at = [i for i in usable if rows[i][2] == y and len(rows[i][1]) == n]
            if at:
                x = np.array([rows[i][1] for i in at], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links += [(at[a], at[b], c) for (a, b), c in np.ndenumerate(x @ x.T) if a < b and c >= threshold - 1e-12]
    return links


def test_op7_finds_the_links(spark, sf_dir, tmp_path):
    """The table, which has no links, and disturbed copies of its vectors."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    for i, v, y in rows[:400]:
        x = np.array(v)
        noise = rng.standard_normal(len(x)) * np.linalg.norm(x) / np.sqrt(len(x))
        rows.append((10_000 + i, (x + noise * rng.uniform(0, 0.5)).astype(np.float32).tolist(), y))
    spark.createDataFrame(rows, table.schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in op7_embedding_near_dedup(spark, str(tmp_path)).collect()}
    links = brute(rows)
    n = dict.fromkeys((r[0] for r in rows), 0)
    for a, b, _ in links:
        n[rows[a][0]] += 1
        n[rows[b][0]] += 1
    assert len(got) == len(rows) and all(got[i].n_links <= k for i, k in n.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n.values()) > 300
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    whole = components(n, [(rows[a][0], rows[b][0]) for a, b, _ in links])
    assert sum(got[i].component_id == c for i, c in whole.items()) >= 0.98 * len(rows)


@pytest.mark.parametrize("small", [2, 32])
def test_exact_where_tables_suffice(spark, monkeypatch, small):
    monkeypatch.setattr(near, "TILE", 8)
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "PAIRS", 7)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    vectors = [(base[i % 12] + rng.standard_normal(16) * 0.12).tolist() for i in range(150)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[i], i % 3) for i in range(9)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] * 16, 1), (303, [math.inf] + [0.0] * 15, 1), (304, vectors[0], None), (305, [None] + vectors[0][1:], 0), (306, [], 0), (307, vectors[0] + [0.0], 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, n int")
    got = {r.id: r for r in near.near_duplicates(df, recall=0.9999999).collect()}
    links = brute(rows)
    n = dict.fromkeys((r[0] for r in rows), 0)
    for a, b, _ in links:
        n[rows[a][0]] += 1
        n[rows[b][0]] += 1
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component for i, r in got.items()} == components(n, [(rows[a][0], rows[b][0]) for a, b, _ in links])


def test_repeated_and_null_ids(spark):
    v, w = [1.0, 2.0], [-2.0, 1.0]
    rows = [(None, v, 1), (5, v, 1), (5, v, 1), (None, w, 1), (None, None, 1)]
    got = sorted(near.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True), (None, 0, None, True)], key=repr)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near.near_duplicates(empty).collect() == []


def test_large_and_tiny_numbers_link(spark):
    """Squares that overflow or vanish lose no link."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-300, 1e-300], 1), (4, [1.0, -1.0], 1), (5, [5e-324, 0.0], 1)]
    got = {r.id: (r.n_links, r.component) for r in near.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=0.9999999).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_the_chance_to_find_a_pair_is_the_planned_one():
    """Pairs at the threshold, however many other vectors there are: signatures see only the two of them."""
    rng = np.random.default_rng(4)
    n, d, tables = 20_000, 32, near.plan_tables(0.93)
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, d))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    met = (near.signatures(a, near.BITS, tables, 17) == near.signatures(b, near.BITS, tables, 17)).any(axis=1)
    assert met.mean() > 0.98
