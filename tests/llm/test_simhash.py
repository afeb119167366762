from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from doclake.llm import simhash
from doclake.llm.components import connected_components, forest
from doclake.llm.queries import op1_simhash_near_dedup
from llm_help import components


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB \t\n\x0b É.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == brute_fingerprint(text)


def near(values, radius=4):
    return [(a, b) for a, b in itertools.combinations(values, 2) if bin(a ^ b).count("1") <= radius]


def test_query_equals_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_near_dedup(spark, sf_dir).collect()}
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in documents}
    of = {}
    for doc_id, fp in sorted(fps.items()):
        of.setdefault(fp, doc_id)
    links = [(of[a], of[b]) for a, b in near(sorted(of))]
    same = [(of[fp], doc_id) for doc_id, fp in fps.items()]
    want = components(fps, links + same)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in fps.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("tile", [7, 16_384])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    mask = (1 << 64) - 1
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & mask).count("1") <= 4]
    want = components(signed, links)
    assert {v: roots.get(v, v) for v in signed} == want


def test_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.collect()
    got = simhash.near_duplicates(odd_documents).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        if r.doc_id is not None:
            by_text.setdefault(brute_fingerprint(r.text), []).append(r.doc_id)
    for r in got:
        assert r.component == min(by_text[int(r.fingerprint, 16)], default=None) or r.component is not None
    assert {r.component for r in got if int(r.fingerprint, 16) == 0} == {min(by_text[0])}
    assert simhash.near_duplicates(no_documents).collect() == []


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_forest_connects_the_same(links):
    child, root = forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    assert components(range(13), links) == components(range(13), list(zip(child.tolist(), root.tolist())))
    assert len(child) == len(set(child.tolist()))


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)] + [(None, 5), (7, None), (2000, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def similar_groups(texts: dict, least: float = 0.8) -> dict:
    """The least id that links of similar texts reach, every text compared with every other that shares a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders: dict = {}
    for i, s in sets.items():
        for x in s or [()]:
            holders.setdefault(x, []).append(i)
    links = set()
    for found in holders.values():
        for a, b in itertools.combinations(found, 2):
            if (a, b) not in links and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                links.add((a, b))
    return components(texts, links)


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    """Edited copies of all kinds, in many small tiles: no link is missed, none is made up, and groups may be large."""
    monkeypatch.setattr(simhash, "TILE", 25)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 3_000)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3_000)]
    texts: dict = {}
    for k in range(40):
        words = rng.choices(vocabulary, k=rng.choice((3, 40, 120, 400)))
        for _ in range(rng.choice((1, 2, 6))):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts[len(texts)] = rng.choice((" ", "\n")).join(edited).replace("w1", "W1")
    many = rng.choices(vocabulary, k=200)
    for _ in range(60):
        many[rng.randrange(200)] = rng.choice(vocabulary)
        texts[len(texts)] = " ".join(many)
    texts |= {1000: "", 1001: None, 1002: " \n", 1003: "one", 1004: "ONE", 1005: "one two", 1006: "x " * 30_000}
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], "doc_id long, text string, key string, n int")
    got = {r.id: r.component for r in simhash.similar_texts(df).collect()}
    assert got == similar_groups(texts)
    assert len(set(got.values())) < len(got) - 60
    assert simhash.similar_texts(df.where("false")).collect() == []
