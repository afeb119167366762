from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from doclake.llm import bpe, packing, queries, token_counts, token_files
from doclake.llm.common import scratch, text_slices

LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids_of(name: str, text: str | None) -> list[int]:
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


texts = st.lists(st.none() | st.text(alphabet=st.sampled_from("abZé'sIt,.-_ 1\n\t<|>　ßñ你́Σ"), max_size=40), max_size=6)


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@given(found=texts)
@settings(max_examples=150, deadline=None)
def test_encoder_gives_the_librarys_ids(name, spaced, found):
    ids, counts = bpe.encoder(name, spaced).encode(pa.array(found, pa.string()))
    stops = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(stops, counts)] == [ids_of(name, t) for t in found]


@given(found=texts)
@settings(max_examples=150, deadline=None)
def test_counts_are_the_librarys(found):
    counter = bpe.counter("byte_bpe_50k.json")
    want = [len(ids_of("byte_bpe_50k.json", t)) for t in found]
    assert [counter.count(t) for t in found] == want and counter.counts(pa.array(found, pa.string())).tolist() == want


def test_memo_forgets_and_stays_right():
    counter = bpe.MergeCounter("byte_bpe_50k.json")
    counter.limit = counter.words.limit = 3
    for text in ("one two three four", "two, five six", "one two", "seven eight nine one", "x" * 100, "one\ttwo three four five"):
        assert counter.count(text) == len(ids_of("byte_bpe_50k.json", text))
        assert all(len(memo) <= 3 and len(memo.old) <= 3 and all(len(k) <= 64 for k in memo) for memo in (counter, counter.words))
    counter.forget()
    assert not counter and not counter.old and not counter.words and not counter.words.old
    encoder = bpe.Encoder("word_bpe_49k.json", False)
    assert encoder.encode(pa.array(["one, two!"]))[0].tolist() == ids_of("word_bpe_49k.json", "one, two!") and encoder.tails
    encoder.forget()
    assert not encoder.tails


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "b", "c" * 5, ""])], ["t"])
    assert [s.num_rows for s in text_slices(batch, 0, 8)] == [1, 4]
    assert list(text_slices(batch.slice(0, 0), 0)) == []


def test_op2_equals_the_library(spark, sf_dir, documents):
    got = sorted(queries.op2_token_binary_output(spark, sf_dir).collect())
    want, at = [], 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*ids_of("word_bpe_49k.json", d["text"]), 1]
        want.append((d["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    assert list(map(tuple, got)) == want


@pytest.mark.parametrize("bits", [False, True])
def test_files_of_odd_rows(spark, odd_documents, no_documents, monkeypatch, bits):
    index = token_files.write_tokens(odd_documents, scratch(spark, "tokens"), bits=bits)
    got = token_files.read_tokens(index).collect()
    want = [(r.doc_id, [*ids_of("word_bpe_49k.json", r.text), 1]) for r in odd_documents.collect()]
    assert sorted(((r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == sorted(want, key=repr)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    known = [r.id for r in by_start if r.id is not None]
    assert known == sorted(known) and all(r.id is None for r in by_start[: len(by_start) - len(known)])
    empty = token_files.write_tokens(no_documents, scratch(spark, "tokens"), bits=bits)
    assert token_files.read_tokens(empty).collect() == []


@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1), max_size=50), max_size=5), st.booleans(), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_chunk_round_trip(docs, bits, block):
    data = token_files.encode_chunk(list(range(len(docs))), [np.array(d, "<u4").tobytes() for d in docs], bits, block)
    ids, counts, flat = token_files.decode_chunk(data)
    assert ids == list(range(len(docs))) and counts.tolist() == list(map(len, docs)) and flat.tolist() == [x for d in docs for x in d]


def test_op6_equals_the_library(spark, sf_dir, documents):
    got = sorted(map(tuple, queries.op6_token_counts(spark, sf_dir).collect()))
    n = {d["doc_id"]: len(ids_of("byte_bpe_50k.json", d["text"])) for d in documents}
    assert got == sorted((d["doc_id"], len((d["text"] or "").encode()), n[d["doc_id"]], n[d["doc_id"]] > 512) for d in documents)


def test_counts_of_odd_rows(spark, odd_documents, no_documents):
    got = token_counts.token_counts(odd_documents).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(ids_of("byte_bpe_50k.json", r.text))) for r in odd_documents.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(no_documents).collect() == []


def check_packing(rows, want: dict, capacity: int) -> int:
    """Pieces are whole and right, and sequences have neither gaps nor overlaps; gives the number of sequences."""
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r[0], []).append(r)
    assert set(pieces) == set(want)
    for key, found in pieces.items():
        ids, at = want[key], 0
        found.sort(key=lambda r: r[1])
        assert [r[1] for r in found] == list(range(len(found))) and len(found) == -(-len(ids) // capacity)
        for r in found:
            assert r[2] == at and r[4] == crc(ids[at : at + r[3]]) and (r[1] == 0 or r[3] == capacity)
            at += r[3]
        assert at == len(ids)
    held: dict = {}
    for r in rows:
        held.setdefault(r[5], []).append((r[6], r[3]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def one_by_one(lengths, capacity: int) -> int:
    """Sequences of best fit, longest first, one document at a time."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def test_op9_packs_whole_documents(spark, sf_dir, documents):
    rows = list(map(tuple, queries.op9_best_fit_packing(spark, sf_dir).collect()))
    want = {d["doc_id"]: [*ids_of("byte_bpe_50k.json", d["text"]), 2] for d in documents}
    n = check_packing(rows, want, 1024)
    assert n == one_by_one([r[3] for r in rows], 1024)


def placed_one_by_one(docs: list[int], gaps: list[int]) -> dict[int, int]:
    """Where each document goes if, longest first, it takes the least gap that holds it, and every gap only one; by place."""
    free, out = dict(enumerate(gaps)), {}
    for i in sorted(range(len(docs)), key=lambda i: -docs[i]):
        fit = min((g for g in free.values() if g >= docs[i]), default=None)
        if fit is not None:
            out[i] = next(j for j, g in free.items() if g == fit)
            del free[out[i]]
    return out


@given(st.lists(st.integers(1, 20), max_size=40), st.lists(st.integers(1, 20), max_size=40), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_sweeps_of_ranges_equal_one_sweep(docs, gaps, ranges):
    """What ranges match at once, and what is carried from one to the next, is what one document after the other takes."""
    rows = sorted([(-n, packing.DOC, k) for k, n in enumerate(docs)] + [(-g, packing.GAP, k) for k, g in enumerate(gaps)])
    cut = [rows[len(rows) * p // ranges : len(rows) * (p + 1) // ranges] for p in range(ranges)]
    swept = [packing.sweep((kind, -down, key) for down, kind, key in part) for part in cut]
    carry = packing.Carry.of([(p, len(d), len(g)) for p, (_, d, g) in enumerate(swept)])
    taken = sorted((n, g) for m, _, _ in swept for n, _, g, _ in m)
    of_docs, of_gaps = {}, {}
    for p, (_, left, open_) in enumerate(swept):
        of_docs |= {int(x): left[k][0] for k, x in enumerate(carry.number(packing.DOC, p, np.arange(len(left)))) if x >= 0}
        of_gaps |= {int(x): open_[k][0] for k, x in enumerate(carry.number(packing.GAP, p, np.arange(len(open_)))) if x >= 0}
    assert set(of_docs) == set(of_gaps) == set(range(carry.pairs))
    taken += [(of_docs[x], of_gaps[x]) for x in of_docs]
    assert sorted(taken) == sorted((docs[i], gaps[j]) for i, j in placed_one_by_one(docs, gaps).items())


@pytest.mark.parametrize("rows", [40, 1 << 17])
@pytest.mark.parametrize("high", [20, 60, 100])
def test_best_fit_packs_any_sizes(spark, monkeypatch, rows, high):
    """In many ranges and in one; small sizes crowd the gaps. Nearly as few sequences as one by one, never more than a hundredth."""
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    rng = np.random.default_rng(high)
    sizes = rng.integers(1, high + 1, 400).tolist()
    got = packing.best_fit(spark.createDataFrame(list(enumerate(sizes)), "key long, size int"), 100).collect()
    assert sorted(r.key for r in got) == list(range(400))
    held: dict = {}
    for r in got:
        held.setdefault(r.sequence, []).append((r.offset, sizes[r.key]))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 100
    assert len(held) <= one_by_one(sizes, 100) * 1.01 + 1
    assert packing.best_fit(spark.createDataFrame([], "key long, size int"), 100).collect() == []


def test_packing_of_odd_rows(spark, odd_documents, no_documents):
    keyed = odd_documents.selectExpr("monotonically_increasing_id() as row", "text", "id", "component as piece", "llr as length")
    rows = list(map(tuple, packing.pack(keyed, id_col="row", capacity=100).collect()))
    want = {r.row: [*ids_of("byte_bpe_50k.json", r.text), 2] for r in keyed.collect()}
    check_packing(rows, want, 100)
    assert sum(r.id is None for r in packing.pack(odd_documents).collect()) >= 4
    assert packing.pack(no_documents).collect() == []
