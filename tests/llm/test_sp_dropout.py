from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from doclake.llm import sp_dropout
from doclake.llm.queries import op3_sentencepiece_dropout

MODEL = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
PLAIN = sp_dropout.Dropout(MODEL, 0.0)
DROPPED = sp_dropout.Dropout(MODEL, 0.3, 11)
texts = st.text(alphabet=st.sampled_from("abcdeThe isng 1,.\n\t  你é́😀"), max_size=60)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_without_dropout_it_is_the_models_own(text):
    assert PLAIN.encode(text) == LIBRARY.encode(text)
    assert PLAIN.decode(PLAIN.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


@given(texts, st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_with_dropout_nothing_is_lost(text, variant):
    ids = DROPPED.encode(text, variant)
    assert ids == DROPPED.encode(text, variant)
    assert LIBRARY.decode(ids) == LIBRARY.decode(LIBRARY.encode(text)) == DROPPED.decode(ids)


def test_variants_and_seeds_differ():
    text = "The quick brown foxes are jumping over some remarkably lazy documents about tokenization"
    found = {tuple(DROPPED.encode(text, v)) for v in range(4)}
    found |= {tuple(sp_dropout.Dropout(MODEL, 0.3, seed).encode(text)) for seed in (1, 2)}
    assert len(found) == 6 and all(len(f) >= len(LIBRARY.encode(text)) for f in found)
    none = sp_dropout.Dropout(MODEL, 1.0).encode("jumping")
    assert none == [LIBRARY.piece_to_id(c) for c in "▁jumping"]


def literal(text: str, variant: int, rate: float, seed: int) -> list[int]:
    """The model's best merges one by one, each skipped for good by its own draw; written anew, with plain numbers and strings."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    ids = []
    normal = LIBRARY.normalize(text)
    for place, part in enumerate(re.findall("▁+[^▁\n]*|\n|[^▁\n]+", normal)):
        base = mix(((mix(seed ^ 0x9E3779B97F4A7C15) ^ variant) + (place + 1) * 0x9E3779B97F4A7C15) & mask)
        symbols, skipped, turn = [(c, k) for k, c in enumerate(part)], set(), 0
        while True:
            open_ = []
            for k, ((a, i), (b, j)) in enumerate(zip(symbols, symbols[1:])):
                piece = LIBRARY.piece_to_id(a + b)
                if piece != LIBRARY.unk_id() and LIBRARY.id_to_piece(piece) == a + b and not LIBRARY.is_byte(piece) and (a, b, i) not in skipped:
                    open_.append((-LIBRARY.get_score(piece), i, k, a, b))
            if not open_:
                break
            _, i, k, a, b = min(open_)
            draw = mix((base + (turn // 2 + 1) * 0xD1B54A32D192ED03) & mask) >> (32 * (turn % 2)) & 0xFFFFFFFF
            turn += 1
            if draw < int(rate * 2**32):
                skipped.add((a, b, i))
            else:
                symbols[k : k + 2] = [(a + b, i)]
        for s, _ in symbols:
            piece = LIBRARY.piece_to_id(s)
            known = piece != LIBRARY.unk_id() and not LIBRARY.is_byte(piece)
            ids += [piece] if known else [LIBRARY.piece_to_id(f"<0x{x:02X}>") for x in s.encode()]
    return ids


@given(texts, st.integers(0, (1 << 63) - 1), st.sampled_from([1, 9]))
@settings(max_examples=150, deadline=None)
def test_it_is_the_literal_dropout(text, variant, seed):
    for rate in (0.1, 0.6):
        assert tool(rate, seed).encode(text, variant) == literal(text, variant, rate, seed)


@functools.cache
def tool(rate, seed):
    return sp_dropout.Dropout(MODEL, rate, seed)


def test_whole_texts_are_the_literal_dropout(documents):
    some = sorted((d["text"] for d in documents if d["text"] and len(d["text"]) < 3000), key=len)[-12:]
    normal = DROPPED.normalise(some)
    ids, counts = DROPPED.encode_normal(normal, list(range(12)))
    stops = np.cumsum(counts)
    for k, text in enumerate(some):
        assert ids[stops[k] - counts[k] : stops[k]].tolist() == literal(text, k, 0.3, 11)


def test_every_occurrence_is_cut_on_its_own():
    """One word, many times in one text and at one place in many documents, takes many more than four forms."""
    word, n = "▁remarkably", 400
    inside = [tuple(DROPPED.merge(word, DROPPED.base(5, k))[0]) for k in range(n)]
    ids, _ = DROPPED.encode_normal([word * n], [5])
    assert ids.tolist() == [i for found in inside for i in found]
    across = {tuple(DROPPED.encode_normal([word], [DROPPED.variant(i)])[0].tolist()) for i in range(n)}
    assert len(set(inside)) > 8 and len(across) > 8


def test_draws_are_the_same_in_bulk_and_alone():
    places = np.arange(3, 20_003)
    bases = DROPPED.base(np.full(20_000, 77), places)
    assert bases[:50].tolist() == [DROPPED.base(77, int(k)) for k in places[:50]]
    for turn in (0, 1, 5, 40):
        drawn = DROPPED.skipped(bases, turn)
        assert drawn[:50].tolist() == [DROPPED.skipped(int(x), turn) for x in bases[:50]] and abs(drawn.mean() - 0.3) < 0.015


def test_long_parts_are_cut_alike(monkeypatch):
    """By a heap of their own, as by the agenda of all together."""
    long = "▁" + "internationalé😀" * 20
    own = {tuple(DROPPED.encode_normal([long], [v])[0].tolist()) for v in range(20)}
    monkeypatch.setattr(sp_dropout, "WIDE", 1000)
    assert len(own) == 20 and own == {tuple(DROPPED.encode_normal([long], [v])[0].tolist()) for v in range(20)}


def test_op3_is_lossless(spark, sf_dir, documents):
    got = {r.doc_id: r for r in op3_sentencepiece_dropout(spark, sf_dir).collect()}
    tool = sp_dropout.Dropout(MODEL, 0.1, 7)
    assert len(got) == len(documents) and all(r.lossless for r in got.values())
    for d in documents:
        ids = tool.encode(d["text"], tool.variant(d["doc_id"]))
        assert (got[d["doc_id"]].n_tokens, got[d["doc_id"]].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_odd_rows(spark, odd_documents, no_documents):
    encoded = sp_dropout.encode_documents(odd_documents)
    rows = encoded.collect()
    assert len(rows) == odd_documents.count() and all(r.lossless for r in rows)
    assert sum(r.n_tokens == 0 for r in rows) >= 4
    decoded = sorted((r.text for r in sp_dropout.decode_documents(encoded).collect()))
    assert decoded == sorted(LIBRARY.decode(LIBRARY.encode(r.text or "")) for r in odd_documents.collect())
    assert sp_dropout.encode_documents(no_documents).collect() == []
    nothing = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert sp_dropout.decode_documents(nothing).first().text is None
