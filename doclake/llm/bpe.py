"""Exact byte-pair token ids and counts at the speed of a dictionary.

A tokenizer treats the text between two white-space characters on its own, so ids are made once for each distinct run of a
batch: a text whose runs are parted by single blanks or line feeds is looked up run by run, and any other text, or one that
may hold a special string, goes to the library whole. Both ways give the library's own ids. The counter's memos are bounded,
see ``Memo``.
"""

from __future__ import annotations

import heapq
import json
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from doclake.llm.common import Memo, plain_words, tokenizer, tokenizer_path


_SIGNS = string.punctuation
#: What a vocabulary with word ends takes apart inside a lower-cased run; each part ends with one word end.
_WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def marked(text: str, words: list[str]) -> list[str]:
    """A plain text's words with what stands before them: nothing for a blank, a line feed, or a return at the very start."""
    runs = text.replace("\n", " \n").split(" ") if "\n" in text else words
    runs[0] = "\r" + runs[0]
    return runs


def spelt(run: str) -> str:
    """The text that a marked run stands for."""
    return run if run[0] == "\n" else run[1:] if run[0] == "\r" else " " + run


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_CHARS = _byte_chars()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class _Tails(dict):
    """Ids of signs that end a word; there are few, and they are only remembered while they are short."""

    def __init__(self, lib):
        super().__init__()
        self.lib = lib

    def __missing__(self, signs: str) -> bytes:
        ids = np.array(self.lib.encode(signs, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < 65_536 and len(signs) < 32:
            self[signs] = ids
        return ids


#: White space other than single blanks and line feeds inside a text, and signs of a special string.
_ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|<\||[\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def runs_of(texts: pa.Array, spaced: bool) -> pa.ListArray:
    """The runs of plain, non-empty texts; with ``spaced``, marked with what stands before them."""
    if not spaced:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    return pc.split_pattern(pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), ""), " ")


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every place in the spans that begin at ``starts``, one span after the other."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)


#: Bytes of text, about, whose runs are made distinct together.
TOGETHER = 8 << 20


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, as ``tokenizers`` gives them without special tokens.

    ``spaced``: whether the vocabulary keeps white space (byte-level) or drops it between words.
    """

    def __init__(self, name: str, spaced: bool):
        self.lib = tokenizer(name)
        self.model = self.lib.model.tokenize
        self.tails = _Tails(self.lib)
        self.spaced = spaced
        self.bytes = {c: "".join(_BYTE_CHARS[b] for b in chr(c).encode()) for c in range(256)}
        self.blank = np.zeros(self.lib.get_vocab_size(), bool)
        self.blank[[i for piece, i in self.lib.get_vocab().items() if piece.startswith("Ġ")]] = True
        self.ending = np.zeros_like(self.blank)
        self.ending[[i for piece, i in self.lib.get_vocab().items() if piece.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has; null and empty texts have none.

        Runs are made distinct first, and nothing but ids of short signs is remembered from one call to the next: in large
        corpora most words are rare, and a memo costs more than it saves.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        runs = runs_of(texts.filter(pa.array(plain)), self.spaced)
        ids, per_run = self.known(runs.flatten())
        counts = np.zeros(len(texts), np.int64)
        if plain.any():
            counts[plain] = np.add.reduceat(per_run, runs.offsets.to_numpy()[:-1] - runs.offsets[0].as_py())
        if not odd.any():
            return ids, counts
        places = np.nonzero(odd)[0]
        others = [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(texts.take(pa.array(places)).to_pylist(), add_special_tokens=False)]
        before = np.cumsum(counts)[places]
        counts[places] = [len(x) for x in others]
        parts = np.split(ids, before)
        return np.concatenate([x for pair in zip(parts, [*others, ids[:0]]) for x in pair]), counts

    def known(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, and how many each has."""
        if not len(runs):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        coded = runs.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = self.learn(words)
        ids = list(map(found.__getitem__, words))
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        per_run = lengths[codes]
        return flat[spans((np.cumsum(lengths) - lengths)[codes], per_run)], per_run

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct runs.

        A word of plain letters, with or without signs behind it, goes to the model itself, as its normal form is known.
        Of the others, many are encoded as one text and cut apart again where the next one starts.
        """
        found: dict[str, bytes] = {}
        tails, model, rest = self.tails, self.model, []
        for run in new:
            body = run.rstrip(_SIGNS)
            if not body.isalpha() or not (body.isascii() or max(body) <= "ÿ"):
                rest.append(run)
                continue
            ids = found.get(body)
            if ids is None:
                got = [t.id for t in model((" " + body if self.spaced else body.lower()).translate(self.bytes))]
                ids = _PACK[len(got)](*got) if len(got) < len(_PACK) else np.array(got, "<u4").tobytes()
            if len(body) < len(run):
                ids += tails[run[len(body) :]]
            found[run] = ids
        if self.spaced:
            joined = [run for run in rest if run[0] not in "\n\r"]
        else:
            joined = [run for run in rest if (run.isascii() or run.strip(_SIGNS).isalpha()) and len(run.lower()) == len(run)]
        for at in range(0, len(joined), 1024):
            part = joined[at : at + 1024]
            found.update(zip(part, self.apart(part)))
        alone = [run for run in rest if run not in found]
        found.update(zip(alone, self.each(alone)))
        return found

    def forget(self) -> None:
        self.tails.clear()

    def apart(self, runs: list[str]) -> list[bytes]:
        ids = self.ids(" " * self.spaced + " ".join(runs))
        if self.spaced:
            starts = np.nonzero(self.blank[ids])[0]
            stops = np.append(starts[1:], len(ids))
        else:
            ends = np.nonzero(self.ending[ids])[0] + 1
            last = np.cumsum([1 if run.isalpha() else len(_WORD_PARTS.findall(run.lower())) for run in runs]) - 1
            if last[-1] + 1 != len(ends):
                return self.each(runs)
            stops = ends[last]
            starts = np.append(0, stops[:-1])
        if len(starts) != len(runs):
            return self.each(runs)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist())]

    def each(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, each encoded on its own."""
        asked = list(map(spelt, runs)) if self.spaced else runs
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(asked, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


class MergeCounter(Memo):
    """How many tokens a byte-level BPE vocabulary gives a text, by heap and linked list; no ids are made.

    Symbols start as bytes. A heap holds the adjacent pairs that can merge as (rank, place); the lowest rank, and of those
    the leftmost, is popped, and merged unless one of its halves has changed since. The count is symbols minus merges.
    """

    def __init__(self, name: str):
        super().__init__()
        spec = json.load(open(name if "/" in name else tokenizer_path(name), encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.first = [vocab[c] for c in _BYTE_CHARS]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.words = Memo()

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        symbols: list[int] = [self.first[b] for b in data]
        n = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] << 20 | symbols[i + 1])
            if found is not None:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, a, b, joined = pop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = joined, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(joined << 20 | symbols[k])
                if found is not None:
                    push(heap, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbols[h] << 20 | joined)
                if found is not None:
                    push(heap, (found[0], h, symbols[h], joined, found[1]))
        return left

    def pieces(self, run: str) -> int:
        total, words = 0, self.words
        for piece in self.pattern.findall(run):
            n = words.get(piece)
            if n is None:
                n = words.old.get(piece)
                if n is None:
                    n = self.merged(piece.encode("utf-8", "surrogatepass"))
                words.keep(piece, n)
            total += n
        return total

    def __missing__(self, run: str) -> int:
        n = self.old.get(run)
        if n is None:
            n = self.pieces(spelt(run))
        self.keep(run, n)
        return n

    def forget(self) -> None:
        super().forget()
        self.words.forget()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has; null and empty texts have none. Runs of plain texts are made distinct first."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        out = np.zeros(len(texts), np.int64)
        out[odd] = [self.count(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        if plain.any():
            runs = runs_of(texts.filter(pa.array(plain)), True)
            coded = runs.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            per_run = np.fromiter((self.pieces(spelt(run)) for run in known), np.int64, len(known))
            out[plain] = np.add.reduceat(per_run[coded.indices.to_numpy()], runs.offsets.to_numpy()[:-1] - runs.offsets[0].as_py())
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = plain_words(text)
        if words:
            return sum(map(self.__getitem__, marked(text, words)))
        return sum(self.pieces(part) for part in self.special.split(text)) + len(self.special.findall(text))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
_COUNTERS: dict[str, MergeCounter] = {}


def encoder(name: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary, with its memo."""
    if (name, spaced) not in _ENCODERS:
        _ENCODERS[name, spaced] = Encoder(name, spaced)
    return _ENCODERS[name, spaced]


def counter(name: str) -> MergeCounter:
    if name not in _COUNTERS:
        _COUNTERS[name] = MergeCounter(name)
    return _COUNTERS[name]
