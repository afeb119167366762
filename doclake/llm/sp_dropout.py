"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is normalised by the model and cut where no piece can cross. Each cut part is merged by an agenda: candidate pairs
by falling score, leftmost first. A candidate that comes up is skipped for good when a keyed hash of the document's id, the
part's place in the text and the candidate's turn in the agenda falls below the dropout rate. So every occurrence of a word
is cut on its own, and always the same way for the same key, id and text. Many parts are merged at once: numpy keeps an
agenda for each of them and takes every part's next turn together. Only the merging of parts that no turn is skipped of is
shared by equal parts of a batch. Long parts have a heap of their own. Decoding joins pieces again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from doclake.llm.bpe import spans
from doclake.llm.common import released, text_slices, tokenizer_path

RATE = 0.1
#: Parts with more characters than this have a heap of their own, as the agenda of all of them at once is searched each turn.
WIDE = 48
#: Bytes of text, about, whose parts are merged together; a longer text is on its own.
SLICE = 1 << 20
#: Parts that are merged at once.
TOGETHER = 16_384
_FIRST, _NEXT = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_SPACE = "▁"
_MASK = (1 << 64) - 1
#: Symbols that are no piece are numbered by their code point from here on.
_OTHER = 1 << 21
_NEVER = np.int32(2**31 - 1)


def _mix(x):
    """The finaliser of splitmix64, of one number or an array of them."""
    if isinstance(x, int):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Pairs:
    """What two neighbouring symbols make, and how early: an open table of hashed pairs."""

    def __init__(self, found: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(8, (8 * len(found)).bit_length())
        n = 1 << self.bits
        self.keys, self.rank, self.piece = np.full(n, -1, np.int64), np.full(n, _NEVER, np.int32), np.zeros(n, np.int32)
        keys = np.array([a << 22 | b for a, b in found], np.int64)
        values = np.array(list(found.values()), np.int32).reshape(-1, 2)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.rank[at[mine]], self.piece[at[mine]] = values[left[mine], 0], values[left[mine], 1]
            left, at = left[~mine], at[~mine] + 1 & n - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_FIRST) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of every pair; one without a rank where they make nothing."""
        keys = a.astype(np.int64) << 22 | b
        at = self._slot(keys)
        held = self.keys[at]
        left = np.nonzero((held != keys) & (held >= 0))[0]
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return at


class Dropout:
    """Encoder and decoder for one model and key; ``rate`` 0 gives the model's own segmentation."""

    def __init__(self, model: str, rate: float = RATE, seed: int = 0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else tokenizer_path(model))
        sp, n = self.sp, self.sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: -sp.get_score(i) for i in plain}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.unknown = sp.unk_id()
        self.fallback = sp.is_byte(int(self.bytes[0]))
        surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.fromiter(map(len, surface), np.int64, n)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        if any(re.search(f"[^{_SPACE}]{_SPACE}", pieces[i]) for i in plain):
            raise ValueError("pieces that go on after a word's start aren't supported")
        joined = "".join(p for p in (pieces[i] for i in plain) if len(p) > 1)
        self.parts = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n|[^{_SPACE}\n]+" if "\n" not in joined else f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
        self.limit, self.seed = int(rate * (1 << 32)), seed
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        pairs = {}
        for i in plain:
            for k in range(1, len(pieces[i])):
                a, b = self.symbol(pieces[i][:k]), self.symbol(pieces[i][k:])
                if a is not None and b is not None:
                    pairs[a, b] = ranks[self.score[pieces[i]]], i
        self.pairs = _Pairs(pairs)
        self.single = np.arange(0x10000, dtype=np.int32) + _OTHER
        for piece, i in self.ids.items():
            if len(piece) == 1 and ord(piece) < 0x10000:
                self.single[ord(piece)] = i
        self.high = {ord(p): i for p, i in self.ids.items() if len(p) == 1 and ord(p) >= 0x10000}

    def forget(self) -> None:
        """Nothing is remembered between batches."""

    def symbol(self, text: str) -> int | None:
        """The number of a symbol: its piece, or its code point if it is one character that is no piece."""
        got = self.ids.get(text)
        return got if got is not None or len(text) > 1 else _OTHER + ord(text)

    def variant(self, doc_id: int | None) -> int:
        """The document's own key, of 63 bits."""
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{doc_id}".encode(), digest_size=8).digest(), "big") >> 1

    def base(self, variant, place):
        """What the draws of the part at one place of a text start from; of numbers or arrays of them."""
        own = _mix((self.seed & _MASK) ^ _FIRST)
        if isinstance(place, int):
            return _mix((own ^ variant & _MASK) + (place + 1) * _FIRST & _MASK)
        return _mix((np.uint64(own) ^ variant.astype(np.uint64)) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_FIRST))

    def skipped(self, base, turn: int):
        """Whether a turn, counted from 0, is skipped; of one base or an array of them."""
        step, shift = (turn // 2 + 1) * _NEXT & _MASK, 32 * (turn % 2)
        if isinstance(base, int):
            return _mix(base + step & _MASK) >> shift & 0xFFFFFFFF < self.limit
        return (_mix(base + np.uint64(step)) >> np.uint64(shift) & np.uint64(0xFFFFFFFF)) < np.uint64(self.limit)

    def merge(self, part: str, base: int | None = None) -> tuple[list[int], int]:
        """One part's symbols and how many turns its agenda took, by a heap; without ``base`` no turn is skipped."""
        symbols: list[int] = list(map(self.symbol, part))  # type: ignore[arg-type]
        n, turn = len(symbols), 0
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            at = int(self.pairs.find(np.array([symbols[i]]), np.array([symbols[j]]))[0])
            if self.pairs.rank[at] != _NEVER:
                heapq.heappush(agenda, (int(self.pairs.rank[at]), i, symbols[i], symbols[j], int(self.pairs.piece[at])))

        if n > 1:
            slots = self.pairs.find(np.array(symbols[:-1]), np.array(symbols[1:]))
            rank, piece = self.pairs.rank[slots], self.pairs.piece[slots]
            agenda = [(int(rank[i]), i, symbols[i], symbols[i + 1], int(piece[i])) for i in np.nonzero(rank != _NEVER)[0].tolist()]
            heapq.heapify(agenda)
        while agenda:
            _, i, a, b, both = heapq.heappop(agenda)
            j = after[i]
            if not live[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            turn += 1
            if base is not None and self.skipped(base, turn - 1):
                continue
            symbols[i], live[j] = both, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s, here in zip(symbols, live) if here], turn

    def merge_all(self, chars: np.ndarray, lengths: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All parts' symbols, one after the other, with how many each part has and how many turns it took.

        ``chars`` holds the parts' code points, one part after the other.
        """
        n = len(lengths)
        symbols, counts, turns = np.empty(len(chars), np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        narrow = order[: np.searchsorted(lengths[order], WIDE, side="right")]
        for at in range(0, len(narrow), TOGETHER):
            some = narrow[at : at + TOGETHER]
            width = int(lengths[some[-1]])
            if not width:
                continue
            inside = np.arange(width) < lengths[some][:, None]
            grid = np.zeros((len(some), width), np.int32)
            grid[inside] = self.numbers(chars[spans(starts[some], lengths[some])])
            done, live, turns[some] = self._agenda(grid, inside, None if base is None else base[some])
            counts[some] = live.sum(axis=1)
            symbols[spans(starts[some], counts[some])] = done[live]
        for k in order[len(narrow) :].tolist():
            part = "".join(map(chr, chars[starts[k] : starts[k] + lengths[k]].tolist()))
            got, turns[k] = self.merge(part, None if base is None else int(base[k]))
            counts[k] = len(got)
            symbols[starts[k] : starts[k] + len(got)] = got
        return symbols[spans(starts, counts)], counts, turns

    def numbers(self, chars: np.ndarray) -> np.ndarray:
        high = chars >= 0x10000
        out = self.single[np.where(high, 0, chars)]
        if high.any():
            out[high] = [self.high.get(c, _OTHER + c) for c in chars[high].tolist()]
        return out

    def _agenda(self, grid: np.ndarray, inside: np.ndarray, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every row's agenda, all turn by turn: symbols, which places still hold one, and turns taken."""
        rows, width = grid.shape
        live, turns = inside.copy(), np.zeros(rows, np.int32)
        if width < 2:
            return grid, live, turns
        rank, piece = np.full((rows, width), _NEVER, np.int32), np.zeros((rows, width), np.int32)
        both = inside[:, 1:]
        slots = self.pairs.find(grid[:, :-1][both], grid[:, 1:][both])
        rank[:, :-1][both], piece[:, :-1][both] = self.pairs.rank[slots], self.pairs.piece[slots]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (rows, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (rows, width)).copy()
        ends = inside.sum(axis=1)
        row, turn = np.arange(rows), 0
        while len(row):
            agenda = rank if len(row) == rows else rank[row]
            i = agenda.argmin(axis=1)
            some = agenda[np.arange(len(row)), i] != _NEVER
            row, i = row[some], i[some]
            turns[row] += 1
            at, k = row, i
            if base is not None:
                skip = self.skipped(base[row], turn)
                rank[row[skip], i[skip]] = _NEVER
                at, k = row[~skip], i[~skip]
            turn += 1
            j = after[at, k]
            grid[at, k] = piece[at, k]
            live[at, j] = False
            rank[at, j] = _NEVER
            next_, ahead = after[at, j], before[at, k]
            after[at, k] = next_
            rank[at, k] = _NEVER
            some = next_ < ends[at]
            a, b, c = at[some], k[some], next_[some]
            before[a, c] = b
            slots = self.pairs.find(grid[a, b], grid[a, c])
            rank[a, b], piece[a, b] = self.pairs.rank[slots], self.pairs.piece[slots]
            some = ahead >= 0
            a, b, c = at[some], ahead[some], k[some]
            slots = self.pairs.find(grid[a, b], grid[a, c])
            rank[a, b], piece[a, b] = self.pairs.rank[slots], self.pairs.piece[slots]
        return grid, live, turns

    def to_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: characters that are no piece become their bytes' ids, or the unknown id."""
        other = np.nonzero(symbols >= _OTHER)[0]
        if not len(other):
            return symbols.astype("<u4"), counts
        sizes = np.ones(len(symbols), np.int64)
        if self.fallback:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[other] - _OTHER).tolist()]
            sizes[other] = list(map(len, raw))
            places = spans((np.cumsum(sizes) - sizes)[other], sizes[other])
            ids = np.repeat(symbols, sizes).astype("<u4")
            ids[places] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = symbols.astype("<u4")
            ids[other] = self.unknown
        ends = np.cumsum(counts)
        total = np.append(0, np.cumsum(sizes))
        return ids, total[ends] - total[ends - counts]

    def normalise(self, texts: list[str]) -> list[str]:
        return self.sp.normalize(texts)

    def encode_normal(self, texts: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of normalised texts, one after the other, and how many each text has."""
        found = [self.parts.findall(t) for t in texts]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        parts = pa.array([p for f in found for p in f], pa.string()).dictionary_encode()
        codes = parts.indices.to_numpy()
        words = parts.dictionary.to_pylist()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbols, counts, turns = self.merge_all(chars, lengths)
        ids, counts = self.to_ids(symbols, counts)
        starts = np.cumsum(counts) - counts
        sizes, begins = counts[codes], starts[codes]
        if self.limit:
            place = np.arange(len(codes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            base = self.base(np.repeat(np.array(variants, np.int64), per_text), place)
            hit, takes = np.zeros(len(codes), bool), turns[codes]
            left, turn = np.nonzero(takes > 0)[0], 0
            while len(left):
                hit[left[self.skipped(base[left], turn)]] = True
                turn += 1
                left = left[(takes[left] > turn) & ~hit[left]]
            at = np.nonzero(hit)[0]
            own = lengths[codes[at]]
            more, more_counts, _ = self.merge_all(chars[spans((np.cumsum(lengths) - lengths)[codes[at]], own)], own, base[at])
            more, more_counts = self.to_ids(more, more_counts)
            sizes[at], begins[at] = more_counts, len(ids) + np.cumsum(more_counts) - more_counts
            ids = np.concatenate([ids, more])
        ends = np.append(0, np.cumsum(sizes))
        stops = np.cumsum(per_text)
        return ids[spans(begins, sizes)], ends[stops] - ends[stops - per_text]

    def encode(self, text: str | None, variant: int = 0) -> list[int]:
        if not text:
            return []
        return self.encode_normal(self.normalise([text]), [variant])[0].tolist()

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the normalised text that ids stand for."""
        return self.surface[spans(self.surface_start[ids], self.surface_size[ids])]

    def decode_normal(self, ids: bytes) -> str:
        """The normalised text that ids stand for."""
        return self.spelt(np.frombuffer(ids, "<u4")).tobytes().decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_normal(np.array(ids, "<u4").tobytes()).replace(_SPACE, " ").removeprefix(" ")


_DROPOUTS: dict[tuple, Dropout] = {}


def dropout(*args) -> Dropout:
    if args not in _DROPOUTS:
        _DROPOUTS[args] = Dropout(*args)
    return _DROPOUTS[args]


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", rate: float = RATE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, variant, n_tokens, ids_crc32, lossless) of every row, and the ids as u32 bytes if asked for.

    lossless tells whether the ids decode to the whole normalised text again; it can only be false for a model that lacks
    bytes as pieces. variant is the key that the document's id gives its draws. Null and empty texts have no ids and are
    lossless; a null id has a variant of its own. No shuffle.
    """
    from pyspark.sql.types import BinaryType

    fields = [StructField("id", docs.schema[id_col].dataType), StructField("variant", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("lossless", BooleanType())]
    out = StructType(fields + [StructField("ids", BinaryType())] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released(dropout(model, rate, seed)) as tool:
            for batch in batches:
                for part in text_slices(batch, 1, SLICE):
                    which = [tool.variant(i) for i in part.column(0).to_pylist()]
                    normal = tool.normalise([t or "" for t in part.column(1).to_pylist()])
                    ids, counts = tool.encode_normal(normal, which)
                    stops = np.cumsum(counts).tolist()
                    own = [ids[b - n : b] for b, n in zip(stops, counts.tolist())]
                    whole = [tool.spelt(i).tobytes() == t.encode("utf-8", "surrogatepass") for i, t in zip(own, normal)]
                    columns = [part.column(0), pa.array(which, pa.int64()), pa.array(counts), pa.array([zlib.crc32(i) for i in own], pa.int64()), pa.array(whole)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([i.tobytes() for i in own], pa.binary())] * with_ids, out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, out)


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, text) of rows with ids as u32 bytes; null ids give a null text."""
    out = StructType([encoded.schema["id"], StructField("text", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = dropout(model, 0.0, 0)
        for batch in batches:
            texts = [None if b is None else tool.decode_normal(b).replace(_SPACE, " ").removeprefix(" ") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(work, out)
