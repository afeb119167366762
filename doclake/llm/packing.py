"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Documents longer than half the capacity open a sequence each. In a round, the documents that are left and the gaps at the
ends of sequences are range-sorted together by falling size, gaps before documents of their size, and every range is swept
at once: a document takes the successor, the least gap that still holds it, and of two that want the same gap the longer
one, then the one that ranks first. What a range can't match goes on by rank to the gaps that larger ranges have left; only
how many each range has left reaches the driver. Then gaps are updated, those that hold nothing any more are closed, and the
next round begins. A round without a match opens as many sequences as the documents left need at least, with the longest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.bpe import TOGETHER, encoder
from doclake.llm.common import drop_stage, released, stage, text_slices

CAPACITY = 1024
#: Documents and gaps that one task sweeps, about.
RANGE_ROWS = 131_072
#: From so many documents a gap on, a gap may take several documents of neighbouring ranks in a round.
CROWD = 8

GAP, DOC, PLACED = 0, 1, 2
_STATE = "kind int, size int, key long, sequence long, offset int"
_SWEPT = "kind int, part int, rank long, size int, key long, gap int, sequence long"


def sweep(rows: Iterator[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """One range's sweep over (kind, size, key) by falling size, gaps before documents of their size.

    Gives (document size, key, gap size, gap key) of the matches, and (size, key) of the documents and of the gaps left, in
    order. The gaps still open are a stack: the one on top is the least, and holds every document that follows.
    """
    matched, docs, gaps = [], [], []
    for kind, size, key in rows:
        if kind == GAP:
            gaps.append((size, key))
        elif gaps:
            matched.append((size, key, *gaps.pop()))
        else:
            docs.append((size, key))
    return matched, docs, gaps


@dataclass
class Carry:
    """Numbers for pairs across ranges: documents [start, stop) of a range, by rank or bundle, and gaps likewise, from the top."""

    docs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    gaps: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    pairs: int = 0

    @classmethod
    def of(cls, left: list[tuple[int, int, int]]) -> Carry:
        """From (range, documents or bundles left, gaps left), ranges by falling size."""
        made, open_ = cls(), []
        for part, docs, gaps in left:
            at = 0
            while at < docs and open_:
                other, top = open_.pop()
                n = min(docs - at, top)
                made.docs.setdefault(part, []).append((at, at + n, made.pairs - at))
                made.gaps.setdefault(other, []).append((top - n, top, made.pairs + top - 1))
                made.pairs += n
                at += n
                if top > n:
                    open_.append((other, top - n))
            if gaps:
                open_.append((part, gaps))
        return made

    def number(self, kind: int, part: int, rank: np.ndarray) -> np.ndarray:
        """The pair that each document (by bundle) or gap belongs to, or -1."""
        out = np.full(len(rank), -1, np.int64)
        for start, stop, base in (self.docs if kind == DOC else self.gaps).get(part, ()):
            inside = (rank >= start) & (rank < stop)
            out[inside] = base + rank[inside] if kind == DOC else base - rank[inside]
        return out


def _swept(rows: DataFrame, ranges: int) -> DataFrame:
    """One sweep of every range, with what it matched and what it left, by rank."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        matched, docs, gaps = sweep(row for b in batches for row in zip(b.column(1).to_pylist(), (-b.column(0).to_numpy()).tolist(), b.column(2).to_pylist()))
        names = [x.split()[0] for x in _SWEPT.split(", ")]
        for kind, found in ((PLACED, matched), (DOC, docs), (GAP, gaps)):
            if found:
                n, columns = len(found), list(zip(*found))
                size, key = columns[:2]
                gap, sequence = columns[2:] if kind == PLACED else ([None] * n, [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(gap, pa.int32()), pa.array(sequence, pa.int64())], names)

    order = ["down", "kind", "key"]
    keyed = rows.select((-F.col("size")).alias("down"), "kind", "key")
    dealt = keyed.repartitionByRange(ranges, *order) if ranges > 1 else keyed.coalesce(1)  # one range needs no shuffle
    return dealt.sortWithinPartitions(*order).mapInArrow(work, _SWEPT)


def _settled(swept: DataFrame, carry: Carry, crowd: int, opened: dict[int, int], capacity: int) -> DataFrame:
    """The next state: placed documents, gaps and documents left."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, rank = (batch.column(k).to_numpy() for k in range(3))
            pair = np.full(len(rank), -1, np.int64)
            for p in np.unique(part):
                for k in (DOC, GAP):
                    at = np.nonzero((part == p) & (kind == k))[0]
                    pair[at] = carry.number(k, int(p), rank[at] // (crowd if k == DOC else 1))
            first = np.array([opened.get(int(p), 0) for p in part], np.int64)
            opens = (kind == DOC) & (rank < first)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(pair), pa.array(opens)], ["kind", "rank", "size", "key", "gap", "sequence", "pair", "opens"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, out = None, []
        for batch in batches:
            for kind, size, key in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4))):
                if kind == GAP:
                    if gap:
                        out.append((GAP, gap[0], gap[1], None, None))
                    gap = [size, key]
                elif gap[0] >= size:
                    out.append((PLACED, size, key, gap[1], capacity - gap[0]))
                    gap[0] -= size
                else:
                    out.append((DOC, size, key, None, None))
            if len(out) >= 65_536:
                yield _state(out)
                out = []
        if gap:
            out.append((GAP, gap[0], gap[1], None, None))
        if out:
            yield _state(out)

    rows = swept.mapInArrow(number, "kind int, rank long, size int, key long, gap int, sequence long, pair long, opens boolean")
    row = lambda kind, size, key, sequence, offset: F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), key.alias("key"), sequence.cast("long").alias("sequence"), offset.cast("int").alias("offset"))
    c, none = F.col, F.lit(None)
    found = F.array(row(PLACED, c("size"), c("key"), c("sequence"), F.lit(capacity) - c("gap")), row(GAP, c("gap") - c("size"), c("sequence"), none, none))
    fresh = F.array(row(PLACED, c("size"), c("key"), c("key"), F.lit(0)), row(GAP, F.lit(capacity) - c("size"), c("key"), none, none))
    left = F.array(F.struct("kind", "size", "key", none.cast("long").alias("sequence"), none.cast("int").alias("offset")))
    alone = rows.where("pair < 0").select(F.explode(F.when(c("kind") == PLACED, found).when(c("opens"), fresh).otherwise(left)).alias("r")).select("r.*")
    if carry.pairs:
        tasks = -(-carry.pairs * (crowd + 1) // RANGE_ROWS)
        met = rows.where("pair >= 0").select("pair", "kind", "rank", "size", "key")
        dealt = met.repartition(tasks, "pair") if tasks > 1 else met.coalesce(1)
        alone = alone.unionByName(dealt.sortWithinPartitions("pair", "kind", "rank").mapInArrow(settle, _STATE))
    return alone.where(f"kind <> {GAP} or size > 0")


def _state(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _STATE.split(", ")])


def best_fit(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, sequence, offset) of every row of (key, size); keys are unique and stay the same when read again.

    Sizes lie from 1 to ``capacity``. A sequence has the key of the document that opened it. The driver sees sums per range
    and round. Rounds are about as many as the documents of the fullest sequence, fewer where gaps are crowded.
    """
    size, key, half = F.col("size").cast("int"), F.col("key"), capacity // 2
    row = lambda kind, size, key, sequence, offset: F.struct(F.lit(kind).alias("kind"), size.alias("size"), key.alias("key"), sequence.cast("long").alias("sequence"), offset.cast("int").alias("offset"))
    none = F.lit(None)
    opening = F.array(row(PLACED, size, key, key, F.lit(0)), row(GAP, F.lit(capacity) - size, key, none, none))
    state = sizes.select(F.explode(F.when(size > half, opening).otherwise(F.array(row(DOC, size, key, none, none)))).alias("r")).select("r.*")
    placed = [state.where(f"kind = {PLACED}")]
    least = 1
    while True:
        open_ = state.where(f"kind = {DOC} or kind = {GAP} and size >= {least}")
        docs, gaps = open_.agg(F.count_if(F.col("kind") == DOC), F.count_if(F.col("kind") == GAP)).first()
        if not docs:
            break
        crowd = min(capacity, max(1, docs // (4 * gaps))) if gaps and docs > CROWD * gaps else 1
        swept = stage(_swept(open_, -(-(docs + gaps) // RANGE_ROWS)), "swept")
        sums = swept.groupBy("part", "kind").agg(F.count("*"), F.sum("size"), F.min("size")).collect()
        n = {(r[0], r[1]): r[2] for r in sums}
        parts = sorted({r[0] for r in sums})
        carry = Carry.of([(p, -(-n.get((p, DOC), 0) // crowd), n.get((p, GAP), 0)) for p in parts])
        opened: dict[int, int] = {}
        if not carry.pairs and not any(r[1] == PLACED for r in sums):
            fresh = -(-sum(r[3] for r in sums if r[1] == DOC) // capacity)
            for p in parts:
                opened[p] = min(fresh, n.get((p, DOC), 0))
                fresh -= opened[p]
        least = min((r[4] for r in sums if r[1] == DOC), default=capacity)
        state = stage(_settled(swept, carry, crowd, opened, capacity), "packed")
        drop_stage(swept)
        placed.append(state.where(f"kind = {PLACED}"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("key", "sequence", F.col("offset").cast("long").alias("offset"))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """One row per piece of every document: id, piece, start, length and ids_crc32.

    A document is its whole text's ids and ``end_id``; a null text has only the latter. Longer ones are cut so that only
    the first piece may be shorter than ``capacity``.
    """
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))])
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released(encoder(tokenizer, spaced)) as enc:
            for batch in batches:
                for part in text_slices(batch, 1, TOGETHER):
                    rows: list[tuple[int, int, int, int, int]] = []
                    ids, counts = enc.encode(part.column(1))
                    data, stops = memoryview(ids.tobytes()), 4 * np.cumsum(counts)
                    for k, (a, b) in enumerate(zip((stops - 4 * counts).tolist(), stops.tolist())):
                        own = bytes(data[a:b]) + end
                        n = len(own) // 4
                        first = n % capacity or capacity
                        for piece, stop in enumerate(range(first, n + 1, capacity)):
                            start = max(0, stop - capacity) if piece else 0
                            rows.append((k, piece, start, stop - start, zlib.crc32(own[4 * start : 4 * stop])))
                    k, piece, start, length, crc = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, out)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; sequences have no gaps before their end.

    Null texts count as empty, repeated rows are documents of their own, null ids are kept, an empty table gives no rows.
    Pieces get their keys as they are written out. Those that fill a sequence stay out of all rounds and joins.
    """
    cut = stage(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, spaced).withColumn("key", F.monotonically_increasing_id()), "pieces")
    whole, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    names = ["id", "piece", "start", "length", "ids_crc32"]
    found = rest.join(best_fit(rest.select("key", F.col("length").alias("size")), capacity), "key")
    alone = whole.select(*names, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return found.select(*names, F.col("sequence").alias("sequence_id"), "offset").unionByName(alone)
