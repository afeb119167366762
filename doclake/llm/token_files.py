"""Token ids in binary files: blocks turned into bit or byte planes, each plane compressed, with a chunk index.

A file holds chunks and a footer. A chunk holds whole documents: their ids and lengths, then blocks of ``block`` token ids.
The ids of a block are unsigned 32-bit numbers, transposed so that the first plane has every lowest byte (or bit), the next
plane the next ones; each plane is compressed with zstandard on its own, and empty planes take no room. All integers are
little-endian.

    file    chunks, footer, u64 length of the footer, magic
    chunk   u32 length of the head, head, planes of the blocks one after the other
    head    zstandard of: u64 documents, u64 blocks, u8 planes, i64 id per document, u8 null per document,
            u64 tokens per document, then per block u32 tokens and per plane u32 bytes
    footer  u64 chunks, then per chunk u64 offset, length, documents, tokens

The index of all files is a Parquet table, written by Spark. It names only files of tasks that succeeded; a task that is
run again writes a file of its own, and nothing refers to the lost one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.bpe import TOGETHER, encoder
from doclake.llm.common import partitions, released, scratch, stage, text_slices

MAGIC = b"DLTOK001"
BLOCK = 65_536
CHUNK_TOKENS = 1 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of u32 ids, lowest first; trailing planes that are all zero are left out."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        return [np.packbits((ids >> k & 1).astype(np.uint8)).tobytes() for k in range(width)]
    octets = ids.view(np.uint8).reshape(-1, 4)
    return [octets[:, k].tobytes() for k in range(-(-width // 8))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if bits:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
        else:
            ids.view(np.uint8).reshape(-1, 4)[:, k] = np.frombuffer(plane, np.uint8)
    return ids


def encode_chunk(doc_ids: list[int | None], docs: list[bytes], bits: bool = False, block: int = BLOCK, level: int = 3) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(docs), "<u4")
    limit = 32 if bits else 4
    sizes, planes = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        packed = [press.compress(p) for p in to_planes(part, bits)]
        sizes.append([len(part), *map(len, packed), *[0] * (limit - len(packed))])
        planes += packed
    head = struct.pack("<QQB", len(docs), len(sizes), limit)
    head += np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes()
    head += np.array([len(d) // 4 for d in docs], "<u8").tobytes() + np.array(sizes, "<u4").tobytes()
    head = press.compress(head)
    return struct.pack("<I", len(head)) + head + b"".join(planes)


def decode_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens per document and all token ids of a chunk."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    (n,) = struct.unpack_from("<I", data)
    head = press.decompress(data[4 : 4 + n])
    docs, blocks, limit = struct.unpack_from("<QQB", head)
    at = 17
    doc_ids = np.frombuffer(head, "<i8", docs, at)
    null = np.frombuffer(head, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(head, "<u8", docs, at + 9 * docs).astype(np.int64)
    sizes = np.frombuffer(head, "<u4", blocks * (limit + 1), at + 17 * docs).reshape(blocks, limit + 1).tolist()
    at, parts = 4 + n, []
    for tokens, *lengths in sizes:
        planes = []
        for length in filter(None, lengths):
            planes.append(press.decompress(data[at : at + length]))
            at += length
        parts.append(from_planes(planes, tokens, limit == 32))
    ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
    return [None if z else int(i) for i, z in zip(doc_ids, null)], counts, ids


class _Writer:
    def __init__(self, folder: str, shard: int, bits: bool):
        from pyarrow import fs

        self.shard, self.bits = shard, bits
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.bin"
        self.name = f"{folder}/{name}"
        self.out = system.open_output_stream(f"{path}/{name}")
        self.offset, self.chunks = 0, []
        self.ids: list[int | None] = []
        self.docs: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.docs.append(ids)
        self.held += len(ids)
        if self.held >= 4 * CHUNK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            data = encode_chunk(self.ids, self.docs, self.bits)
            self.out.write(data)
            self.chunks.append((self.offset, len(data), len(self.docs), self.held // 4))
            self.offset += len(data)
            self.ids, self.docs, self.held = [], [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        footer = struct.pack("<Q", len(self.chunks)) + np.array(self.chunks, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        n = len(self.chunks)
        rows = np.array(self.chunks, dtype=np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([self.shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([self.name] * n), *(pa.array(rows[:, k]) for k in range(4))], ["shard", "chunk", "path", "offset", "length", "docs", "tokens"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bits: bool = False) -> DataFrame:
    """Writes every document's ids, then ``end_id``, in ascending id order, and returns the staged chunk index.

    Documents are range-partitioned by id and, among equal ids, by a hash of the text and then by row, so that neither a
    frequent id nor a row that is repeated often fills one task. Null texts count as empty; null ids come first; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"salt": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions(spark), "id", "salt", "row").sortWithinPartitions("id", "salt", "row").select("id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        with released(encoder(tokenizer, spaced)) as enc:
            for batch in batches:
                for part in text_slices(batch, 1, TOGETHER):
                    out = out or _Writer(folder, TaskContext.get().partitionId(), bits)
                    ids, counts = enc.encode(part.column(1))
                    data, stops = memoryview(ids.tobytes()), 4 * np.cumsum(counts)
                    for doc_id, a, b in zip(part.column(0).to_pylist(), (stops - 4 * counts).tolist(), stops.tolist()):
                        out.add(doc_id, bytes(data[a:b]) + end)
            if out:
                yield out.close()

    return stage(rows.mapInArrow(work, "shard int, chunk int, path string, offset long, length long, docs long, tokens long"), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``, the tokens of all chunks before; shards are summed first, so no window holds all chunks."""
    shards = index.groupBy("shard").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")


def read_tokens(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """Reads the files of ``index`` back: id, start, n_tokens, ids_crc32 and, if asked for, the ids as u32 bytes."""
    chunks = with_starts(index).select("path", "offset", "length", "start").repartition(partitions(index.sparkSession), "path", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as f:
                    f.seek(row["offset"])
                    doc_ids, counts, ids = decode_chunk(f.read(row["length"]))
                stops = np.cumsum(counts)
                data = memoryview(ids.tobytes())
                spans = list(zip((4 * (stops - counts)).tolist(), (4 * stops).tolist()))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(row["start"] + stops - counts), pa.array(counts), pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(data[a:b]) for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return chunks.mapInArrow(work, "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_folder(spark) -> str:
    return scratch(spark, "tokens")
