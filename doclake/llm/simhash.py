"""SimHash near-duplicates: fingerprints, exact tiled comparison and connected components.

Fingerprints lie in tiles, each a file in the shared folder, and tiles are compared pair by pair with numpy exclusive-or and
bit counts. Every differing bit changes the population count of one quarter by one, so tiles whose counts lie further apart
than the radius, quarter by quarter and in sum, are skipped, and so are blocks inside of tiles. Tasks get the numbers of
tiles and read the files themselves; no fingerprint is shuffled for a comparison. No link can be missed, and nothing is
capped.

``near_duplicates`` links fingerprints as such. ``similar_texts`` takes wider ones and a wide radius for candidates only, and links texts
whose word shingles it finds similar enough; there tiles also differ in how many shingles their texts have, and are skipped
where no text of one can be similar to any of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from doclake.arrow import text_slices
from doclake.llm.common import drop_stage, scratch, stage, trimmed
from doclake.llm.components import connected_components, forest

#: Fingerprints in a tile at most, about; where texts are verified, as many fewer as their shingles fill a tile.
TILE = 16_384
TILE_SHINGLES = 1 << 22
#: Shingles that a comparison of two tiles keeps, about, of texts that it has read.
KEPT_SHINGLES = 1 << 18
#: Rows of a block that numpy compares at once.
BLOCK = 256
#: Tiles that one row of work compares a tile with.
PARTNERS = 4
_PENDING = 1 << 18
#: Cells of the four quarters' counts, and steps of size, each a 64th larger than the one before.
CELLS, STEP = 17**4, 1 + 1 / 64


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> bytes:
    """Eight big-endian bytes: a bit is set where over half of the shingles' XXH64 values have it.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than a shingle: one shingle of all of them.
    No words, empty or null text: zero. Long texts go through in pieces, so memory doesn't follow their length twice.
    """
    return _fingerprint(words_of(text), shingle_words, seed)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _fingerprint(words: list[bytes], shingle_words: int, seed: int, bits: int = 64) -> bytes:
    """A fingerprint from hashes of 64 bits, or of 128, XXH3's."""
    import xxhash

    n = len(words)
    if not n:
        return bytes(bits // 8)
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    joined = b" ".join(words)
    if n < shingle_words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    total = np.zeros(bits, np.int64)
    for at in range(0, len(starts), 16_384):
        part = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 16_384], ends[at : at + 16_384])])
        total += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, bits).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp bigint) of every row; ``fp`` holds the fingerprint's 64 bits. Null ids and texts are kept."""
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("fp", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = b"".join([fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(work), out)


# ── comparing ────────────────────────────────────────────────────────────────────────────────────────────────────────────


def quarters(x: np.ndarray) -> np.ndarray:
    """How many bits each quarter of the fingerprints' words of 64 bits has."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(len(x), -1)).astype(np.int16)


def _blocks(x: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """An order of fingerprints by their quarters' counts, where each block starts, and its least and greatest counts."""
    q = quarters(x)
    order = np.lexsort((q[:, 3], q[:, 1], q[:, 2], q[:, 0]))
    q, starts = q[order], list(range(0, len(x), BLOCK))
    return order, starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all fingerprints of two tiles, or within one (b None), that differ in at most ``radius`` bits.

    A fingerprint is a number of 64 bits, or a row of them.
    """
    a = np.ascontiguousarray(a).view(np.uint64).reshape(len(a), -1)
    left, xs, x_low, x_high = _blocks(a)
    x = a[left]
    if b is None:
        right, ys, y, y_low, y_high = left, xs, x, x_low, x_high
    else:
        b = np.ascontiguousarray(b).view(np.uint64).reshape(len(b), -1)
        right, ys, y_low, y_high = _blocks(b)
        y = b[right]
    for i, s in enumerate(xs):
        apart = (np.maximum(x_low[i] - y_high, 0) + np.maximum(y_low - x_high[i], 0)).sum(axis=1)
        rows = x[s : s + BLOCK]
        for j in np.nonzero(apart <= radius)[0]:
            if b is None and j < i:
                continue
            t = ys[j]
            others = y[t : t + BLOCK]
            differ = np.bitwise_count(rows[:, 0, None] ^ others[None, :, 0])
            for k in range(1, x.shape[1]):
                differ += np.bitwise_count(rows[:, k, None] ^ others[None, :, k])
            hit_i, hit_j = np.nonzero(differ <= radius)
            if b is None and j == i:
                keep = hit_i < hit_j
                hit_i, hit_j = hit_i[keep], hit_j[keep]
            if len(hit_i):
                yield left[s + hit_i], right[t + hit_j]


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges for all links of at most ``radius`` bits between two tiles of distinct fingerprints, or within one (b None)."""
    x, y = a.view(np.int64), (a if b is None else b).view(np.int64)
    left, right, pending = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, j in close_pairs(a, b, radius):
        left.append(x[i])
        right.append(y[j])
        pending += len(i)
        if pending > _PENDING:
            child, root = forest(np.concatenate(left), np.concatenate(right))
            left, right, pending = [child], [root], 0
    return forest(np.concatenate(left), np.concatenate(right))


# ── tiles ────────────────────────────────────────────────────────────────────────────────────────────────────────────────


@dataclass
class Tiling:
    """Which tile a row of a cell belongs to, and which tiles can hold anything near each other.

    ``first`` and ``count`` are the tiles of a cell; ``low`` and ``high`` bound the features of a tile's rows.
    """

    first: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    @classmethod
    def of(cls, counts: dict[int, int], cells: int, room: Callable[[int], int], bounds: Callable[[int], tuple], near) -> Tiling:
        """Cells in order share a tile until it is full, and a cell that is larger has several tiles."""
        first, count = np.zeros(cells, np.int32), np.ones(cells, np.int32)
        low, high, held = [], [], 0
        for cell in sorted(counts):
            n, most, (a, b) = counts[cell], room(cell), bounds(cell)
            if n > most or not low or held + n > most:
                first[cell], count[cell] = len(low), -(-n // most)
                low += [np.array(a)] * count[cell]
                high += [np.array(b)] * count[cell]
                held = n if n <= most else most
            else:
                first[cell] = len(low) - 1
                low[-1], high[-1] = np.minimum(low[-1], a), np.maximum(high[-1], b)
                held += n
        return cls(first, count, np.array(low), np.array(high), near)

    def __len__(self) -> int:
        return len(self.low)

    def tile(self, cell: np.ndarray, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[cell] + (mixed % self.count[cell].astype(np.uint64)).astype(np.int32)

    def partners(self, tile: int) -> np.ndarray:
        """The tiles from this one on that can hold something near to something in it."""
        return tile + np.nonzero(self.near(self.low[tile], self.high[tile], self.low[tile:], self.high[tile:]))[0]

    def units(self) -> list[int]:
        """How many tasks' worth of partners come before each tile, and in all."""
        return np.append(0, np.cumsum([-(-len(self.partners(t)) // PARTNERS) for t in range(len(self))])).astype(int).tolist()


def within_radius(radius: int):
    """Whether boxes of quarters' counts come within a radius of each other."""
    return lambda low, high, lows, highs: (np.maximum(lows - high, 0) + np.maximum(low - highs, 0)).sum(axis=1) <= radius


def _cell_of_quarters(x: np.ndarray) -> np.ndarray:
    """Cells in an order that keeps those of like halves together."""
    q = quarters(x).astype(np.int64)
    return ((q[:, 3] * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 0]


def _bounds_of_quarters(cell: int) -> tuple[tuple, tuple]:
    q = (cell % 17, cell // 289 % 17, cell // 17 % 17, cell // 4913)
    return q, q


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tiles(rows: DataFrame, folder: str, tiles: int) -> None:
    """Writes a file per tile of (tile, uid, fp, fp2, n, data): all data, then the other columns, lengths, and how many rows.

    A tile's rows come in one order whichever task writes them, so a task that is run again writes the same file. It gets
    its name once it is whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        now, out, held, name = None, None, [], ""

        def close() -> None:
            for k in range(5):
                out.write(np.array([h[k] for h in held], "<i8").tobytes())
            out.write(np.array([len(held)], "<i8").tobytes())
            out.close()
            try:
                system.move(name, f"{root}/{now}")
            except OSError:  # another attempt of this task may have been first, and some stores don't replace
                if system.get_file_info(f"{root}/{now}").type == fs.FileType.NotFound:
                    raise
                system.delete_file(name)

        for batch in batches:
            for tile, uid, fp, fp2, n, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if tile != now:
                    if out:
                        close()
                    now, held, name = tile, [], f"{root}/.{tile}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name, compression=None)
                data = data or b""
                out.write(data)
                held.append((uid, fp, fp2, n, len(data)))
        if out:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], ["tile"])

    dealt = rows.select("tile", "uid", "fp", "fp2", "n", "data").repartitionById(max(1, tiles), "tile").sortWithinPartitions("uid")
    dealt.mapInArrow(trimmed(work), "tile int").count()


class Tile:
    """A tile's columns, and the data of its rows where it is asked for."""

    def __init__(self, folder: str, tile: int):
        self.system, root = _open(folder)
        self.path = f"{root}/{tile}"
        with self.system.open_input_file(self.path) as f:
            size = f.size()
            (n,) = np.frombuffer(f.read_at(8, size - 8), "<i8")
            columns = np.frombuffer(f.read_at(int(40 * n), int(size - 8 - 40 * n)), "<i8").reshape(5, -1)
        self.uid, self.fp, _, self.n, self.length = columns
        self.wide = np.ascontiguousarray(columns[1:3].T)
        self.start = np.cumsum(self.length) - self.length

    def data(self, k: int) -> bytes:
        with self.system.open_input_file(self.path) as f:
            return f.read_at(int(self.length[k]), int(self.start[k]))


def tile_edges(spark, folder: str, tiling: Tiling, compare: Callable[[Tile, Tile | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b) edges of all pairs of tiles that can hold anything near; a row of work is a tile and some of its partners."""
    units = tiling.units()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                tile = int(np.searchsorted(units, unit, side="right")) - 1
                at = (unit - units[tile]) * PARTNERS
                left = Tile(folder, tile)
                for other in tiling.partners(tile)[at : at + PARTNERS].tolist():
                    child, root = compare(left, None if other == tile else Tile(folder, other))
                    if len(child):
                        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])

    tasks = max(1, min(units[-1], 10_000))
    edges = spark.range(0, units[-1], 1, tasks).mapInArrow(trimmed(work), "a long, b long")
    edges._doclake_path = folder  # drop_stage deletes the tiles
    return edges


def near_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) star edges between the distinct fingerprints of column ``fp`` that connect what links within ``radius`` bits connect.

    The only thing the driver sees is how many fingerprints each of the 17^4 cells of quarters' counts has.
    """
    spark = distinct.sparkSession

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        for batch in batches:
            found += np.bincount(_cell_of_quarters(batch.column(0).to_numpy()), minlength=CELLS)
        at = np.nonzero(found)[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["cell", "n"])

    fps = distinct.select("fp")
    counts = dict(fps.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    tiling = Tiling.of(counts, CELLS, lambda _: TILE, _bounds_of_quarters, within_radius(radius))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            none = np.zeros(len(fp), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tiling.tile(_cell_of_quarters(fp), fp)), batch.column(0), batch.column(0), pa.array(none), pa.array(none), pa.nulls(len(fp), pa.binary())], ["tile", "uid", "fp", "fp2", "n", "data"])

    folder = scratch(spark, "tiles")
    write_tiles(fps.mapInArrow(place, "tile int, uid long, fp long, fp2 long, n long, data binary"), folder, len(tiling))
    return tile_edges(spark, folder, tiling, lambda a, b: compare_tiles(a.fp, None if b is None else b.fp, radius))


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component) of every row of ``docs``.

    fingerprint: 16 lower-case hex digits. component: the least id that links of at most ``radius`` differing bits reach,
    itself included. Equal texts and equal fingerprints count once in the comparison. Null ids stay as rows and lend their
    fingerprint, but name no component unless all ids of it are null. Other columns of ``docs`` play no part.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    edges = near_links(distinct, radius)
    roots = connected_components(edges)
    drop_stage(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    linked = named.groupBy("root").agg(F.min("rep").alias("component"))
    of = stage(named.join(linked, "root").select("fp", "component"), "components")
    drop_stage(distinct)
    drop_stage(named)
    return marked.join(of, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")


# ── similar texts ────────────────────────────────────────────────────────────────────────────────────────────────────────


def shingle_set(words: list[bytes], shingle_words: int) -> set:
    """A text's word shingles, each once; all words together where they are fewer than a shingle, and nothing without words."""
    if len(words) < shingle_words:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle_words))))


class Verifier:
    """Links between two tiles' texts whose shingles are similar enough, of candidates within a radius.

    Candidates that links found before already connect need no comparison, so a group of copies costs one for each text.
    """

    def __init__(self, radius: int, similarity: float, shingle_words: int):
        self.radius, self.similarity, self.words = radius, similarity, shingle_words

    def __call__(self, a: Tile, b: Tile | None) -> tuple[np.ndarray, np.ndarray]:
        sides = (a, a if b is None else b)
        up: dict[int, int] = {}
        kept: dict[tuple[int, int], set] = {}
        room = KEPT_SHINGLES
        links: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def shingles(side: int, k: int) -> set:
            nonlocal room
            got = kept.get((side, k))
            if got is None:
                if room < 0:
                    kept.clear()
                    room = KEPT_SHINGLES
                got = kept[side, k] = shingle_set(unpacked(sides[side].data(k)), self.words)
                room -= len(got)
            return got

        for i, j in close_pairs(a.wide, None if b is None else b.wide, self.radius):
            n, m = a.n[i], sides[1].n[j]
            fit = np.minimum(n, m) >= self.similarity * np.maximum(n, m)
            for p, q in zip(i[fit].tolist(), j[fit].tolist()):
                x, y = int(a.uid[p]), int(sides[1].uid[q])
                if root(x) != root(y):
                    s, t = shingles(0, p), shingles(0 if b is None else 1, q)
                    both = len(s & t)
                    if both >= self.similarity * (len(s) + len(t) - both):
                        links.append((x, y))
                        up[root(x)] = root(y)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return forest(pairs[:, 0], pairs[:, 1])


def packed(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpacked(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split()


def _size_cell(n: np.ndarray) -> np.ndarray:
    return (np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.int64)


def similar_texts(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, radius: int = 36, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, component) of every row: the least id that links between similar texts reach, itself included.

    Texts are words without ASCII white space, with A-Z lower-cased. Two link where their sets of shingles of
    ``shingle_words`` words have a Jaccard similarity of ``similarity`` or more, which is always checked on the shingles
    themselves; texts without words are equal, and similar to nothing else. Candidates are texts whose fingerprints of 128
    bits differ in at most ``radius`` bits. At a similarity of 0.8 a bit differs with a chance near 0.15: 19 bits, give or
    take 4, so that 36 let go about one pair in 100,000 at that very threshold and fewer above it, and of pairs that have
    nothing in common keep one in a million. Ids must be unique and not null; rows of equal words are found by a 128-bit
    hash and compared once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in text_slices(batch, 1):
                keys, prints, sizes = [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    prints.append(_fingerprint(words, shingle_words, seed, 128))
                    sizes.append(len(shingle_set(words, shingle_words)))
                bits = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.array(sizes, pa.int64())], ["id", "key", "fp", "fp2", "n"])

    out = StructType([StructField("id", kind), StructField("key", BinaryType()), StructField("fp", LongType()), StructField("fp2", LongType()), StructField("n", LongType())])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = stage(source.mapInArrow(trimmed(mark), out), "marked")
    distinct = stage(marked.groupBy("key").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("n").alias("n")).withColumn("uid", F.monotonically_increasing_id()), "distinct")
    edges = _similar_edges(source, distinct, similarity, shingle_words, radius, spark)
    roots = connected_components(edges).withColumnRenamed("node", "uid")
    drop_stage(edges)
    named = stage(distinct.join(roots, "uid", "left").select("key", "rep", F.coalesce("root", "uid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of = stage(named.join(least, "root").select("key", "component"), "components")
    drop_stage(named)
    return marked.join(of, "key").select("id", "component")


def _similar_edges(source: DataFrame, distinct: DataFrame, similarity: float, shingle_words: int, radius: int, spark) -> DataFrame:
    """(a, b) edges between the numbers of distinct texts that are similar; sums of each step of size reach the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(_size_cell(batch.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])

    worded = distinct.where("n > 0")
    counts = dict(worded.select("n").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    upper = lambda cell: STEP ** (cell + 1) + 1
    room = lambda cell: int(max(1, min(TILE, TILE_SHINGLES // upper(cell))))
    apart = lambda low, high, lows, highs: ((lows * similarity <= high) & (low * similarity <= highs)).all(axis=1)
    tiling = Tiling.of(counts, max(counts) + 1, room, lambda cell: ((STEP**cell - 1,), (upper(cell),)), apart)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 4):
                n, uid = (part.column(k).to_numpy() for k in (2, 3))
                data = [packed(words_of(t.as_py())) for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([pa.array(tiling.tile(_size_cell(n), uid)), part.column(3), *part.columns[:3], pa.array(data, pa.binary())], ["tile", "uid", "fp", "fp2", "n", "data"])

    first = worded.select(F.col("rep").alias("id"), "fp", "fp2", "n", "uid").join(source, "id").select("fp", "fp2", "n", "uid", "text")
    folder = scratch(spark, "tiles")
    write_tiles(first.mapInArrow(trimmed(place), "tile int, uid long, fp long, fp2 long, n long, data binary"), folder, len(tiling))
    return tile_edges(spark, folder, tiling, Verifier(radius, similarity, shingle_words))
