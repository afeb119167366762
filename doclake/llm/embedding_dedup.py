"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines and connected components.

Equal vectors of a label are one class with a count. Each class gets a signature of sign bits per table; classes that
share a table's signature are compared exactly, in tiles when they are many, so no bucket is capped. The number of bits is
fixed and that of tables follows from the wanted chance of finding a pair that lies just at the threshold, so this chance
is the same for every pair, however many vectors there are. A pair that meets in several tables counts in the first one
only, so pairs need not be made distinct.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import partitions, stage
from doclake.llm.components import connected_components, forest

#: Classes in a tile of a bucket at most, about.
TILE = 1_024
RECALL = 0.99
#: Sign bits of a signature: buckets of a label are a 16,384th of it where its vectors have nothing in common.
BITS = 14
#: Groups up to this size are compared many at once, so many pairs at a time.
SMALL = 32
PAIRS = 1 << 15


def plan_tables(threshold: float, recall: float = RECALL, bits: int = BITS) -> int:
    """How many tables bring two vectors together with a chance of ``recall`` if their cosine is the threshold."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


@functools.lru_cache(maxsize=4)
def hyperplanes(dimensions: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, bits * tables))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def _vectors(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors in double precision, divided by their largest component, which no cosine sees and no square overflows with."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL, seed: int = 17) -> DataFrame:
    """(id, n_links, component, kept) of every row of ``vectors``.

    Rows are compared only where labels are equal and not null, and lengths are equal. Vectors that are null, empty, zero, or hold null or
    non-finite numbers link with nothing and are their own component. n_links counts other rows, copies included. component
    is the least id that links reach; rows with null ids keep their links but name a component only if all its ids are
    null. Rows that repeat an id and vector are vectors of their own that share a component, and all name themselves.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))),
        F.lit(False),
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), usable.alias("usable"))
    rows = rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))), 256)))

    # Single-precision input is kept as it is until it is compared, in double precision.
    blob = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.array(x, blob).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary()), batch.column(4)], ["label", "key", "rep", "vec", "n"])

    label_type = vectors.schema[label_col].dataType.simpleString()
    id_type = vectors.schema[id_col].dataType.simpleString()
    grouped = rows.where("usable").groupBy("label", "key").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.count("*").alias("n"))
    packed = grouped.select("label", "key", "rep", "v", "n").mapInArrow(pack, f"label {label_type}, key string, rep {id_type}, vec binary, n long")
    classes = stage(packed.withColumn("cid", F.monotonically_increasing_id()), "classes")
    tables = plan_tables(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            lengths = np.array([len(b) for b in blobs])
            out: list[list[int]] = [[]] * len(blobs)
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                for k, s in zip(at, signatures(_vectors([blobs[k] for k in at], blob), BITS, tables, seed)):
                    out[k] = s.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["cid", "sigs"])

    signed = stage(classes.select("cid", "vec").mapInArrow(sign, "cid long, sigs array<int>").join(classes, "cid"), "signed")
    width = F.length("vec").alias("width")
    narrow = signed.select("cid", "label", width, F.posexplode("sigs").alias("t", "sig"))
    sizes = narrow.groupBy("label", "width", "t", "sig").agg(F.count("*").alias("m")).where("m > 1").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    sizes = sizes.withColumn("bucket", F.xxhash64("label", "width", "t", "sig"))
    met = narrow.join(sizes, ["label", "width", "t", "sig"]).withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))
    spread = met.select("cid", "bucket", "t", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"), "label", "width", "sig")
    keyed = spread.select("cid", "t", "sig", "label", "width", "bucket", "tile", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"))
    loaded = keyed.join(signed.select("cid", "vec", "sigs", "n"), "cid")
    order = ["bucket", "one", "two", "t", "sig", "width"]
    dealt = loaded.select(*order, F.col("label").cast("string").alias("label"), "tile", "cid", "vec", "sigs", "n").repartition(partitions(spark), "bucket", "one", "two").sortWithinPartitions(*order, "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            i, j = linked(rows, starts, blob, threshold)
            if not len(i):
                continue
            cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
            links = np.zeros(len(cid), np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            child, root = forest(cid[i], cid[j])
            at = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cid[at], child])), pa.array(np.concatenate([cid[at], root])), pa.array(np.concatenate([links[at], np.zeros(len(child), np.int64)]))],
                ["a", "b", "links"],
            )

    found = stage(dealt.mapInArrow(work, "a long, b long, links long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("label", "key", "cid", "rep", "n").join(roots, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of = stage(named.join(least, "root").select("label", "key", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "classes")
    ids = rows.select("id", "label", "key")
    out = ids.where("key is not null").join(of, ["label", "key"]).select("id", F.col("links").alias("n_links"), "component")
    alone = ids.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


_KEY = ("bucket", "one", "two", "t", "sig", "width", "label")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole groups, which share the columns of _KEY, and where each group starts; the last one of a batch waits for more."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        for name in _KEY:
            column = held.column(name)
            x = (column.dictionary_encode().indices if name == "label" else column).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        starts = np.nonzero(new)[0]
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def linked(rows: pa.RecordBatch, starts: np.ndarray, blob: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of each group that link and that no table before the group's has brought together.

    A group holds one tile, or two of which only pairs across count. Small groups of like size are compared all at once.
    """
    one, two, tile, table, width = (rows.column(c).to_numpy() for c in ("one", "two", "tile", "t", "width"))
    sigs = rows.column("sigs").flatten().to_numpy().reshape(rows.num_rows, -1)
    vectors = rows.column("vec")
    sizes = np.diff(np.append(starts, rows.num_rows))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(width[starts]):
        of = np.nonzero(width[starts] == w)[0]
        inside = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in of]) if len(of) < len(starts) else np.arange(rows.num_rows)
        x = np.zeros((rows.num_rows, w // int(blob[-1])))
        x[inside] = _unit(_vectors(vectors.take(pa.array(inside)).to_pylist() if len(of) < len(starts) else vectors.to_pylist(), blob))
        for n in np.unique(sizes[of]):
            at = starts[of[sizes[of] == n]]
            if n > SMALL:
                for s in at.tolist():
                    a = s + np.nonzero(tile[s : s + n] == one[s])[0]
                    b = a if one[s] == two[s] else s + np.nonzero(tile[s : s + n] == two[s])[0]
                    p, q = np.nonzero(x[a] @ x[b].T >= threshold)
                    p, q = (a[p], b[q]) if one[s] != two[s] else (a[p[p < q]], b[q[p < q]])
                    found.append(_first_meeting(p, q, sigs, table))
                continue
            p, q = np.triu_indices(n, 1)
            i, j = ((at[:, None] + k).ravel() for k in (p, q))
            across = (one[i] == two[i]) | (tile[i] != tile[j])
            i, j = i[across], j[across]
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                found.append(_first_meeting(p[near], q[near], sigs, table))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64),) * 2


def _first_meeting(i: np.ndarray, j: np.ndarray, sigs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose signatures agree in no table before their group's."""
    before = np.arange(sigs.shape[1]) < table[i][:, None]
    first = ~((sigs[i] == sigs[j]) & before).any(axis=1)
    return i[first], j[first]
