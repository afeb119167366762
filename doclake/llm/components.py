"""Connected components of an edge table, as alternating star contractions over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import drop_stage, stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (child, root) that connect what the links (a, b) connect; each root is its component's least node.

    Duplicates and self links vanish. At most one edge per node comes back, however many links go in.
    """
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[child], nodes[label[child]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component, and is itself among the nodes.

    Null ends and self links are ignored; an empty table gives an empty table. Each round hangs every neighbourhood on its
    least node (large star), then every lower neighbour (small star). Group minima are partly aggregated before they are
    shuffled, and written out before they are joined, so that Spark can split a hub's rows over several tasks of the join.
    Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = stage(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        before, now = now, stage(small, "edges")
        for done in (before, least, large, low):
            drop_stage(done)
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen:
            break
        seen = (n, mark)
    children = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return children.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
