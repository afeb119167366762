"""Extras for judging chunks: coverage and redundancy, retrieval metrics, and the headings above a section.

Null and empty texts have no chunks and no coverage. Nulls among answers count as irrelevant. Keys name texts and queries:
rows that share one belong together, and rows with a null key are one text of their own, or none where tables are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def structure(texts: DataFrame, chunks: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, chunk_count, coverage, redundancy): the share of a text inside any chunk, and what chunks hold beyond that.

    Spans are merged by a running maximum of their ends, so overlaps count once.
    """
    order = Window.partitionBy(key).orderBy("start_index", "end_index")
    reach = F.coalesce(F.max("end_index").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("end_index") - F.greatest(F.col("start_index"), reach), F.lit(0))
    spans = chunks.select(key, (F.col("end_index") - F.col("start_index")).alias("n"), fresh.alias("fresh"))
    sums = spans.groupBy(key).agg(F.count("*").alias("chunk_count"), F.sum("n").alias("all"), F.sum("fresh").alias("fresh"))
    joined = texts.select(key, F.char_length(text_col).alias("length")).join(sums, key, "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("length"), F.lit(0.0))
    return joined.select(key, F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), share("fresh").alias("coverage"), F.coalesce((F.col("all") - F.col("fresh")) / F.col("length"), F.lit(0.0)).alias("redundancy"))


def retrieval(ranked: DataFrame, query: str, relevant: str, order: list[Column | str], k: int) -> DataFrame:
    """(query, recall, mrr, ndcg) at ``k`` of queries with a relevant answer; answers are ranked by ``order``."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    rows = ranked.select(query, F.col(relevant).alias("hit"), rank.alias("rank"))
    near = F.col("hit") & (F.col("rank") <= k)
    sums = rows.groupBy(query).agg(
        F.count_if("hit").alias("total"),
        F.count_if(near).alias("found"),
        F.min(F.when(near, F.col("rank"))).alias("first"),
        F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return sums.where("total > 0").select(query, (F.col("found") / F.col("total")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("gain") / best).alias("ndcg"))


def breadcrumbs(sections: DataFrame, key: str) -> DataFrame:
    """``sections`` of ``heading_chunks`` with ``levels``, the last heading of each of the six levels at or above them.

    A heading ends all deeper ones; levels without a heading are null.
    """
    order = Window.partitionBy(key).orderBy("start_index")
    level = F.when(F.col("header") == "", F.char_length(F.regexp_extract("chunk_text", r"\A(#{1,6})\s*\n", 1))).otherwise(F.char_length(F.regexp_extract("chunk_text", r"\A(#{1,6})", 1)))
    marked = sections.withColumn("__level", level)
    found = marked
    for n in range(1, 7):
        here = F.when(F.col("__level") == n, F.struct("start_index", "header"))
        found = found.withColumn(f"__h{n}", F.last(here, ignorenulls=True).over(order))
    names: list[Column] = []
    newest: Column = F.lit(-1).cast("long")
    for n in range(1, 7):
        at = F.col(f"__h{n}.start_index")
        holds = at > newest if n > 1 else at.isNotNull()
        names.append(F.when(holds, F.col(f"__h{n}.header")))
        newest = F.greatest(newest, F.coalesce(at, newest))
    return found.withColumn("levels", F.array(*names)).drop("__level", *[f"__h{n}" for n in range(1, 7)])
