"""Quality rules: base counts of words, lines and repeats, and a hashed n-gram likelihood ratio; SQL functions only.

The ratio compares two multinomials over hashed pieces: runs of lower-case letters, runs of other letters, and runs of
anything else between white space, alone and in pairs. One is counted over trusted documents, the other over the whole
corpus. A document's score is the mean of log(p_trusted / p_corpus) over all its pieces and pairs, so that its length
doesn't matter, and it is kept from ``threshold`` on. No document is scored on a part of its text or drawn by chance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the two multinomials; their weights are one array of this length.
BUCKETS = 16_384
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.2
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Bits of the filter for trusted ids, and how many rows of 32,768 bits it has at most.
BITS_PER_ID = 32
MAX_BITMAPS = 16_384

WHITE = " \t\n\x0b\x0c\r"
_WS = r"[\x20\x09-\x0D]+"


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed.

    Words are runs without ASCII white space; a null text has none. n_repeat_words counts the words that lie in five-word
    windows found twice or more in the text, the first find included. Columns of these names in ``docs`` are replaced;
    only names that start with ``__doclake_`` are taken for work.
    """
    first = docs.withColumns({"__doclake_text": _text(text_col)}).withColumn("__doclake_trim", F.trim("__doclake_text", F.lit(WHITE)))
    words = first.withColumn("__doclake_hash", F.expr(rf"if(__doclake_trim = '', array(), transform(split(__doclake_trim, r'{_WS}'), w -> xxhash64(w)))"))
    windows = words.withColumn(
        "__doclake_win",
        F.expr("if(size(__doclake_hash) < 5, cast(array() as array<bigint>), transform(sequence(0, size(__doclake_hash) - 5), i -> xxhash64(get(__doclake_hash, i), get(__doclake_hash, i + 1), get(__doclake_hash, i + 2), get(__doclake_hash, i + 3), get(__doclake_hash, i + 4))))"),
    )
    ordered = windows.withColumn("__doclake_sorted", F.expr("if(size(array_distinct(__doclake_win)) = size(__doclake_win), null, array_sort(transform(__doclake_win, (h, i) -> struct(h as h, i as i))))"))
    found = ordered.withColumn("__doclake_at", F.expr("array_sort(filter(transform(__doclake_sorted, (x, k) -> if(get(__doclake_sorted, k - 1).h = x.h or get(__doclake_sorted, k + 1).h = x.h, x.i, null)), p -> p is not null))"))
    lined = found.withColumn("__doclake_lines", F.expr(r"if(instr(__doclake_trim, '\n') = 0, array(), filter(split(__doclake_text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]'))"))
    counts = {
        "n_words": F.expr("cast(size(__doclake_hash) as bigint)"),
        "word_chars": F.expr(rf"cast(length(regexp_replace(__doclake_text, r'{_WS}', '')) as bigint)"),
        "n_symbols": F.expr("cast(length(__doclake_text) - length(regexp_replace(__doclake_text, '[#*$%&|<>]+', '')) as bigint)"),
        "n_dup_lines": F.expr("cast(size(__doclake_lines) - size(array_distinct(__doclake_lines)) as bigint)"),
        "n_repeat_words": F.expr("coalesce(aggregate(__doclake_at, struct(0L as n, -5 as p), (a, x) -> struct(a.n + least(5, x - a.p) as n, x as p), a -> a.n), 0L)"),
    }
    counted = lined.withColumn("__doclake_counts", _once(F.struct(*[c.alias(n) for n, c in counts.items()]))).withColumns({n: F.col(f"__doclake_counts.{n}") for n in counts})
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return counted.withColumn("base_failed", failed).drop("__doclake_text", "__doclake_trim", "__doclake_hash", "__doclake_win", "__doclake_sorted", "__doclake_at", "__doclake_lines", "__doclake_counts")


def _once(value: Column) -> Column:
    """``value``, kept by the optimizer in a projection of its own.

    A filter on what follows from it would otherwise be pushed down with copies of the whole expression, and a text would
    be split anew for each of its words.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _with_buckets(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """``docs`` with ``__doclake_one``, the bucket of every piece, and ``__doclake_two``, that of every pair of neighbours."""
    pieces = docs.withColumn("__doclake_h", F.expr(rf"transform(regexp_extract_all(coalesce(cast(`{text_col}` as string), ''), r'\p{{Ll}}+|[\p{{L}}&&[^\p{{Ll}}]]+|[^\p{{L}}\x20\x09-\x0D]+', 0), p -> xxhash64(p))"))
    return pieces.withColumns(
        {
            "__doclake_one": F.expr(f"transform(__doclake_h, h -> cast(pmod(h, {buckets}) as int))"),
            "__doclake_two": F.expr(f"if(size(__doclake_h) < 2, cast(array() as array<int>), transform(sequence(0, size(__doclake_h) - 2), i -> cast(pmod(xxhash64(get(__doclake_h, i), get(__doclake_h, i + 1)), {buckets}) as int)))"),
        }
    ).drop("__doclake_h")


def _maybe_trusted(ids: DataFrame, good: DataFrame) -> DataFrame:
    """``ids`` with ``__doclake_maybe``: true for every id among ``good``, and for few others as long as the filter isn't full.

    The filter is a bitmap of BITS_PER_ID bits an id in rows of 32,768 bits, at most MAX_BITMAPS of them: 64 MB, however
    many ids there are. What it lets through costs a shuffled row and changes no result.
    """
    rows = min(MAX_BITMAPS, max(1, -(-good.count() * BITS_PER_ID // 32_768)))
    place = f"pmod(xxhash64(__doclake_id), {rows * 32_768}L)"
    bits = good.selectExpr(f"{place} as p").groupBy(F.expr("p div 32768").alias("__doclake_row")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("__doclake_bits"))
    met = ids.withColumns({"__doclake_p": F.expr(place), "__doclake_row": F.expr(f"{place} div 32768")}).join(F.broadcast(bits), "__doclake_row", "left")
    octet = "cast(conv(hex(substring(__doclake_bits, cast((__doclake_p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"__doclake_id is not null and coalesce(shiftright({octet}, cast(__doclake_p % 8 as int)) & 1, 0) = 1")
    return met.withColumn("__doclake_maybe", hit).drop("__doclake_p", "__doclake_row", "__doclake_bits")


def fit_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log(p_trusted / p_corpus) of every bucket, as counted over all ``docs``.

    ``trusted`` names trusted documents by ``id_col``; all of them are used. Texts that a bitmap of their ids rules out are
    counted where they are, and the others are shuffled by id to meet the ids: one plan at every size, which moves little
    more than the trusted texts. Null ids are never trusted. Only ``buckets`` sums reach the driver. With no trusted text
    all weights are zero.
    """
    good = trusted.select(F.col(id_col).alias("__doclake_id")).where("__doclake_id is not null").distinct()
    texts = _maybe_trusted(docs.select(F.col(id_col).alias("__doclake_id"), text_col), good)
    named = texts.where("__doclake_maybe").join(good.withColumn("__doclake_good", F.lit(1)).hint("merge"), "__doclake_id", "left")
    marked = named.unionByName(texts.where("not __doclake_maybe").withColumn("__doclake_good", F.lit(0)))
    grams = _with_buckets(marked, text_col, buckets).select(F.coalesce("__doclake_good", F.lit(0)).alias("good"), F.explode(F.concat("__doclake_one", "__doclake_two")).alias("bucket"))
    counts = np.zeros((buckets, 2))
    for bucket, every, good in grams.groupBy("bucket").agg(F.count("*"), F.sum("good")).collect():
        counts[bucket] = every, good
    if not counts[:, 1].sum():
        return np.zeros(buckets)
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets)
    return np.log(p[:, 1]) - np.log(p[:, 0])


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``llr``, the mean weight of all pieces and pairs of a text; 0 for a text without any."""
    known = _with_buckets(docs, text_col, len(weights)).withColumn("__doclake_w", F.lit(np.asarray(weights, dtype=np.float64)))
    total = "aggregate(__doclake_one, 0D, (s, b) -> s + get(__doclake_w, b)) + aggregate(__doclake_two, 0D, (s, b) -> s + get(__doclake_w, b))"
    mean = F.expr(f"if(size(__doclake_one) = 0, 0D, ({total}) / (size(__doclake_one) + size(__doclake_two)))")
    return known.withColumn("llr", _once(mean)).drop("__doclake_one", "__doclake_two", "__doclake_w")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base counts, ``llr`` and ``kept``.

    kept: false where base_failed, otherwise whether llr >= threshold. Null and empty texts have no words and so fail; null
    ids are scored like any other; repeated rows get the same verdict; an empty table stays empty.
    """
    weights = fit_weights(docs, trusted, id_col, text_col, buckets)
    scored = with_score(with_base_counts(docs, text_col), weights, text_col)
    return scored.withColumn("kept", F.expr(f"not base_failed and llr >= {threshold!r}D"))
