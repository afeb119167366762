"""One query per operator over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The key of the pseudonyms in the query and the pipeline; a deployment passes its own secret.
PII_KEY = b"doclake-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op2_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.token_files import read_tokens, token_folder, write_tokens

    index = write_tokens(table(spark, sf_dir, "documents"), token_folder(spark), "word_bpe_49k.json", spaced=False, end_id=1)
    return read_tokens(index, with_ids=False).withColumnRenamed("id", "doc_id")


def op3_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.sp_dropout import encode_documents

    encoded = encode_documents(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", rate=0.1, seed=7, with_ids=False)
    return encoded.withColumnRenamed("id", "doc_id")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, kinds_col=None)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.quality_rules import quality_rules

    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    scored = quality_rules(table(spark, sf_dir, "documents"), trusted)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.token_counts import token_counts

    counted = token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.embedding_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.quality_classifier import quality_classifier

    scored = quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3, keep=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2, capacity=1024)
    return packed.withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclake.llm.common import scratch
    from doclake.llm.warc import read_warc, write_warc

    index = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(index, with_payload=False).drop("url")


def _base32_sql(hex_col: str) -> str:
    """SQL for the base32 digits of a 40-digit hex string: eight groups of 20 bits, four digits each."""
    groups = [f"substr({hex_col}, {5 * k + 1}, 5)" for k in range(8)]
    digits = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || {g} AS BIGINT) >> {5 * s}) & 31)::INT + 1, 1)" for g in groups for s in (3, 2, 1, 0)]
    return " || ".join(digits)


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS sha,
                  min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {_base32_sql('sha')} AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""


# ── parts of the queries above that SQL can express ──────────────────────────────────────────────────────────────────────


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's base counts and verdict of every document."""
    from doclake.llm.quality_rules import with_base_counts

    counted = with_base_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     k AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) > 4),
     n AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 4], ' ')) AS n FROM k),
     r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM n WHERE n > 1) GROUP BY doc_id),
     c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
     a AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
"""


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's bytes of every document, without its tokens."""
    counted = op6_token_counts(spark, sf_dir)
    return counted.select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("no_more_tokens_than_bytes"))


TEXT_BYTES_SQL = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, true AS no_more_tokens_than_bytes FROM documents"


def held_out_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents operator 8 never learns from, and which of them are labelled."""
    from doclake.llm.quality_classifier import held_out

    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id").alias("held_out"))
    return docs.join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def _held_out_sql() -> str:
    """The usual checksum by bytes, over a table of 256 remainders that the polynomial gives."""
    remainders = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        remainders.append(n)
    return f"""
WITH t AS (SELECT {remainders}::BIGINT[] AS k),
     c AS (SELECT doc_id, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])) AS c FROM documents, t)
SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS held_out, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND quality IS NOT NULL) AS labelled FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries ``opN_``, and those that check a part of them by SQL."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {f.__name__: f for f in (base_counts, text_bytes, held_out_fold)}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL, "base_counts": BASE_SQL, "text_bytes": TEXT_BYTES_SQL, "held_out_fold": _held_out_sql()}
