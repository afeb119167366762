"""The corpus pipeline: quality rules, quality classifier, near-duplicates, pseudonyms and packing, one after the other.

Each stage is a function of (spark, docs, sf_dir) and gets all that its predecessor kept, reread from Parquet. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common
from doclake.llm import packing as best_fit
from doclake.llm import pii, quality_classifier, simhash
from doclake.llm import quality_rules as rules
from doclake.llm.queries import PII_KEY, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither fails the base counts nor falls below the likelihood ratio's threshold."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return rules.quality_rules(docs, trusted).where("kept").select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, trained on labelled rows of its input, predicts to be good."""
    scored = quality_classifier.quality_classifier(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group; of rows that share that id too, one.

    Texts link where their shingles of five words have a similarity of 0.8 or more. Texts without words are one group.
    """
    rows = common.stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = simhash.similar_texts(rows.withColumn("__id", F.struct("doc_id", "__row")), similarity=0.8, shingle_words=5, radius=36, id_col="__id")
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all texts; n_chars follows the new text."""
    done = pii.pseudonymise(docs, PII_KEY, replaced_col=None, kinds_col=None)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    return best_fit.pack(docs, "byte_bpe_50k.json", end_id=2, capacity=1024).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("pii_pseudonyms", pseudonymise),
    ("best_fit_packing", pack),
]

#: Hashed weights, tokenizers and keyed permutations have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), name)
        common.drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
