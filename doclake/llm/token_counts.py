"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from doclake.llm.bpe import TOGETHER, counter
from doclake.llm.common import released, text_slices


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes, and tokens of the whole text without added special tokens.

    Special strings inside a text count as one token, as the library's default has it. Null texts count as empty: no bytes
    and no tokens. Null ids and repeated rows are kept; other columns play no part. There is no shuffle.
    """
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released(counter(tokenizer)) as merger:
            for batch in batches:
                for part in text_slices(batch, 2, TOGETHER):
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(merger.counts(part.column(2)))], out.names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(work, out)
