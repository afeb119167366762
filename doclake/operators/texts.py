"""Whole-text conversions in Arrow batches. Rows may repeat, other columns are kept, and one with the new name is replaced."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from doclake.arrow import plain, text_slices

#: Bytes of HTML that are turned at once.
PAGES = 1 << 20


def html_to_markdown(df: DataFrame, html_col: str = "html", out: str = "markdown") -> DataFrame:
    """``df`` with ``html_col`` turned into ``out``; null stays null. One pass, no shuffle.

    A worker holds some MB of texts as Python objects at once, or one text that is longer.
    """
    keep = [c for c in df.columns if c not in (html_col, out)]
    schema = StructType([*(df.schema[c] for c in keep), StructField(out, StringType())])

    numbered = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([*keep, html_col])]
    return df.select(*numbered).mapInArrow(lambda batches: turned(batches, schema.names), schema)


def turned(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with the last column turned, in slices of its text; each is given away before the next is begun."""
    from doclake.sources.html import html_to_md

    for batch in batches:
        for part in text_slices(batch, len(names) - 1, PAGES):
            made = [None if t is None else html_to_md(t) for t in plain(part.column(len(names) - 1))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.string())], names)
