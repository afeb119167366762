"""File names that don't collide within a batch.

Other columns are kept, but a column with the name of the new one is replaced. Null names stay null, rows that are equal in
name and order get their numbers in any order, and an empty table stays empty. A name that very many rows share is numbered
in one task, which holds no more than those rows' order at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.names import clean_filename, extension


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """``name`` for its first row in ``order``, and with ``_1``, ``_2``, ... before the suffix for the next ones.

    Numbers come from a window over equal names, so no task sees all names. A name that naturally ends like a numbered one
    isn't told from it.
    """
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    ext = F.substring(name, F.char_length(name) - F.char_length(extension(name)) + 1, F.char_length(extension(name)))
    stem = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext))
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def sheet_suffixes(df: DataFrame, group: str, name: str, order: str, out: str = "suffix") -> DataFrame:
    """Cleaned sheet names, unique within ``group``: the second of equal ones gets ``_2``, and so on."""
    cleaned = df.withColumn("__base", clean_filename(name))
    n = F.row_number().over(Window.partitionBy(group, "__base").orderBy(order))
    return cleaned.withColumn(out, F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), n.cast("string")))).drop("__base")
