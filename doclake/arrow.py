"""Arrow batches cut to a size in bytes, so that memory follows neither the rows of a batch nor what becomes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 4 << 20


def text_slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``size`` bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    stops = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = stops[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(stops, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def plain(array: pa.Array) -> list:
    """What ``to_pylist`` gives; of texts, bytes, whole numbers, and lists of them, in a fraction of its time."""
    if pa.types.is_list(array.type):
        inner, stops = plain(array.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)).tolist()
        found = [inner[a:b] for a, b in zip([0, *stops], stops)]
        return [x if there else None for x, there in zip(found, array.is_valid().to_pylist())] if array.null_count else found
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type) or pa.types.is_integer(array.type) and not array.null_count:
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def numbered(df: DataFrame, columns: list[str], last: Column) -> DataFrame:
    """``columns`` and ``last`` under numbered names, as a batch's columns may bear any name, and some more than once."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], last.alias(f"c{len(columns)}"))
