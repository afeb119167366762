"""Worksheets as cells and merged ranges, and rendered as Markdown, HTML, records or JSON.

cells(source, sheet, row, col, value) and merges(source, sheet, min_row, min_col, max_row, max_col), all counted from one.
Cells that aren't there are empty. Null values are empty cells; a row of them is blank. Other columns play no part. Cells
must not repeat a place of a sheet: where they do, any of the values stands there. Merges that repeat have no master. Empty
tables give empty ones. Rows of null sources or sheets are left out, as they belong to no sheet. To be rendered, a sheet is
put together in one task, by one shuffle of all cells and merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doclake.arrow import SLICE, plain
from doclake.operators import sheets

SHEET = ["source", "sheet"]
#: Sheets whose cells are Python objects at once.
SHEETS = 500


def drop_blank_rows(cells: DataFrame) -> DataFrame:
    """Without rows whose cells are all null."""
    kept = cells.where(F.col("value").isNotNull()).select(*SHEET, "row").distinct()
    return cells.join(kept, [*SHEET, "row"], "left_semi")


def row_map(cells: DataFrame) -> DataFrame:
    """(source, sheet, row, new_row): rows that stay, counted anew from one."""
    rows = cells.where(F.col("value").isNotNull()).select(*SHEET, "row").distinct()
    return rows.withColumn("new_row", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")))


def remap_rows(cells: DataFrame) -> DataFrame:
    return cells.join(row_map(cells), [*SHEET, "row"]).withColumn("row", F.col("new_row")).drop("new_row")


def remap_merges(merges: DataFrame, rows: DataFrame) -> DataFrame:
    """Merges in the new rows; a merge that reaches over a dropped row, or past the last row, goes."""
    spans = merges.select(*SHEET, "min_row", "min_col", "max_row", "max_col", F.explode(F.sequence("min_row", "max_row")).alias("row"))
    found = spans.join(rows, [*SHEET, "row"]).groupBy(*SHEET, "min_row", "min_col", "max_row", "max_col").agg(F.count("*").alias("n"), F.min("new_row").alias("a"), F.max("new_row").alias("b"))
    whole = found.where(F.col("n") == F.col("max_row") - F.col("min_row") + 1)
    return whole.select(*SHEET, F.col("a").alias("min_row"), "min_col", F.col("b").alias("max_row"), "max_col")


def merge_map(merges: DataFrame) -> DataFrame:
    """A row per cell of a merge. Where merges overlap the first one (by row and column) has the cell, as no one's master."""
    rows = merges.select(*SHEET, "min_row", "min_col", "max_row", "max_col", F.explode(F.sequence("min_row", "max_row")).alias("row"))
    legs = rows.select("*", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    first = F.struct("min_row", "min_col", "max_row", "max_col")
    held = legs.groupBy(*SHEET, "row", "col").agg(F.min(first).alias("m"), F.count("*").alias("n"))
    return held.select(
        *SHEET,
        "row",
        "col",
        "m.min_row",
        "m.min_col",
        (F.col("m.max_row") - F.col("m.min_row") + 1).alias("rowspan"),
        (F.col("m.max_col") - F.col("m.min_col") + 1).alias("colspan"),
        ((F.col("row") == F.col("m.min_row")) & (F.col("col") == F.col("m.min_col")) & (F.col("n") == 1)).alias("is_master"),
    )


def prepare(cells: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and merges without blank rows, rows counted anew."""
    rows = row_map(cells)
    return cells.join(rows, [*SHEET, "row"]).withColumn("row", F.col("new_row")).drop("new_row"), remap_merges(merges, rows)


def whole_sheets(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(source, sheet, cells, merges): a row per sheet that has cells, put together by one shuffle."""
    cell = F.struct("row", "col", "value").alias("cell")
    merge = F.struct("min_row", "min_col", "max_row", "max_col").alias("merge")
    rows = cells.select(*SHEET, cell, F.lit(None).cast("struct<min_row:int,min_col:int,max_row:int,max_col:int>").alias("merge"))
    if merges is not None:
        rows = rows.unionByName(merges.select(*SHEET, F.lit(None).cast(cells.select(cell).schema[0].dataType).alias("cell"), merge))
    whole = rows.where("source is not null and sheet is not null").groupBy(*SHEET).agg(F.collect_list("cell").alias("cells"), F.collect_list("merge").alias("merges"))
    return whole.where("size(cells) > 0")


def _rendered(whole: DataFrame, schema: str, rows: Callable[[sheets.Sheet], list[tuple]]) -> DataFrame:
    """(source, sheet, ...) with what ``rows`` makes of each sheet. Rows leave a worker whenever they hold some MB."""
    kinds = T.StructType.fromDDL(schema)
    names = ["source", "sheet", *kinds.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), *(to_arrow_type(f.dataType) for f in kinds)]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for at in range(0, batch.num_rows, SHEETS):
                part, made, held = batch.slice(at, SHEETS), [], 0
                for source, sheet, cells, merges in zip(plain(part.column(0)), plain(part.column(1)), _structs(part.column(2)), _structs(part.column(3))):
                    one = sheets.Sheet(source, sheet, {(r, c): v for r, c, v in cells}, merges)
                    for row in rows(one):
                        made.append((source, sheet, *row))
                        held += sum([len(v) for v in row if isinstance(v, str)]) + 16
                        if held > SLICE:
                            yield batch_of(made)
                            made, held = [], 0
                if made:
                    yield batch_of(made)

    return whole.mapInArrow(work, f"source string, sheet string, {schema}")


def _structs(lists: pa.Array) -> list[list[tuple]]:
    """The rows of lists of structs, each struct as a tuple."""
    flat, stops = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    rows = list(zip(*(plain(c) for c in flat.flatten())))
    return [rows[a:b] for a, b in zip([0, *stops], stops)]


def md_table(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(source, sheet, markdown): a comment, then a table whose first row is the header.

    Without ``merges`` a literal backslash-n counts as a line break; with them only a merge's first cell has its value.
    """
    return md_sheets(whole_sheets(cells, merges), merges is not None)


def md_sheets(whole: DataFrame, enhanced: bool = False) -> DataFrame:
    """What ``md_table`` makes, of sheets that are whole already, as ``whole_sheets`` gives them. No shuffle."""
    return _rendered(whole, "markdown string", lambda s: [(sheets.markdown(s, enhanced),)])


def html_table(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(source, sheet, html): header and body with spans; cells below a merge's first one are left out."""
    return _rendered(whole_sheets(cells, merges), "html string", lambda s: [(sheets.html_table(s),)])


def table_records(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """A row per body cell: its header, key and value; a merge's other cells take its first cell's value.

    A blank header takes the first value below it; plain numbers and ``Unnamed: n`` become ``col_n``. A sheet with nothing
    but a header has no records.
    """
    schema = "row int, col int, header string, key string, value string, merged boolean, skipped boolean, rowspan int, colspan int"
    return _rendered(whole_sheets(cells, merges), schema, lambda s: [tuple(r.values()) for r in sheets.records(s)])


def json_table(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(source, sheet, json): metadata, and a record per body row with its number, its cells in detail and its values by key.

    A sheet with nothing but a header has no data, and then no columns, headers or merges in its metadata either.
    """
    return _rendered(whole_sheets(cells, merges), "json string", lambda s: [(sheets.as_json(s),)])


def json_book(tables: DataFrame) -> DataFrame:
    """(source, json) from (source, sheet, json): one object with all sheets of a source, by name."""
    sheet = F.struct("sheet", F.concat(F.lit('{"sheet":'), _quoted("sheet"), F.lit(',"content":'), "json", F.lit("}")).alias("text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(sheet)), lambda x: x["text"]), ",")
    name = F.regexp_extract("source", r"([^/]*)\z", 1)
    return tables.groupBy("source").agg(listed.alias("sheets")).select("source", F.concat(F.lit('{"source":'), _quoted(name), F.lit(',"sheets":['), "sheets", F.lit("]}")).alias("json"))


def _quoted(text: str | Column) -> Column:
    """A string as JSON: an array's only element, without its brackets."""
    inside = F.to_json(F.array(F.col(text) if isinstance(text, str) else text))
    return F.substring(inside, F.lit(2), F.char_length(inside) - 2)
