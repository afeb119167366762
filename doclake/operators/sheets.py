"""One worksheet as plain values: blank rows dropped, merges followed, and rendered as Markdown, HTML or records.

Cells are a dictionary from (row, column), counted from one, to a text or None; merges are (first row, first column, last
row, last column). A sheet is worked on as a whole, so it must fit a task; the files that hold sheets do so as well.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass
from functools import cached_property

Cells = dict[tuple[int, int], str | None]
Merge = tuple[int, int, int, int]

BLANK = "&nbsp;"
_GENERIC = re.compile(r"(Unnamed:\s*[0-9]+|[0-9]+)\Z")
STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:6px;white-space:pre-wrap}"


@dataclass(frozen=True)
class Leg:
    """A cell's part in a merge. Where merges overlap the first one (by row and column) has the cell, as no one's master."""

    row: int
    col: int
    rowspan: int
    colspan: int
    master: bool


def without_blank_rows(cells: Cells, merges: list[Merge]) -> tuple[Cells, list[Merge]]:
    """Cells and merges without rows whose cells are all None, rows counted anew.

    A merge that reaches over a dropped row, or past the last row, goes.
    """
    new = {row: k for k, row in enumerate(sorted({r for (r, _), v in cells.items() if v is not None}), 1)}
    moved = {(new[r], c): v for (r, c), v in cells.items() if r in new}
    kept = [m for m in dict.fromkeys(merges) if all(r in new for r in range(m[0], m[2] + 1))]
    return moved, [(new[a], b, new[c], d) for a, b, c, d in kept]


@dataclass
class Sheet:
    """A sheet's rectangle of texts. Cells that aren't there are empty; merges widen the rectangle."""

    source: str
    name: str
    cells: Cells
    merges: list[Merge]

    @cached_property
    def height(self) -> int:
        return max(r for r, _ in self.cells)

    @cached_property
    def width(self) -> int:
        return max([c for _, c in self.cells] + [m[3] for m in self.merges])

    def value(self, row: int, col: int) -> str:
        """A cell as text: None and NaN are empty, and line ends become line feeds."""
        v = self.cells.get((row, col))
        if not v or v == "NaN":
            return ""
        return v.replace("\r\n", "\n").replace("\r", "\n") if "\r" in v else v

    @cached_property
    def legs(self) -> dict[tuple[int, int], Leg]:
        held: dict[tuple[int, int], list[Merge]] = {}
        for m in self.merges:
            for row in range(m[0], m[2] + 1):
                for col in range(m[1], m[3] + 1):
                    held.setdefault((row, col), []).append(m)
        out = {}
        for place, found in held.items():
            a, b, c, d = min(found)
            out[place] = Leg(a, b, c - a + 1, d - b + 1, place == (a, b) and len(found) == 1)
        return out

    def rows(self) -> range:
        return range(1, self.height + 1)

    def columns(self) -> range:
        return range(1, self.width + 1)


def escape_cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", "<br>")


def markdown(sheet: Sheet, enhanced: bool = False) -> str:
    """A comment, then a table whose first row is the header.

    Without ``enhanced`` a literal backslash-n counts as a line break; with it only a merge's first cell has its value.
    """

    legs, held = sheet.legs if enhanced and sheet.merges else {}, sheet.cells

    def cell(row: int, col: int) -> str:
        value = held.get((row, col))
        leg = legs.get((row, col)) if legs else None
        if not value or value == "NaN" or leg and not leg.master:
            return BLANK
        if value.isalnum():  # there is nothing to escape
            return value
        value = sheet.value(row, col)
        if not enhanced:
            return escape_cell(value.replace("\\n", "\n"))
        return escape_cell(value) if value.strip() else BLANK

    lines = ["| " + " | ".join([cell(r, c) for c in sheet.columns()]) + " |" for r in sheet.rows()]
    head = f"<!-- source: {sheet.source} | sheet: {sheet.name} | rows: {sheet.height - 1} | cols: {sheet.width} -->"
    return "\n".join([head, "", lines[0], "|" + " --- |" * sheet.width, *lines[1:]])


def html_table(sheet: Sheet) -> str:
    """Header and body with spans; cells below a merge's first one are left out."""

    def cell(row: int, col: int) -> str:
        leg = sheet.legs.get((row, col))
        if leg and not leg.master:
            return ""
        value = sheet.value(row, col)
        shown = html.escape(value) if value.strip() else BLANK
        place = f' data-row="{row}" data-col="{col}"'
        rows = f' rowspan="{leg.rowspan}" data-rowspan="{leg.rowspan}"' if leg and leg.rowspan > 1 else ""
        cols = f' colspan="{leg.colspan}" data-colspan="{leg.colspan}"' if leg and leg.colspan > 1 else ""
        if row > 1:
            return f"<td{place + rows + cols if leg else ''}>{shown}</td>"
        # A merged header that spans no further row has no scope, unlike all other headers.
        inside = f' scope="col"{place}{cols}{rows}' if rows else place + cols if leg else f' scope="col"{place}'
        return f"<th{inside}>{shown}</th>"

    lines = [f'<tr data-row="{r}">' + "".join(cell(r, c) for c in sheet.columns()) + "</tr>" for r in sheet.rows()]
    opening = f'<table border="1" class="excel-data" id="data-table" data-sheet="{html.escape(sheet.name)}" data-source="{html.escape(sheet.source)}">'
    return f"{opening}\n<thead>\n{lines[0]}\n</thead>\n<tbody>\n" + "\n".join(lines[1:]) + "\n</tbody>\n</table>"


def html_page(table: str, title: str) -> str:
    """A page around a table."""
    name = html.escape(title)
    return f'<!DOCTYPE html>\n<html lang="zh-CN" data-sheet-name="{name}">\n<head>\n<meta charset="UTF-8">\n<title>{name}</title>\n<style>{STYLE}</style>\n</head>\n<body>\n{table}\n</body>\n</html>'


def headers(sheet: Sheet) -> list[str]:
    """Each column's first value that isn't empty; plain numbers and ``Unnamed: n`` become ``col_n``."""
    found = [next((v for r in sheet.rows() if (v := sheet.value(r, c))), "") for c in sheet.columns()]
    return [f"col_{c}" if _GENERIC.match(h) else h for c, h in enumerate(found, 1)]


def records(sheet: Sheet) -> list[dict]:
    """Body cells with header, key and value; a merge's other cells take its first cell's value."""
    heads, out = headers(sheet), []
    for row in range(2, sheet.height + 1):
        for col, head in enumerate(heads, 1):
            leg = sheet.legs.get((row, col))
            skipped = leg is not None and not leg.master
            value = sheet.value(leg.row, leg.col) if skipped else sheet.value(row, col)
            spans = (leg.rowspan, leg.colspan) if leg and leg.master else (None, None)
            out.append({"row": row, "col": col, "header": head, "key": f"{head}_col{col}", "value": value, "merged": leg is not None, "skipped": skipped, "rowspan": spans[0], "colspan": spans[1]})
    return out


def as_json(sheet: Sheet) -> str:
    """Metadata, and a record per body row with its number, its cells in detail and its values by key.

    A sheet with nothing but a header has no data, and then no columns, headers or merges in its metadata either.
    """
    body = sheet.height > 1
    data: list[dict] = []
    for r in records(sheet):
        if not data or data[-1]["_row"] != r["row"]:
            data.append({"_row": r["row"], "_cells": {}})
        cell = {"value": r["value"], "col": r["col"], "header": r["header"]}
        cell |= {"merged": True, "skipped": True} if r["skipped"] else {"rowspan": r["rowspan"], "colspan": r["colspan"], "merged": True} if r["merged"] else {"merged": False}
        data[-1]["_cells"][str(r["col"])] = cell
        data[-1][r["key"]] = r["value"]
    spots = [{"row": row, "col": col, "rowspan": leg.rowspan, "colspan": leg.colspan} for (row, col), leg in sorted(sheet.legs.items()) if leg.master]
    meta = {"sheet": sheet.name, "total_rows": len(data), "total_columns": sheet.width if body else 0, "headers": headers(sheet) if body else [], "merged_cells": spots if body else []}
    return json.dumps({"metadata": meta, "data": data}, ensure_ascii=False, separators=(",", ":"))


def render(sheet: Sheet, output: str = "md", enhanced: bool = False) -> str:
    """The sheet as Markdown, as an HTML page or as JSON."""
    if output == "html":
        return html_page(html_table(sheet), sheet.name)
    return as_json(sheet) if output == "json" else markdown(sheet, enhanced)
