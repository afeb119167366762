"""Line rules that leave code alone: page markers, blank runs, spaces and repeated lines.

All rules are local to a text, so each text is cleaned in one pass over its lines, in Arrow batches: nothing is shuffled and
no key is needed. A run is decided by its first line: what follows in a run of equal candidates goes, unless both are code.
Blank and repeated lines are judged after the rules before have removed theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from doclake.arrow import SLICE, numbered, plain, text_slices

_FENCE = re.compile(r"\s*(?:`{3}|~{3})")
_INDENTED = re.compile(r"[ \t]{4}")
_ESCAPED = re.compile(r"\\([\\\[\]\-.()])")
_PAGE_MARKER = re.compile(
    "|".join(
        (
            r"\[\d+\]\Z",
            r"第\s*\d+\s*页\Z",
            r"-\s*\d+\s*-\Z",
            r"(?i:page)\s*\d+\s*(?:(?i:of)|/)\s*\d+\Z",
            r"(?i:Page|Pág\.|P\.)\s*\d+\Z",
        )
    )
)
_GAP = re.compile(r"[ \t]+")

#: A line and whether it is code.
Line = tuple[str, bool]


@dataclass(frozen=True)
class Rules:
    """Which rules run; without any, texts stay unchanged."""

    page_numbers: bool = True
    empty_lines: bool = True
    spaces: bool = True
    duplicates: bool = True

    def any(self) -> bool:
        return self.page_numbers or self.empty_lines or self.spaces or self.duplicates


def lines_of(text: str) -> Iterator[Line]:
    """The text's lines; fences, what they enclose, and lines indented by four are code."""
    inside = False
    for line in text.split("\n"):
        fence = _FENCE.match(line) is not None
        inside ^= fence
        yield line, fence or inside or _INDENTED.match(line) is not None


def without_page_markers(lines: Iterator[Line]) -> Iterator[Line]:
    for line, code in lines:
        if code or not _PAGE_MARKER.match(_ESCAPED.sub(r"\1", line.strip())):
            yield line, code


def without_blank_runs(lines: Iterator[Line]) -> Iterator[Line]:
    """Of blank lines in a row the first, and those of code after one of code; they come out empty."""
    lead: bool | None = None
    for line, code in lines:
        if line.strip():
            lead = None
            yield line, code
        elif lead is None or code and lead:
            lead = code if lead is None else lead
            yield "", code


def with_single_spaces(lines: Iterator[Line]) -> Iterator[Line]:
    for line, code in lines:
        line = line.replace("　", " ")
        if line.strip():
            bare = line.lstrip(" \t")
            line = line.rstrip() if code else line[: len(line) - len(bare)] + _GAP.sub(" ", bare.rstrip(" \t"))
        yield line, code


def without_repeats(lines: Iterator[Line]) -> Iterator[Line]:
    """Of equal lines in a row the first, and those of code after one of code; blank lines may repeat."""
    before, lead = None, False
    for line, code in lines:
        if line == before and line.strip():
            if code and lead:
                yield line, code
        else:
            before, lead = line, code
            yield line, code


def cleaned(text: str, rules: Rules = Rules()) -> str:
    lines = lines_of(text)
    if rules.page_numbers:
        lines = without_page_markers(lines)
    if rules.empty_lines:
        lines = without_blank_runs(lines)
    if rules.spaces:
        lines = with_single_spaces(lines)
    if rules.duplicates:
        lines = without_repeats(lines)
    return "\n".join([line for line, _ in lines])


def clean(df: DataFrame, text_col: str = "text", rules: Rules = Rules(), repeats_may_stay: Column | None = None) -> DataFrame:
    """``df`` with the active rules applied to ``text_col`` in turn; null texts become empty, all else stays as it is.

    Where ``repeats_may_stay`` holds, the rule for repeated lines is left out. Rows needn't differ in anything; a text all
    of whose lines go is empty; an empty table stays empty. No shuffle.
    """
    if not rules.any():
        return df.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    fewer = Rules(rules.page_numbers, rules.empty_lines, rules.spaces, False)
    stay = F.lit(False) if repeats_may_stay is None else F.coalesce(repeats_may_stay, F.lit(False))

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in text_slices(pa.RecordBatch.from_arrays(list(batch), ["text", "stay"]), 0):
                yield pa.array([cleaned(t or "", fewer if s else rules) for t, s in zip(plain(part.column(0)), part.column(1).to_pylist())], pa.string())

    # As a function of two columns: no other column leaves the JVM, and those that nobody asks for aren't read.
    made = F.arrow_udf(work, StringType(), ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`").cast("string"), stay)
    return df.select(*[made.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def to_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per line of every text: the other columns, ``pos`` from 0, ``line`` and ``is_code``; a null text has one empty line.

    Columns of these names are replaced.
    """
    keep = [c for c in df.columns if c not in (text_col, "pos", "line", "is_code")]
    at = len(keep)
    out = StructType([*(StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(keep)), StructField("pos", LongType()), StructField("line", StringType()), StructField("is_code", BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            picked = pa.array(places, pa.int32())
            return pa.RecordBatch.from_arrays([*(c.take(picked) for c in part.columns[:at]), *map(pa.array, zip(*rows), (pa.int64(), pa.string(), pa.bool_()))], out.names)

        for batch in batches:
            for part in text_slices(batch, at):
                places, rows, held = [], [], 0
                for k, text in enumerate(part.column(at).to_pylist()):
                    for pos, (line, code) in enumerate(lines_of(text or "")):
                        places.append(k)
                        rows.append((pos, line, code))
                        held += len(line) + 16
                        if held > SLICE:
                            yield flushed()
                            places, rows, held = [], [], 0
                if rows:
                    yield flushed()

    made = numbered(df, keep, F.col(f"`{text_col}`").cast("string")).mapInArrow(work, out)
    return made.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "pos", "line", "is_code")
