"""Chunks of texts: fixed windows, packed sentences, or sections below headings. Offsets count code points.

Fixed windows are cut by one regular expression into blocks of a step each, and every chunk is put together from its blocks.
Sentences and sections are found in one pass over each text, in Arrow batches. Both take time in proportion to a text's
length. All three keep the other columns and repeat them for every chunk; columns with the names of those that chunks have
are replaced, and rows that are equal are chunked alike. Null and empty texts have no chunks; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from doclake.arrow import SLICE, numbered, text_slices

_END = re.compile(r"[.!?。！？]\s+")
#: A heading line; white space after it, line feeds included, belongs to it.
_HEADING = re.compile(r"(?m)^(#{1,6})\s+(.*?)\s*$")

NUMBERS = ("chunk_index", "chunk_count", "start_index", "end_index")
#: (start, end, further values) of every chunk, and the text that the offsets refer to.
Cutter = Callable[[str], tuple[str, list[tuple]]]


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the chunk size")


def _kept(df: DataFrame, text_col: str, extra: list[str]) -> list[str]:
    return [c for c in df.columns if c not in (text_col, "chunk_text", *NUMBERS, *extra)]


def fixed_chunks(df: DataFrame, size: int = 512, overlap: int = 64, text_col: str = "text") -> DataFrame:
    """A row per window of ``size`` characters; neighbours share ``overlap``; other columns are kept but ``text_col``.

    Empty and null texts have no chunks; white space counts as text.
    """
    check_window(size, overlap)
    step = size - overlap
    keep = _kept(df, text_col, [])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.char_length(text).alias("n"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks"))
    counted = blocks.withColumn("chunk_count", F.expr(f"cast(if(n <= {size}, 1, 1 + ceil((n - {size}) / {step})) as bigint)")).where("n > 0")
    own = f"substring(array_join(slice(blocks, i + 1, {-(-size // step)}), ''), 1, {size})"
    rows = counted.select("*", F.posexplode(F.expr(f"transform(sequence(0, cast(chunk_count as int) - 1), i -> {own})")).alias("i", "chunk_text"))
    start = F.col("i").cast("long") * step
    return rows.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)],
        F.col("i").cast("long").alias("chunk_index"),
        "chunk_count",
        start.alias("start_index"),
        F.least(start + size, F.col("n").cast("long")).alias("end_index"),
        "chunk_text",
    )


def _cut(df: DataFrame, text_col: str, cutter: Cutter, extra: list[StructField]) -> DataFrame:
    """Chunk rows by a cutter, written out in batches of bounded size."""
    keep = _kept(df, text_col, [f.name for f in extra])
    at = len(keep)
    numbers = [StructField(c, LongType()) for c in NUMBERS]
    out = StructType([*(StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(keep)), *numbers, *extra, StructField("chunk_text", StringType())])
    kinds = [pa.int64()] * 4 + [pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in extra] + [pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            picked = pa.array(places, pa.int32())
            return pa.RecordBatch.from_arrays([*(c.take(picked) for c in part.columns[:at]), *map(pa.array, zip(*rows), kinds)], out.names)

        for batch in batches:
            for part in text_slices(batch, at):
                places, rows, held = [], [], 0
                for k, text in enumerate(part.column(at).to_pylist()):
                    if not text:
                        continue
                    base, found = cutter(text)
                    for i, (start, end, *more) in enumerate(found):
                        places.append(k)
                        rows.append((i, len(found), start, end, *more, base[start:end]))
                        held += end - start
                        if held > SLICE:
                            yield flushed()
                            places, rows, held = [], [], 0
                if rows:
                    yield flushed()

    made = numbered(df, keep, F.col(f"`{text_col}`").cast("string")).mapInArrow(work, out)
    return made.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *out.names[at:])


def sentence_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of runs of whole sentences of about ``size`` characters in a text without outer white space."""
    found: list[tuple[int, int]] = []
    start, last, held, at = -1, 0, 0, 0

    def take(end: int, after: int) -> None:
        nonlocal start, last, held, at
        own = end - at
        if start < 0:
            start, held = at, own
        elif held + own + 1 > size:
            found.append((start, last))
            start, held = (max(start, last - overlap), last - max(start, last - overlap) + own + 1) if overlap else (at, own + 1)
        else:
            held += own + 1
        last, at = end, after

    for m in _END.finditer(text):
        if m.start() > at:  # a sentence has something before its mark
            take(m.start() + 1, m.end())
    if at < len(text):
        take(len(text), len(text))
    if start >= 0:
        found.append((start, last))
    return found


def sentence_chunks(df: DataFrame, size: int = 512, overlap: int = 64, text_col: str = "text") -> DataFrame:
    """A row per run of whole sentences of about ``size`` characters; offsets refer to the text without outer white space.

    A sentence that doesn't fit is never cut. With an overlap, a chunk starts that many characters before the end of the
    one before. Null and blank texts have no chunks.
    """
    return _cut(df, text_col, sentence_cutter(size, overlap), [])


def sentence_cutter(size: int, overlap: int) -> Cutter:
    check_window(size, overlap)

    def cutter(text: str) -> tuple[str, list[tuple]]:
        bare = text.strip()
        return bare, sentence_spans(bare, size, overlap)

    return cutter


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, header) of what comes before the first heading, unless it is blank, and of every heading with its body.

    A blank body doesn't belong to its section.
    """
    heads = list(_HEADING.finditer(text))
    first = heads[0].start() if heads else len(text)
    found = [(0, first, "")] if text[:first].strip() else []
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        found.append((m.start(), after if text[m.end() : after].strip() else m.end(), m[2]))
    return found


def heading_chunks(df: DataFrame, max_size: int = 0, text_col: str = "text") -> DataFrame:
    """A row per heading with what follows it; ``header`` is the heading's text, empty before the first heading.

    With ``max_size`` longer sections are cut into slices of that size and numbered in ``part``, which is null otherwise.
    Null and blank texts have no chunks.
    """
    return _cut(df, text_col, heading_cutter(max_size), [StructField("header", StringType()), StructField("part", LongType())])


def heading_cutter(max_size: int = 0) -> Cutter:
    if max_size < 0:
        raise ValueError("the largest size must not be negative")

    def cutter(text: str) -> tuple[str, list[tuple]]:
        found: list[tuple] = []
        for start, end, header in sections(text):
            if not max_size or end - start <= max_size:
                found.append((start, end, header, None))
            else:
                found += [(at, min(at + max_size, end), header, k) for k, at in enumerate(range(start, end, max_size))]
        return text, found

    return cutter


STRATEGIES = {"fixed": fixed_chunks, "fixed_size": fixed_chunks, "sentence": sentence_chunks, "markdown": heading_chunks, "md": heading_chunks}


def chunk(df: DataFrame, strategy: str = "fixed", size: int = 512, overlap: int = 64, max_size: int = 0, text_col: str = "text") -> DataFrame:
    """Chunks by a named strategy, whatever its case; ValueError for an unknown one."""
    found = STRATEGIES.get(strategy.lower())
    if found is None:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    return found(df, max_size, text_col) if found is heading_chunks else found(df, size, overlap, text_col)


def count_chunks(df: DataFrame, strategy: str = "fixed", size: int = 512, overlap: int = 64, max_size: int = 0, text_col: str = "text") -> DataFrame:
    """``df`` with ``chunk_count``, how many chunks ``chunk`` would make of each row; 0 for null texts. No shuffle."""
    names = [c for c in df.columns if c != "chunk_count"]
    how = STRATEGIES.get(strategy.lower())
    if how is fixed_chunks:
        check_window(size, overlap)
        n = F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
        rest = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0))
        return df.withColumn("chunk_count", F.when(n == 0, 0).otherwise(1 + rest).cast("long"))
    cutter = heading_cutter(max_size) if how is heading_chunks else sentence_cutter(size, overlap)
    out = StructType([*(StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(names)), StructField("chunk_count", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(cutter(t.as_py() or "")[1]) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], out.names)

    made = numbered(df, names, F.col(f"`{text_col}`").cast("string")).mapInArrow(work, out)
    return made.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "chunk_count")
