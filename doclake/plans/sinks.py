"""Results and chunks as JSON lines or files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions import names
from doclake.operators.naming import unique_names

RESULT_KEYS = ("source", "source_format", "engine", "status", "fallback_used", "success", "chunk_count", "metadata", "output_paths", "warnings", "errors", "elapsed")


def chunk_structs(chunks: DataFrame, with_row: bool = False) -> DataFrame:
    """Chunks in the form in which they leave: number, count, heading and part are metadata; what is null is left out."""
    have = [c for c in ("chunk_index", "chunk_count", "header", "part") if c in chunks.columns]
    row = ["row"] if with_row else []
    return chunks.select(*row, "source", "engine", "start_index", "end_index", F.struct(*have).alias("metadata"), F.col("chunk_text").alias("text"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(source, line): a JSON object per chunk."""
    made = chunk_structs(chunks)
    return made.select("source", F.to_json(F.struct(*made.columns)).alias("line"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of all chunks in as many files as there are partitions."""
    chunk_lines(chunks).select("line").write.mode("overwrite").text(path)


def result_lines(results: DataFrame, chunks: DataFrame | None = None, with_markdown: bool = True) -> DataFrame:
    """(source, line): a JSON object per result, with its chunks in order."""
    held = results
    keys = [*RESULT_KEYS, *["markdown"] * with_markdown]
    empty = F.array()
    if chunks is not None:
        made = chunk_structs(chunks, with_row=True)
        listed = made.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("metadata.chunk_index").alias("k"), F.struct("text", "metadata", "start_index", "end_index").alias("c")))).alias("chunks"))
        held = results.join(listed, "row", "left").withColumn("chunks", F.transform("chunks", lambda x: x["c"]))
        empty = F.coalesce("chunks", F.array().cast(held.schema["chunks"].dataType))
    line = F.to_json(F.struct(*keys, empty.alias("chunks")))
    return held.select("source", line.alias("line"))


def write_results(results: DataFrame, folder: str, ext: str = "md") -> DataFrame:
    """Writes a file per result that isn't an error, or one per sheet where it has several parts; returns results with ``output_paths``.

    Equal names get numbers. A file that can't be written leaves a warning and degrades its result; its text stays.
    ``folder`` must be one that all executors share. Writing happens when the returned rows are read, again if they are
    read twice.
    """
    stem = names.download_stem("source")
    of_sheets = F.transform("parts", lambda p, k: F.struct(k.alias("k"), p.alias("text"), F.concat(stem, F.lit("_"), names.clean_filename(F.get("sheets", k)["sheet"])).alias("stem")))
    whole = F.array(F.struct(F.lit(0).alias("k"), F.col("markdown").alias("text"), stem.alias("stem")))
    files = results.where("status <> 'error'").select("row", "source", F.explode(F.when(F.size("parts") > 1, of_sheets).otherwise(whole)).alias("f"))
    placed = files.select("row", "f.k", "f.text", F.struct("source", "row", "f.k").alias("place"), F.concat("f.stem", F.lit("." + ext)).alias("name"))
    named = unique_names(placed, "name", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            paths, problems = [], []
            for name, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                path, problem = f"{root}/{name}", None
                try:
                    system.create_dir(root, recursive=True)
                    with system.open_output_stream(path, compression=None) as out:
                        out.write((text or "").encode())
                except OSError as e:
                    path, problem = None, f"writing {name} failed: {e}"
                paths.append(path)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(paths, pa.string()), pa.array(problems, pa.string())], ["row", "k", "path", "problem"])

    written = named.select("row", "k", "unique_name", "text").mapInArrow(work, "row long, k int, path string, problem string")
    listed = lambda c: F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]))
    joined = results.join(written.groupBy("row").agg(listed("path").alias("paths"), listed("problem").alias("problems")), "row", "left")
    none = F.array().cast("array<string>")
    broken = F.size(F.coalesce("problems", none)) > 0
    return joined.withColumns(
        {
            "output_paths": F.coalesce("paths", none),
            "warnings": F.concat("warnings", F.coalesce("problems", none)),
            "status": F.when(broken & (F.col("status") == "ok"), "degraded").otherwise(F.col("status")),
        }
    ).drop("paths", "problems")
