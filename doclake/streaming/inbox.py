"""A folder that is watched: new files are converted in micro-batches, and results and chunks are appended.

Which files were seen is kept in the checkpoint; a micro-batch that is run again overwrites its own folder, so a failure
between writing and committing leaves no rows twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from doclake.config import Settings
from doclake.plans.convert import run


def inbox(spark: SparkSession, folder: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """(source, content) of files as they arrive in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    return read.load(folder).select(F.regexp_replace("path", r"\Afile:/*(?=/)", "").alias("source"), "content")


def convert_stream(files: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), describe: Callable[[str], str] | None = None) -> DataStreamWriter:
    """A writer, not yet started, that puts ``results`` and ``chunks`` as Parquet below ``out``, a folder per micro-batch."""

    def batch(files: DataFrame, number: int) -> None:
        results, chunks = run(files, settings, describe)
        results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
