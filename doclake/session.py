"""Session helpers: a session with the engine's defaults, and workers that can import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_see_package(spark: SparkSession) -> SparkSession:
    """Puts the folder of this package on the Python path of workers that share the driver's disk (local runs).

    On a cluster ship the package with ``--py-files``; the extra entry is harmless there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def session(app: str = "doclake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return workers_see_package(builder.getOrCreate())


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local, one of our own; on a cluster that raises ValueError, as each executor would
    write to a disk of its own and the data would be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="doclake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows neither parses again nor depends on executors that are gone."""
    path = f"{shared_folder(df.sparkSession)}/doclake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._doclake_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more; any other DataFrame is left alone."""
    path = getattr(df, "_doclake_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
