"""The session, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.sources import files


def session(name: str = "lakeline", **conf) -> SparkSession:
    """A session with UTC times and adaptive execution; a running one is kept."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def application_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Where that is unset, a local master (tests) gets a temporary
    folder; a cluster, whose executors would each write to a disk of their own, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lakeline-')}"
        spark.sparkContext.setCheckpointDir(base)
    return files.qualified(spark, f"{base.rstrip('/')}/lakeline-{spark.sparkContext.applicationId}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{application_dir(spark)}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application stored on its way. Results that read them must have been written before."""
    files.remove(spark, application_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether df has at most so many rows, which are counted."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which are counted; a larger one is left to Spark."""
    return F.broadcast(df) if few(df, rows) else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers. They find it without that under a local master, by the working
    folder or PYTHONPATH; executors of a cluster only by a PYTHONPATH that they share with the driver."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    seen = [*filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))] + ([os.getcwd()] if context.master.startswith("local") else [])
    if root in map(os.path.abspath, seen) or getattr(context, "_lakeline_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lakeline-"), "lakeline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "lakeline")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._lakeline_shipped = True
