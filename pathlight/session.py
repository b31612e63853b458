"""SparkSession factory with the settings every query of the engine assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "pathlight", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with SETTINGS; ``extra`` overrides them (keys with ``__`` for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, as no folder of
    one machine would do.
    """
    context = spark.sparkContext
    if (folder := context.getCheckpointDir()) is not None:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that grows with the input: sorted and merged, never broadcast.

    Spark judges tables and shuffles by their compressed size. That of a million short rows is below the limit of
    broadcasts, while their hash table takes a tenth of a GB or more of the driver's memory.
    """
    return df.hint("merge")


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, for sets that several joins read: made once, and ``merged`` there."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return merged(df.sparkSession.read.schema(df.schema).parquet(path))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
