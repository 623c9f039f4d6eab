"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The setting ``spark.checkpoint.dir``; in local mode it may be absent, and the machine's own folder does."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/parley-checkpoints"
    return root.rstrip("/")


def file_system(path: str):
    """(pyarrow file system, path within it) of a path as Spark writes it, with or without a scheme."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path
    host, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in a table of the shared folder."""
    path = f"{shared_root(df.sparkSession)}/parley-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
