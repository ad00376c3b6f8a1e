"""Shared storage for intermediate tables and binary files.

Intermediate results that several jobs read are written as Parquet to the folder that
``spark.checkpoint.dir`` names. That cuts the lineage, and a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; it does not exist yet.

    Where the setting is missing, a session whose executors are threads of the driver gets a
    temporary folder, and any other session an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = LOCAL_FOLDERS.setdefault(app, "")
        if not root:
            root = LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write the frame to shared storage once and return a frame that reads it."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder, compression=codec)
    return spark.read.schema(df.schema).parquet(folder)


def materialize_buckets(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The same, hashed by some columns into as many buckets as a shuffle has partitions, so that
    joins on these columns shuffle the other side alone."""
    spark = df.sparkSession
    table, n = f"llm_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *columns).sortBy(*columns).option("path", shared_folder(spark, name)).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the frame knows its files, and they stay
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, when nothing will read it again."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain absolute path."""
    return pafs.FileSystem.from_uri(uri)
