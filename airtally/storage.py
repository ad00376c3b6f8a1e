"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where the executors are threads of the driver,
    a session without the setting gets a new temporary folder; any other session an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _OWN[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder no other run uses; it does not exist yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def use_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
