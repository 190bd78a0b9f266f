"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_folders: list[str] = []  # of open workspaces, the innermost last
_meters: list[list[tuple[str, int, float]]] = []


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a session on this machine alone that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or the open workspace, that no other table has."""
    return f"{_folders[-1] if _folders else shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go when it ends; write what is to stay before."""
    folder = new_path(spark, "run")
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        remove(spark, folder)


@contextmanager
def metered() -> Iterator[list[tuple[str, int, float]]]:
    """(table, rows, seconds) of every table staged inside; rows are counted while they are written."""
    found: list[tuple[str, int, float]] = []
    _meters.append(found)
    try:
        yield found
    finally:
        _meters.remove(found)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet and read back, so later steps and retries start from here."""
    path, began, seen = new_path(df.sparkSession, name), time.time(), Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows")) if _meters else df).write.parquet(path)
    if _meters:
        row = name, int(seen.get.get("rows", 0)), time.time() - began
        for meter in _meters:
            meter.append(row)
    return df.sparkSession.read.schema(df.schema).parquet(path)
