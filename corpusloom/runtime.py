"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers, once for each application.

    The driver serves the archive, so that no folder of the driver's machine needs to
    exist on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-code-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent).as_posix())
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_batches(
    frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: StructType | str
) -> DataFrame:
    """``frame.mapInArrow`` with this package at hand in the workers."""
    ship(frame.sparkSession)
    return frame.mapInArrow(run, shape)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one that ``spark.checkpoint.dir`` or the SparkContext names. Only a
    local session without any gets a temporary one; a cluster without one is an error,
    as a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def keep(frame: DataFrame) -> DataFrame:
    """``frame`` written once to a table in the shared folder, from which each step reads only the columns it needs."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
