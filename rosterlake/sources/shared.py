"""Folders that driver and executors share, for tables that a job keeps while it runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, in a temporary one if Spark runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str) -> DataFrame:
    """rows, written once to a shared folder: worked out once however often they are read, and safe from lost executors."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
