"""The folder that the driver and all executors share for working tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="cadenza-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def working_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the working folder and read from there, for what several steps read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{working_folder(spark)}/cadenza-work/{label}-{uuid.uuid4().hex}"
