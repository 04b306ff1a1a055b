"""The folder shared by the driver and all executors, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder if all of Spark runs in this one process, and an error on a cluster, whose machines don't
    share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ringside-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, and read from there if executors are lost.

    A Parquet table takes a fraction of checkpointed rows, and what comes after reads only its own columns.
    """
    return stored(df, "cut")


def exists(spark: SparkSession, path: str) -> bool:
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, under a name that tells what it is.  options: of the writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
