"""Session settings the results depend on, and the shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_settings(spark: SparkSession) -> None:
    """Dates are UTC calendar dates; everything else is left as the cluster configured it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the session names; a local folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """`df` written to the shared folder in one directory per value of `column`, so that a filter on it reads only those."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid4().hex}"
    df.write.partitionBy(column).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written once to the shared folder and read back, so that joins know its true size; and that folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder
