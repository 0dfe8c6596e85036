"""Tables that a query reads several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where the session
    names none, a temporary folder on one machine only (as in tests); a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cadence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and
    gives a table that can be used several times.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadence-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, each: int, *key: Column | str) -> DataFrame:
    """``df``, of ``rows`` rows, dealt by ``key`` over as many partitions as hold ``each`` rows, where the
    session's number would make them larger: what a task sorts and groups then doesn't grow with the input."""
    n = -(-rows // each)
    return df.repartition(n, *key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
