"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    The executors of a cluster do not share local folders, so without the
    setting a local warehouse is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
        own = spark.conf.get("spark.master", "").split("[")[0] == "local"
        if not own and (folder.startswith("file:") or ":/" not in folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: stages are written there")
    return f"{folder.rstrip('/')}/cambium-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once and read back.

    What follows may read it as often as it likes, and nothing upstream is
    needed again after a lost executor.  The folder stays until the shared
    folder is cleared.
    """
    spark = df.sparkSession
    path = stage_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
