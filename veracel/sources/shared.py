"""The folder that driver and executors share, and tables in it."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a folder of its own where that is unset. On a cluster it must be set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")

        given = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back: fixed from then on, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
