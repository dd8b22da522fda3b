"""Tables written between rounds, so that plans stay short and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; a temporary one only where all runs on one machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="coverwell-")


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the folder that all machines share, and reads it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/coverwell/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
