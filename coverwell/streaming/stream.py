"""The streaming twins: stories are merged into a keyed table batch by batch, and counted by civil day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverwell.sources.staging import shared_root
from coverwell.sources.tables import ZONE
from coverwell.streaming.keyed import KeyedTable


def shared_dir(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/event[s].parquet")


def daily_counts(stream: DataFrame, where: str) -> DataFrame:
    """Events by civil day and type, through all data that there is; the watermark, on the zone's clock, bounds the state.

    Windows of a day begin at midnight UTC, so the zone's clock is read as if it were UTC, whatever the session's own zone is.
    """
    day = F.window(F.col("at"), "1 day")
    clock = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("ts").cast("timestamp_ntz"))
    counted = (
        stream.withColumn("at", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), clock)))
        .withWatermark("at", "48 hours")
        .groupBy(day.alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.date_from_unix_date((F.unix_micros("w.start") / 86_400_000_000).cast("int")).alias("day"), "event_type", "n", F.lit(batch_id).alias("batch")).write.mode("append").parquet(f"{where}/out")

    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{where}/out")
    last = rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))  # later batches replace earlier counts
    return last


def merge_by_key(stream: DataFrame, key: str, order: str, where: str, buckets: int = 64) -> DataFrame:
    """One row a key over all batches: the first in ``order``, and how many rows it stands for. Duplicates merge, none is dropped unseen.

    A batch rewrites only the buckets of its keys, and a batch that is repeated changes nothing.
    """
    spark, rest = stream.sparkSession, [c for c in stream.columns if c != key]
    kinds = dict(stream.dtypes)
    kept = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in rest) + ">"
    table = KeyedTable(spark, f"{where}/state", [key], f"`{key}` {kinds[key]}, r {kept}, first {kinds[order]}, n long", buckets)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(key).agg(F.min_by("r", "first").alias("r"), F.min("first").alias("first"), F.sum("n").alias("n"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"), F.min(order).alias("first"), F.count("*").alias("n")).persist()
        table.merge(new, batch_id, add)
        new.unpersist()

    stream.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return table.read().select(key, "r.*", "n")
