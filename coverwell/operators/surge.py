"""Surge detection: the current bucket of negative coverage against its trailing baseline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.functions.text import half_up

WINDOW_DAYS, K, FLOOR = 21, 2.0, 4


def weighted(stories: DataFrame, coverage: DataFrame) -> DataFrame:
    """Negative stories with weight: their coverage rows, one at least."""
    rows = coverage.groupBy("item_id").agg(F.count("*").alias("n"))
    met = stories.where(F.col("sentiment") == "negative").join(rows, F.col("id") == F.col("item_id"), "left")
    return met.withColumn("weight", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).drop("n", "item_id")


def calendar_series(rows: DataFrame, days: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """(brand, idx, v): weight by brand and civil day on a full axis."""
    spine = days.select("idx", "day", F.explode(F.array(*map(F.lit, brands))).alias("brand"))
    sums = rows.groupBy("brand", "day").agg(F.sum("weight").alias("v"))
    return sums.join(F.broadcast(spine), ["brand", "day"], "right").select("brand", "idx", "day", F.coalesce("v", F.lit(0)).alias("v"))


def trailing(series: DataFrame, n: int = WINDOW_DAYS, k: float = K, floor: int = FLOOR) -> DataFrame:
    """Every bucket that has ``n`` before it, judged by their mean and population deviation.

    A brand's series has a row a day, so each window is small however many stories there are.
    It fires if it reaches the floor, exceeds the mean, and lies ``k`` deviations above it.
    """
    past = W.partitionBy("brand").orderBy("idx").rowsBetween(-n, -1)
    judged = series.withColumns({"mean": F.avg("v").over(past), "stddev": F.stddev_pop("v").over(past)}).where(F.col("idx") >= n)
    return _judge(judged, k, floor).select("brand", "day", "v", *_SHOWN)


_SHOWN = ["mean1", "stddev1", "threshold1", "multiple", "fires"]


def _judge(rows: DataFrame, k: float, floor: int) -> DataFrame:
    """Compares unrounded and rounds what is shown."""
    edge = F.col("mean") + k * F.col("stddev")
    return rows.withColumns(
        {
            "mean1": half_up(F.col("mean"), 1), "stddev1": half_up(F.col("stddev"), 1), "threshold1": half_up(edge, 1),
            "multiple": half_up(F.col("v") / F.greatest(F.col("mean"), F.lit(1.0)), 1),
            "fires": (F.col("v") >= floor) & (F.col("v") > F.col("mean")) & (F.col("v") >= edge),
        }
    )


def rolling(rows: DataFrame, now: datetime, brands: tuple[str, ...], n: int = WINDOW_DAYS, k: float = K, floor: int = FLOOR) -> DataFrame:
    """The last 24 hours against the ``n`` spans of 24 hours before, per brand; zeros count."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / F.lit(86_400_000_000)
    bucket = F.floor(age)
    by = rows.withColumn("bucket", bucket).where((F.col("bucket") >= 0) & (F.col("bucket") <= n)).groupBy("brand", "bucket").agg(F.sum("weight").alias("w"))
    past = F.col("bucket") > 0
    w = F.when(past, F.col("w"))
    sums = by.groupBy("brand").agg(
        F.coalesce(F.sum(F.when(~past, F.col("w"))), F.lit(0)).alias("v"), F.coalesce(F.sum(w), F.lit(0)).alias("s"), F.coalesce(F.sum(w * w), F.lit(0)).alias("s2")
    )
    wanted = sums.where(F.col("brand").isin(*brands))
    judged = wanted.withColumn("mean", F.col("s") / F.lit(n)).withColumn("stddev", F.sqrt(F.greatest(F.col("s2") / F.lit(n) - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return _judge(judged, k, floor).select("brand", "v", *_SHOWN)


def top_stories(rows: DataFrame, day, most: int = 3) -> DataFrame:
    """The day's weightiest stories of each brand; ties keep the lower id."""
    order = W.partitionBy("brand").orderBy(F.desc("weight"), "id")
    return rows.where(F.col("day") == F.lit(day)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("brand", "rank", "id", "weight")
