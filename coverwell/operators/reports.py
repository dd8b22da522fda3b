"""Period reports: this period against the one before, movements, spotlights and the coverage log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.functions.text import half_up

MOST_DAYS = 92


def parse_range(first: str, last: str) -> tuple[date, date]:
    """An inclusive range of civil days; a bad, reversed or too long one is refused, never clamped."""
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    if b < a:
        raise ValueError("the range ends before it starts")
    if (b - a).days + 1 > MOST_DAYS:
        raise ValueError(f"the range has more than {MOST_DAYS} days")
    return a, b


def clamped(days: int | str | None, default: int = 30, most: int = 90) -> int:
    """A number of days from a link: 1 to ``most``, ``default`` where there is none. Only such numbers are clamped, ranges are refused."""
    try:
        n = int(float(days)) if days else default
    except (ValueError, OverflowError):
        n = default
    return max(1, min(n or default, most))


def periods(stories: DataFrame, first: date, last: date) -> DataFrame:
    """The rows of the range and of the equally long one before it, with ``now``: whether a row is of the range."""
    before = first - timedelta(days=(last - first).days + 1)
    return stories.where((F.col("day") >= F.lit(before)) & (F.col("day") <= F.lit(last))).withColumn("now", F.col("day") >= F.lit(first))


def period_compare(rows: DataFrame) -> DataFrame:
    """Per brand: mentions and negatives now and before, and the brand's share of all mentions in whole per cent."""
    now, neg = F.col("now"), F.col("sentiment") == "negative"
    by = rows.groupBy("brand").agg(
        F.count_if("now").alias("now"), F.count_if(~now).alias("before"), F.count_if(now & neg).alias("negative_now"), F.count_if(~now & neg).alias("negative_before"),
    )
    share = lambda c, n: half_up(100.0 * F.col(c) / F.greatest(F.col(n), F.lit(1))).cast("long")
    every = W.partitionBy(F.lit(1))  # a row a brand
    by = by.withColumns({"all_now": F.sum("now").over(every), "all_before": F.sum("before").over(every)})
    return by.select(
        "brand", "now", "before", "negative_now", "negative_before", share("now", "all_now").alias("share_now"), share("before", "all_before").alias("share_before")
    )


def category_movement(rows: DataFrame) -> DataFrame:
    by = rows.where(F.col("category") != "unclassified").groupBy("category")
    return by.agg(F.count_if("now").alias("now"), F.count_if(~F.col("now")).alias("before")).withColumn("change", F.col("now") - F.col("before"))


def spotlights(rows: DataFrame, home: str, negatives: int = 6, positives: int = 4) -> DataFrame:
    """The home brand's weightiest negative and positive stories of the range; ties keep the lower id."""
    mine = rows.where(F.col("now") & (F.col("brand") == home))

    def top(sentiment: str, most: int) -> DataFrame:
        return mine.where(F.col("sentiment") == sentiment).orderBy(F.desc("importance"), "id").limit(most)

    return top("negative", negatives).unionByName(top("positive", positives)).select("id", "sentiment", "importance", "category", "source")


def coverage_log(rows: DataFrame, most: int = 400) -> DataFrame:
    """The newest stories of the range, grouped by brand, newest first in a group."""
    newest = rows.where("now").orderBy(F.desc("at"), "id").limit(most)
    return newest.select("brand", "id", "at", "source", "sentiment", "importance")


def sources(rows: DataFrame) -> DataFrame:
    """Mentions and distinct sources of the range and of the one before; a story without a source has none."""
    named = F.nullif(F.trim("source"), F.lit(""))
    return rows.agg(
        F.count_if("now").alias("now"), F.count_if(~F.col("now")).alias("before"),
        F.count_distinct(F.when(F.col("now"), named)).alias("sources_now"), F.count_distinct(F.when(~F.col("now"), named)).alias("sources_before"),
    )


def appendix(rows: DataFrame, order: tuple[str, ...], rest: str, most: int = 400) -> DataFrame:
    """The newest ``most`` stories of the range with ``grp`` and ``place``: groups in ``order``, others as ``rest`` last, newest first within;
    ``truncated`` says how many older ones are left out, of whatever group."""
    now = rows.where("now")
    newest = now.orderBy(F.desc("at"), "id").limit(most)  # so many at most from here on
    group = F.when(F.col("brand").isin(*order), F.col("brand")).otherwise(rest)
    rank = F.coalesce(*[F.when(F.col("brand") == b, F.lit(i)) for i, b in enumerate(order)], F.lit(len(order)))
    places = W.partitionBy(F.lit(1)).orderBy(rank, F.desc("at"), "id")
    left = now.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("truncated"))
    placed = newest.select("id", group.alias("grp"), "at", "source", "sentiment", "importance", F.row_number().over(places).cast("long").alias("place"))
    return placed.crossJoin(F.broadcast(left))
