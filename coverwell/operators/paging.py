"""Pages of an ordered table by key, without offsets: a page index, single pages, and the whole table with its page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(rows: DataFrame, order: list[Column], stage) -> DataFrame:
    """``rows`` with ``place`` from 0 in ``order``, which must tell all rows apart.

    One range-partitioned sort; a row's place is its place in its partition plus the sizes of those before it. ``stage`` writes
    the sorted rows, so that both passes see the same partitions.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = stage(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    before = sorted_.groupBy("_part").count()  # a row for each partition
    before = before.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(before), "_part").withColumn("place", place).drop("_at", "_part", "_before")


def paged(rows: DataFrame, order: list[Column], size: int, stage) -> DataFrame:
    """All rows with their ``page`` from 1 and ``place`` from 0: the whole export in one pass."""
    return placed(rows, order, stage).withColumn("page", (F.floor(F.col("place") / size) + 1).cast("long"))


def page_index(pages: DataFrame, key: list[str]) -> DataFrame:
    """(page, n, first, last): the first and the last key of every page of ``paged`` rows, by which a page is read alone."""
    k = F.struct(*key)
    return pages.groupBy("page").agg(F.count("*").alias("n"), F.min_by(k, "place").alias("first"), F.max_by(k, "place").alias("last"))


def page_of(rows: DataFrame, key: str, first, last) -> DataFrame:
    """One page of a table ordered by a single ``key``, read by its ends from the index: the filter reaches the scan."""
    return rows.where((F.col(key) >= F.lit(first)) & (F.col(key) <= F.lit(last)))


def counter(pages: DataFrame, size: int) -> DataFrame:
    """(page, pages, label): what the pager shows on each page, such as ``16–30 of 38``."""
    by_page = pages.groupBy("page").agg(F.count("*").alias("n"))
    total = by_page.agg(F.sum("n").alias("total"), F.max("page").alias("pages"))
    start = (F.col("page") - 1) * size
    label = F.concat((start + 1).cast("string"), F.lit("–"), (start + F.col("n")).cast("string"), F.lit(" of "), F.col("total").cast("string"))
    return by_page.crossJoin(F.broadcast(total)).select("page", "pages", label.alias("label"))
