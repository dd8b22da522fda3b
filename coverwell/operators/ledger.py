"""Keyed tables: inserts that ignore what is there, upserts, deletes, and what the pipeline reports about itself."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.operators.dedupe import first_wins


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``target`` and the rows of ``new`` whose key it lacks; of equal keys in ``new`` the first in ``order``."""
    fresh = new.join(target.select(*key), key, "left_anti")
    return target.unionByName(first_wins(fresh, F.struct(*key), order))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``target`` after ``changes``: given columns replace old values unless null, new keys are added."""
    given = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in given])
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in target.columns if c != key]
    return target.join(new, key, "full").select(key, *kept)


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows that no verdict calls the same story; a missing verdict keeps its row."""
    return rows.join(verdicts.where("same").select("id").distinct(), "id", "left_anti")


def collapse_outlets(coverage: DataFrame) -> DataFrame:
    """One row per story and outlet in any case: the first publisher link before any wrapper link, and any author."""
    key = F.lower(F.trim("outlet"))
    best = F.min_by(F.struct("outlet", "url"), F.struct(F.col("wrapped").cast("int"), "pos"))
    return (
        coverage.groupBy("item_id", key.alias("key"))
        .agg(best.alias("r"), F.min_by("author", F.when(F.col("author").isNotNull(), F.col("pos"))).alias("author"))
        .select("item_id", "key", "r.outlet", "r.url", "author")
    )


def funnel(stories: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(lost_at, n): the first stage that each story is missing from, ``delivered`` if none."""
    rows, lost = stories.select("id"), F.lit(None).cast("string")
    for name, kept in stages:
        rows = rows.join(kept.select("id").distinct().withColumn(f"in_{name}", F.lit(True)), "id", "left")
        lost = F.coalesce(lost, F.when(F.col(f"in_{name}").isNull(), name))
    return rows.groupBy(F.coalesce(lost, F.lit("delivered")).alias("lost_at")).agg(F.count("*").alias("n"))


def delivery(log: DataFrame, bad: tuple[str, ...]) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*bad)).alias("bad"))


def recent_delivery(log: DataFrame, bad: tuple[str, ...], sender: str | None, now: datetime, hours: int = 26) -> DataFrame:
    """(status, n, bad): sends by status of the last ``hours`` and the undated ones; with a ``sender`` only its own, whatever its display name.

    Addresses stand alone or as ``Name <address>``, in any case. Rows without a status count nowhere.
    """
    address = F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract("sender", "<([^>]+)>", 1), F.lit("")), F.col("sender"))))
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    rows = log.where(F.col("created_at").isNull() | (F.col("created_at") >= since))
    rows = rows if sender is None else rows.where(address == sender.strip().lower())
    status = F.lower(F.coalesce("status", F.lit("")))
    by = rows.where(status != "").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return by.withColumn("bad", F.col("status").isin(*bad))


def throttled(alerts: DataFrame, hours: int) -> DataFrame:
    """Alerts that go out: none of the same title went out within ``hours`` before. Alerts of a title are taken in order of time and id.

    A suppressed alert holds back none. The last time sent of one title at a time is the state of
    a pass over sorted rows. Null titles are one title; alerts without a time go out.
    """
    gap = hours * 3_600_000_000
    title = F.when(F.col("title").isNull(), "0").otherwise(F.concat(F.lit("1"), "title"))
    keyed = alerts.withColumns({"_title": title, "_at": F.unix_micros(F.col("at").cast("timestamp"))})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for rows in batches:
            keep = []
            for title, at in zip(rows.column("_title").to_pylist(), rows.column("_at").to_pylist(), strict=True):
                if title != current:
                    current, last = title, None
                keep.append(at is None or last is None or at - last >= gap)
                if keep[-1] and at is not None:
                    last = at
            yield rows.filter(pa.array(keep, pa.bool_())).select(alerts_columns)

    alerts_columns = alerts.columns
    rows = keyed.repartition("_title").sortWithinPartitions("_title", "_at", "id")
    return rows.mapInArrow(sent, alerts.schema)


def schema_drift(code: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, state): migrations applied, missing from the ledger, or unknown to the code."""
    left, right = code.select("id", F.lit(True).alias("c")), ledger.select("id", F.lit(True).alias("l"))
    state = F.when(F.col("c").isNull(), "extra").when(F.col("l").isNull(), "missing").otherwise("applied")
    return left.join(right, "id", "full").select("id", state.alias("state"))
