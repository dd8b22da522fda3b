"""Contracts between the stages: a provider's batches, patches of single fields, log coverage and overlapping runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(rows: DataFrame, answer: Callable[[list[dict], int], list[dict]], verdict: str, batch: int = 25, reasks: int = 2) -> DataFrame:
    """``rows`` with the fields of ``verdict`` (DDL) as the provider gives them, and ``resolved``: whether it gave any.

    ``answer(items, ask)`` gets at most ``batch`` rows as dicts and how often they were asked for again; it returns verdicts with
    ``i``, the item's place in the batch, in any order, or raises. A batch that raises is halved down to single items, so one bad
    item costs itself only. What is left out is no verdict: it is asked for again, at most ``reasks`` times, and halved where
    nothing came back at all. What is still open stays unresolved, never guessed. Batches are formed as rows stream
    through a task; a task that is lost asks again. Verdicts with a place outside the batch are ignored, the last of several wins.
    """

    def halves(chunk: list[dict], ask: int) -> list[dict | None]:
        mid = -(-len(chunk) // 2)
        return ask_for(chunk[:mid], ask) + ask_for(chunk[mid:], ask)

    def ask_for(chunk: list[dict], ask: int) -> list[dict | None]:
        try:
            given = {v["i"]: v for v in answer(chunk, ask) or [] if isinstance(v, dict) and type(v.get("i")) is int}
        except Exception:
            return halves(chunk, ask) if len(chunk) > 1 else [None]
        out = [given.get(i) for i in range(len(chunk))]
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing or ask >= reasks:
            return out
        if len(missing) == len(chunk) > 1:
            return halves(chunk, ask + 1)
        for i, v in zip(missing, ask_for([chunk[i] for i in missing], ask + 1)):
            out[i] = v
        return out

    fields = [f.split()[0] for f in verdict.split(",")]
    given = rows.columns

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            left = frame if left is None else pd.concat([left, frame], ignore_index=True)
            full = len(left) // batch * batch
            yield from chunks(left.iloc[:full])
            left = left.iloc[full:].reset_index(drop=True)
        if left is not None:
            yield from chunks(left)

    def chunks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(frame), batch):
            some = frame.iloc[at : at + batch].reset_index(drop=True)
            found = ask_for(some.to_dict("records"), 0)
            for f in fields:
                some[f] = pd.Series([v.get(f) if v else None for v in found], dtype=object)
            some["resolved"] = [v is not None for v in found]
            yield some

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(through, ", ".join(f"`{c}` {kinds[c]}" for c in given) + f", {verdict}, resolved boolean")


def rescreen(parked: DataFrame, answer, verdict: str, now: datetime, days: int = 2, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the rows asked for, a report): the newest ``limit`` parked rows of the last ``days`` are asked for again.

    The report counts found, resolved, kept (relevant), still parked, and remaining: all parked of the window but the resolved.
    """
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    window = parked.where(F.col("seen_at") >= since)
    asked = window.orderBy(F.desc("seen_at"), "id").limit(limit)
    told = classify(asked, answer, verdict)
    done = F.coalesce(F.sum(F.col("resolved").cast("long")), F.lit(0))
    report = told.agg(F.count("*").alias("found"), done.alias("resolved"), F.count_if(F.col("resolved") & F.col("is_relevant")).alias("kept"), (F.count("*") - done).alias("still_parked"))
    return told, report.crossJoin(F.broadcast(window.agg(F.count("*").alias("_all")))).select("*", (F.col("_all") - F.col("resolved")).alias("remaining")).drop("_all")


def given(value: Column, where: Column) -> Column:
    """A field of a patch: present where ``where`` holds, with a value that may be null, which clears the field."""
    return F.when(where, F.struct(value.alias("value")))


def patched(target: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` after all patches of ``log``: each field takes the last value given, by ``order``; what was never given stays.

    ``log`` has the key, the order and for any fields of the target a struct (value), null where the patch does not have the
    field. A given null clears the field. Patches of unknown keys change nothing. Patches are compacted to one row a key on
    the map side, whatever number of them a key has.
    """
    fields = [c for c in log.columns if c not in (key, order)]
    last = log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields])
    kept = [F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns]
    return target.join(last, key, "left").select(*kept)


def pin_patch(log: DataFrame, at: str) -> DataFrame:
    """``log`` (team_share struct, ...) with ``team_share_at``: stamped by a pin, cleared by a hide or an unpin, untouched else."""
    stamp = F.when(F.col("team_share.value"), F.col(at))
    return log.withColumn("team_share_at", given(stamp, F.col("team_share").isNotNull()))


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))


def phone_or_null(value: Column) -> Column:
    """The digits of a number, null under eight of them."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, digits)


def list_or_null(value: Column) -> Column:
    kept = F.filter(F.transform(value, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def _islands(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): what the closed intervals of each group cover; those that touch are one."""
    order = W.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = pieces.withColumn("_new", (reach.isNull() | (F.col("lo") > reach)).cast("long"))
    return opens.withColumn("_n", F.sum("_new").over(order)).groupBy(*by, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_n")


def merge_spans(intervals: DataFrame, key: str, slot_us: int = 86_400_000_000) -> DataFrame:
    """(key, lo, hi): the spans that the closed intervals (key, lo, hi in microseconds) cover.

    Intervals are cut at slots of time and merged within each; only spans that touch a slot's edge, two a slot at most, are
    merged along a key, so a log with most of the pages is dealt over many tasks. Intervals with a null end or hi < lo count nowhere.
    """
    slots = F.sequence(F.floor(F.col("lo") / slot_us), F.floor(F.col("hi") / slot_us))
    cut = intervals.where("lo <= hi").select(key, "lo", "hi", F.explode(slots).alias("slot"))
    start = F.col("slot") * slot_us
    pieces = cut.select(key, "slot", F.greatest("lo", start).alias("lo"), F.least("hi", start + slot_us).alias("hi"))
    inner = _islands(pieces, [key, "slot"])
    edge = (F.col("lo") == start) | (F.col("hi") == start + slot_us)
    return inner.where(~edge).select(key, "lo", "hi").unionByName(_islands(inner.where(edge).select(key, "lo", "hi"), [key]))


def window_coverage(pages: DataFrame, log: DataFrame, key: str, now: datetime, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, window, n, undated, complete, state): distinct sends of each window of hours against its cap, and whether all of it was read.

    ``pages`` (key, newest, oldest, ended) are what was read of a log: from the cursor's row back to the oldest one; the newest page
    starts at ``now``, and ``ended`` marks a page after which the log has no more. A window is complete if the span of pages that
    ends now reaches its far edge or the log's end without a gap and no row is undated. An incomplete count is a floor: it can raise an alarm, but below the caps the state is unknown.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    at_now = us(F.lit(now))
    spans = merge_spans(pages.select(key, us(F.col("oldest")).alias("lo"), F.least(us(F.col("newest")), at_now).alias("hi")), key)
    end = pages.where("ended").groupBy(F.col(key).alias("_end_key")).agg(F.max(us(F.col("oldest"))).alias("end"))
    back = spans.where(F.col("hi") == at_now).join(end, F.col(key).eqNullSafe(F.col("_end_key")), "left")
    back = back.select(F.col(key).alias("_key"), F.when(F.col("lo") <= F.col("end"), 0).otherwise(F.col("lo")).alias("lo"))
    age = at_now - us(F.col("created_at"))
    hour = 3_600_000_000
    n = log.groupBy(key).agg(
        *[F.count_distinct(F.when((age >= 0) & (age <= h * hour), F.col("id"))).alias(w) for w, (h, _) in windows.items()],
        F.count_distinct(F.when(F.col("created_at").isNull(), F.col("id"))).alias("undated"),
    )
    met = n.join(back, F.col(key).eqNullSafe(F.col("_key")), "left")
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(w).alias("n"), F.lit(h).alias("hours"), F.lit(cap).alias("cap")) for w, (h, cap) in windows.items()]))
    each = met.select(key, "undated", "lo", rows.alias("w")).select(key, "undated", "lo", "w.*")
    complete = F.coalesce(F.col("lo") <= at_now - F.col("hours") * hour, F.lit(False)) & (F.col("undated") == 0)
    ratio = F.col("n") / F.col("cap")
    state = F.when(ratio >= 0.95, "crit").when(ratio >= 0.8, "warn").when(~F.col("complete"), "unknown").otherwise("ok")
    return each.withColumn("complete", complete).select(key, "window", "n", "undated", "complete", state.alias("state"))


def overlaps(runs: DataFrame, slot: str = "hour") -> DataFrame:
    """(id, overlaps): how many other runs were under way during each run (id, started_at, ended_at), ends not included.

    Those are the runs that start before its end, less those that end by its start, less itself. Starts and ends are counted
    by slot of time and summed over the slots before; within a slot a sweep counts the rest, so no two runs are ever paired.
    A run without an end counts as still going, one without a start is left out; one that ends as it starts is no span.
    """
    known = runs.where(F.col("started_at").isNotNull()).select("id", "started_at", F.coalesce("ended_at", F.lit(datetime(9999, 1, 1)).cast("timestamp_ntz")).alias("ended_at"))
    known = known.where(F.col("ended_at") > F.col("started_at"))
    marks = known.select("id", F.explode(F.array(
        F.struct(F.col("started_at").alias("t"), F.lit(1).alias("kind")), F.struct(F.col("ended_at").alias("t"), F.lit(0).alias("kind")),
    )).alias("m")).select("id", "m.t", "m.kind").withColumn("slot", F.date_trunc(slot, "t"))
    opened, closed = F.col("kind").cast("long"), (1 - F.col("kind")).cast("long")
    by_slot = marks.groupBy("slot").agg(F.sum(opened).alias("o"), F.sum(closed).alias("c"))
    day = by_slot.withColumn("day", F.date_trunc("day", "slot"))
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # a row for each day
    days = day.groupBy("day").agg(F.sum("o").alias("do"), F.sum("c").alias("dc"))
    days = days.select("day", F.coalesce(F.sum("do").over(before), F.lit(0)).alias("do"), F.coalesce(F.sum("dc").over(before), F.lit(0)).alias("dc"))
    in_day = W.partitionBy("day").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = day.join(days, "day").select(
        "slot", (F.col("do") + F.coalesce(F.sum("o").over(in_day), F.lit(0))).alias("o"), (F.col("dc") + F.coalesce(F.sum("c").over(in_day), F.lit(0))).alias("c")
    )
    # rows of one time count together: starts at it are not before it, ends at it are
    inside = marks.groupBy("slot", "t").agg(F.sum(opened).alias("no"), F.sum(closed).alias("nc"))
    upto = W.partitionBy("slot").orderBy("t")
    inside = inside.select("slot", "t", (F.sum("no").over(upto) - F.col("no")).alias("po"), F.sum("nc").over(upto).alias("pc"))
    placed = marks.join(inside, ["slot", "t"]).join(carried, "slot")
    # at an end: the starts before it; at a start: the ends up to it
    n = F.sum(F.when(F.col("kind") == 0, F.col("o") + F.col("po")).otherwise(-(F.col("c") + F.col("pc")))) - 1
    return placed.groupBy("id").agg(n.alias("overlaps"))
