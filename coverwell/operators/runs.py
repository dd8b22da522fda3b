"""The run ledger's checks, the ladders of the health page, backfill outcomes, the feed registry and link decoding."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.functions import wires
from coverwell.operators.health import hours_since

#: Outcomes of a backfill, in the order of the report.
OUTCOMES = ("filled", "unresolved", "fetchFailed", "noByline", "writeFailed")


def feed_registry(queries: DataFrame, sites: DataFrame, direct: DataFrame, base: str) -> DataFrame:
    """(feed_id, brand, url, direct, urgent): a row for each search, each group of sites and each feed of an outlet's own.

    ``queries`` are (id, brand, q, locale), ``sites`` (id, domains, terms, locale), ``direct`` (id, url). Items of the last two must
    pass the prefilter; the urgent poll reads the first only. A row without a query, a domain or a known locale has no URL.
    """
    none = F.lit(None).cast("string")
    any_of = F.array_join(F.transform("domains", lambda d: F.concat(F.lit("site:"), d)), " OR ")
    scoped = F.when(F.size("domains") > 0, F.concat(F.lit("("), any_of, F.lit(") "), F.col("terms")))
    rows = queries.select("id", "brand", "q", "locale", none.alias("own"), F.lit(False).alias("direct"))
    rows = rows.unionByName(sites.select("id", none.alias("brand"), scoped.alias("q"), "locale", none.alias("own"), F.lit(True).alias("direct")))
    rows = rows.unionByName(direct.select("id", none.alias("brand"), none.alias("q"), none.alias("locale"), F.col("url").alias("own"), F.lit(True).alias("direct")))
    url = F.coalesce("own", *[F.when(F.col("locale") == loc, wires.search_url(F.col("q"), loc, base)) for loc in wires.LOCALES])
    return rows.select(F.col("id").alias("feed_id"), "brand", url.alias("url"), "direct", (~F.col("direct")).alias("urgent"))


def decode_links(rows: DataFrame, targets: DataFrame, host: str) -> DataFrame:
    """``rows`` with ``resolved_url``: the target of a wrapped link by (url, target), else the link itself.

    Only wrapped links are joined, each once; targets that are wrappers themselves, or null, do not count, and the least of several wins.
    """
    wrapped = wires.wrapper_host(F.col("url"), host)
    known = targets.where(F.col("target").isNotNull() & ~wires.wrapper_host(F.col("target"), host)).groupBy("url").agg(F.min("target").alias("_target"))
    done = rows.where(wrapped).join(known, "url", "left").select(*rows.columns, F.coalesce("_target", "url").alias("resolved_url"))
    return rows.where(~wrapped).withColumn("resolved_url", F.col("url")).unionByName(done)


def longest_streak(outcomes: DataFrame, unit: str = "hour") -> DataFrame:
    """(job, longest): the longest row of failures of each job that failed.

    Runs are ordered within a job's ``unit`` of time; each unit leaves its leading, trailing and best row of failures, and only these are
    ordered along the job, so a job with most of the runs is dealt over many tasks.
    """
    slot = outcomes.withColumn("slot", F.date_trunc(unit, "started_at"))
    inner = W.partitionBy("job", "slot").orderBy("started_at", "id")
    islands = slot.withColumn("island", F.sum(F.col("ok").cast("long")).over(inner)).groupBy("job", "slot", "island").agg(F.count_if(~F.col("ok")).alias("n"))
    units = islands.groupBy("job", "slot").agg(F.max("island").alias("oks"), F.max("n").alias("best"), F.coalesce(F.max(F.when(F.col("island") == 0, F.col("n"))), F.lit(0)).alias("lead"), F.max_by("n", "island").alias("trail"))
    row = units.withColumn("g", F.sum((F.col("oks") > 0).cast("long")).over(W.partitionBy("job").orderBy("slot")))
    before = F.struct((F.col("g") - 1).alias("g"), F.col("lead").alias("n"))
    after = F.struct(F.col("g").alias("g"), F.col("trail").alias("n"))
    parts = row.select("job", "best", F.explode(F.when(F.col("oks") > 0, F.array(before, after)).otherwise(F.array(after))).alias("p"))
    joined = parts.groupBy("job", "p.g").agg(F.sum("p.n").alias("n"), F.max("best").alias("best"))
    return joined.groupBy("job").agg(F.max(F.greatest("n", "best")).alias("longest")).where("longest > 0")


def run_checks(runs: DataFrame, limits: dict[str, float], now: datetime, stall_minutes: float = 30) -> DataFrame:
    """(check, state, n): whether jobs are overdue, and whether runs ended. Runs are (id, job, status, started_at, duration_ms).

    Jobs outside ``limits`` are manual: they do not answer for the schedule. A stall is a run still open after ``stall_minutes``; it goes
    before failures, and ``n`` counts the late jobs, the stalled or failed runs, or the milliseconds of the slowest.
    """
    wanted = runs.sparkSession.createDataFrame(list(limits.items()), "job string, limit double")
    last = runs.groupBy("job").agg(F.max("started_at").alias("last")).join(F.broadcast(wanted), "job")  # a row per job
    late = last.agg(F.count("*").alias("seen"), F.count_if(hours_since(F.col("last"), now) > F.col("limit")).alias("n"))
    clock = late.select(F.lit("runs").alias("check"), F.when(F.col("seen") == 0, "unknown").when(F.col("n") > 0, "crit").otherwise("ok").alias("state"), "n")
    stalled = (F.col("status") == "running") & (hours_since(F.col("started_at"), now) * 60 > stall_minutes)
    ends = runs.agg(F.count_if(stalled).alias("stalled"), F.count_if(F.col("status") == "error").alias("failed"), F.max("duration_ms").alias("slowest"))
    n = F.when(F.col("stalled") > 0, F.col("stalled")).when(F.col("failed") > 0, F.col("failed")).otherwise(F.col("slowest")).cast("long")
    state = F.when((F.col("stalled") > 0) | (F.col("failed") > 0), "warn").otherwise("ok")
    return clock.unionByName(ends.select(F.lit("runstall").alias("check"), state.alias("state"), n.alias("n")))


def freshness_state(last_seen: Column, now: datetime, warn: float = 8, crit: float = 20) -> Column:
    """Of the last story's age in hours; critical without any story."""
    age = hours_since(last_seen, now)
    return F.when(age.isNull() | (age > crit), "crit").when(age > warn, "warn").otherwise("ok")


def parked_state(n: Column, crit: int = 20) -> Column:
    return F.when(n.isNull(), "unknown").when(n >= crit, "crit").when(n > 0, "warn").otherwise("ok")


def storage_state(used: Column, cap: Column, warn: float = 0.6, crit: float = 0.9) -> Column:
    """Of the share of the room in use, both in the same unit."""
    share = F.try_divide(used, cap)
    return F.when(share.isNull(), "unknown").when(share >= crit, "crit").when(share >= warn, "warn").otherwise("ok")


def brief_due(now: datetime, hour: int = 5, grace: timedelta = timedelta(hours=1)) -> datetime:
    """The last time (UTC) that a daily brief was due and had the grace to end."""
    due = now.replace(hour=hour, minute=0, second=0, microsecond=0)
    return due if now - due >= grace else due - timedelta(days=1)


def brief_state(sent_at: Column, waiting_at_due: Column, due: datetime) -> Column:
    """A brief is late if none went out since it was due and something had waited then; unknown if that was not counted."""
    late = sent_at.isNull() | (sent_at < F.lit(due).cast("timestamp_ntz"))
    return F.when(~late, "ok").when(waiting_at_due.isNull(), "unknown").when(waiting_at_due > 0, "crit").otherwise("ok")


def backfill_outcomes(attempts: DataFrame) -> DataFrame:
    """(outcome, n) of attempts (author, fetchable, fetched, written), every outcome with a row.

    Without an author: no link that can be fetched, no fetch that worked, or a page without a byline; with one, the write worked or not.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.col("author").isNotNull()
    outcome = (
        F.when(found & yes("written"), "filled").when(found, "writeFailed").when(~yes("fetchable"), "unresolved")
        .when(yes("fetched"), "noByline").otherwise("fetchFailed")
    )
    every = attempts.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return every.join(attempts.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
