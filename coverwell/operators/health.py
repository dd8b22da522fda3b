"""Operational checks over run, usage and delivery ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of a state; the overall one is the highest.
STATES = {"ok": 0, "unknown": 1, "warn": 2, "crit": 3}


def hours_since(at: Column, now: datetime) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3_600_000_000)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run of every job; runs combine on the map side."""
    kept = [c for c in runs.columns if c != "job"]
    return runs.groupBy("job").agg(F.max_by(F.struct(*kept), F.struct("started_at", "id")).alias("r")).select("job", "r.*")


def overdue(runs: DataFrame, limits: dict[str, float], now: datetime) -> DataFrame:
    """Jobs whose last run is older than their limit in hours; a job that never ran is unknown."""
    wanted = runs.sparkSession.createDataFrame(list(limits.items()), "job string, limit double")
    last = runs.groupBy("job").agg(F.max("started_at").alias("last"))
    age = hours_since(F.col("last"), now)
    state = F.when(F.col("last").isNull(), "unknown").when(age > F.col("limit"), "warn").otherwise("ok")
    return last.join(F.broadcast(wanted), "job", "right").select("job", "limit", F.floor(age).cast("long").alias("age_hours"), state.alias("state"))


def failure_streaks(outcomes: DataFrame) -> DataFrame:
    """(job, streak, last_ok): failures since the last success, which failures never touch."""
    ok = outcomes.where("ok").groupBy("job").agg(F.max("started_at").alias("last_ok"))
    failed = outcomes.where("not ok").join(ok, "job", "left")
    since = failed.where(F.col("last_ok").isNull() | (F.col("started_at") > F.col("last_ok"))).groupBy("job").agg(F.count("*").alias("streak"))
    jobs = outcomes.select("job").distinct()
    return jobs.join(since, "job", "left").join(ok, "job", "left").select("job", F.coalesce("streak", F.lit(0)).alias("streak"), "last_ok")


def quota(log: DataFrame, now: datetime, day_cap: int, month_cap: int) -> DataFrame:
    """Distinct sends of the last 24 hours and 30 days against their caps; the worse ratio sets the state."""
    age = hours_since(F.col("created_at"), now)
    n = log.agg(F.count_distinct(F.when((age >= 0) & (age < 24), F.col("id"))).alias("day"), F.count_distinct(F.when((age >= 0) & (age < 720), F.col("id"))).alias("month"))
    ratio = F.greatest(F.col("day") / day_cap, F.col("month") / month_cap)
    return n.withColumn("state", F.when(ratio >= 0.95, "crit").when(ratio >= 0.8, "warn").otherwise("ok"))


def usage_cost(usage: DataFrame, prices: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """Cost by stage: (in + 1.25 cache writes + 0.1 cache reads) and out, at prices per million; unknown stages pay ``default``'s."""
    stages = F.when(F.col("stage").isin(*prices), F.col("stage")).otherwise(default)
    price = lambda i: F.coalesce(*[F.when(stages == s, F.lit(p[i])) for s, p in prices.items()])
    tokens_in = F.col("tokens_in") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")
    return usage.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum((tokens_in * price(0) + F.col("tokens_out") * price(1)) / 1e6), 6).alias("cost"))


def cache_ratio(usage: DataFrame, least_calls: int = 5) -> DataFrame:
    """Share of cached tokens that were read, by stage; null under ``least_calls`` cached calls."""
    cached = (F.col("cache_read") + F.col("cache_write")) > 0
    reads, writes = F.sum("cache_read"), F.sum("cache_write")
    by = usage.groupBy("stage").agg(F.count_if(cached).alias("calls"), reads.alias("reads"), writes.alias("writes"))
    return by.withColumn("ratio", F.when(F.col("calls") >= least_calls, F.round(F.col("reads") / (F.col("reads") + F.col("writes")), 6)))


def relevance_baseline(rows: DataFrame, now: datetime, least: int = 100) -> DataFrame:
    """The share of relevant rows of 7 days against the 21 before, and the state of their deviation."""
    age = F.floor(hours_since(F.col("seen_at"), now) / 24)
    now_, past = (age >= 0) & (age < 7), (age >= 7) & (age < 28)
    n = rows.agg(
        F.count_if(now_).alias("stored"), F.count_if(now_ & F.col("relevant")).alias("kept"), F.count_if(past).alias("stored_before"), F.count_if(past & F.col("relevant")).alias("kept_before")
    )
    rate, before = F.try_divide("kept", "stored"), F.try_divide("kept_before", "stored_before")
    change = F.try_divide(rate, before) - 1
    unsure = (F.col("stored") < least) | (F.col("stored_before") < least)
    state = F.when(unsure | change.isNull(), "unknown").when(change <= -0.7, "crit").when(F.abs(change) >= 0.5, "warn").otherwise("ok")
    return n.withColumns({"rate": F.round(rate, 6), "rate_before": F.round(before, 6), "state": state})


def author_backlog(rows: DataFrame, now: datetime) -> DataFrame:
    """Stories without an author, and those waiting over 36 hours."""
    missing = F.col("author").isNull()
    n = rows.agg(F.count("*").alias("total"), F.count_if(missing).alias("missing"), F.count_if(missing & (hours_since(F.col("seen_at"), now) > 36)).alias("stale"))
    share = F.try_divide("missing", "total")
    return n.withColumn("state", F.when(F.col("total") < 20, "unknown").when(share >= 0.75, "warn").otherwise("ok"))


def rollup(checks: DataFrame) -> DataFrame:
    """The worst state of all checks and how many are in each."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(r)) for s, r in STATES.items()])
    return checks.agg(F.max_by("state", rank).alias("overall"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def ingest_volume(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Stories stored in the last ``hours``, and how many of them are relevant."""
    age = hours_since(F.col("seen_at"), now)
    return rows.where((age >= 0) & (age <= hours)).agg(F.count("*").alias("stored"), F.count_if("is_relevant").alias("relevant"))


def month_projection(costs: DataFrame, now: datetime, cap: float) -> DataFrame:
    """What this month cost so far and comes to at the same pace: critical at ``cap``, a warning if the projection passes it."""
    at = F.lit(now).cast("timestamp_ntz")
    month = costs.where((F.col("created_at") >= F.date_trunc("month", at)) & (F.col("created_at") <= at))
    spent = month.agg(F.coalesce(F.round(F.sum("cost"), 6), F.lit(0.0)).alias("spent"), F.count("*").alias("calls"))
    projected = F.col("spent") / F.greatest(F.lit(1), F.dayofmonth(at)) * F.dayofmonth(F.last_day(at))
    state = F.when(F.col("calls") == 0, "unknown").when(F.col("spent") >= cap, "crit").when(projected > cap, "warn").otherwise("ok")
    return spent.select("calls", "spent", F.round(projected, 4).alias("projected"), state.alias("state"))


def cache_efficiency(usage: DataFrame, known: tuple[str, ...], now: datetime, hours: int = 24, least_calls: int = 5) -> DataFrame:
    """One row: calls that cached, tokens read and written, the share read, and whether the latest call still caches.

    Calls of known stages count that are undated or at most ``hours`` old. The share is null under ``least_calls``; the latest call is
    the last dated one, of equals the one of the greatest id, whether it cached or not.
    """
    rows = usage.where(F.col("stage").isin(*known)).withColumn("_age", hours_since(F.col("created_at"), now)).where("_age IS NULL OR _age <= %d" % hours)
    cached = (F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))) > 0
    dated = F.when(F.col("created_at").isNotNull(), F.struct("created_at", "id"))
    found = rows.agg(
        F.count_if(cached).alias("calls"), F.coalesce(F.sum("cache_read"), F.lit(0)).alias("reads"), F.coalesce(F.sum("cache_write"), F.lit(0)).alias("writes"),
        F.coalesce(F.max_by(cached, dated), F.lit(False)).alias("still_caching"),
    )
    ratio = F.when((F.col("calls") >= least_calls) & (F.col("reads") + F.col("writes") > 0), F.round(F.col("reads") / (F.col("reads") + F.col("writes")), 6))
    return found.withColumn("ratio", ratio)


def digest_eligible(rows: DataFrame, now: datetime, until: datetime | None = None, hours: int = 24, least: int = 2) -> DataFrame:
    """How many relevant stories a digest would carry now, or would have carried at ``until``, which is not in its window."""
    end = F.lit(until or now).cast("timestamp_ntz")
    hit = rows.where(F.col("is_relevant") & (F.col("importance") >= least) & (F.col("seen_at") >= end - F.make_dt_interval(hours=F.lit(hours))))
    return (hit if until is None else hit.where(F.col("seen_at") < end)).agg(F.count("*").alias("eligible"))


def audit_findings(answers: DataFrame) -> DataFrame:
    """Audited answers (engine, question, verdict fields) as findings: sentiments outside the three are neutral, severity is 1 to 5,
    at most six issues and 300 characters of note; flagged by negative framing, an issue or a negative sentiment. No verdict is no flag."""
    known = F.when(F.col("sentiment").isin("negative", "positive"), F.col("sentiment")).otherwise("neutral")
    severity = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(F.nullif(F.expr("try_cast(severity AS double)"), F.lit(0.0)), F.lit(1.0))))
    issues = F.slice(F.filter(F.coalesce("issues", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), 1, 6)
    judged = F.col("judged")
    out = answers.withColumns({"sentiment": F.when(judged, known), "severity": F.when(judged, severity), "issues": F.when(judged, issues), "note": F.when(judged, F.substring(F.coalesce("note", F.lit("")), 1, 300))})
    flagged = judged & (F.coalesce("negative_framing", F.lit(False)) | (F.size("issues") > 0) | (F.col("sentiment") == "negative"))
    return out.withColumn("flagged", F.coalesce(flagged, F.lit(False)))


def audit_summary(findings: DataFrame) -> DataFrame:
    """(engine, checked, flagged, worst): a row for each engine that answered."""
    return findings.groupBy("engine").agg(F.count("*").alias("checked"), F.count_if("flagged").alias("flagged"), F.max("severity").alias("worst"))
