"""What the board shows: its scan, lanes, filters and queues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.functions.text import half_up
from coverwell.operators import paging

MOST_IDS = 100


def since(rows: DataFrame, now: datetime, days: int) -> DataFrame:
    """Rows whose time of publication, or time seen, is of the last ``days`` days."""
    cut = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return rows.where(F.coalesce("published_at", "seen_at") >= cut)


def board(rows: DataFrame, now: datetime, days: int = 7, most: int = 200) -> DataFrame:
    """Relevant rows of the window: most important first, then newest, undated last, then latest seen; ties keep the lower id."""
    order = [F.desc("importance"), F.desc_nulls_last("published_at"), F.desc("seen_at"), F.asc("id")]
    return since(rows.where("is_relevant"), now, days).orderBy(*order).limit(most)


def newest_first(rows: DataFrame, now: datetime, days: int = 7, most: int = 200) -> DataFrame:
    """The board's other order: relevant rows of the window by time, latest first; of equals the most important, then the lower id."""
    order = [F.desc(F.coalesce("published_at", "seen_at")), F.desc(F.coalesce("importance", F.lit(0))), F.asc("id")]
    return since(rows.where("is_relevant"), now, days).orderBy(*order).limit(most)


def linked(rows: DataFrame, ids: list, total: int, most: int = MOST_IDS) -> DataFrame:
    """``by_ids`` with what a link of ids declares: how many of the ``total`` stories behind it are shown, and whether that is not all."""
    found = by_ids(rows, ids, most)
    n = found.agg(F.count("*").alias("shown"))  # at most ``most``
    return found.crossJoin(F.broadcast(n)).withColumns({"total": F.lit(total).cast("long"), "subset": F.col("shown") < total})


def pin_state(now: datetime, days: int) -> Column:
    """``pinned``, ``hidden`` or ``auto``: a pin holds for ``days`` after its stamp, a hide until it is lifted; a pin without a stamp holds."""
    fresh = F.col("team_share_at").isNull() | (F.col("team_share_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
    return F.when(F.col("team_share") & fresh, "pinned").when(~F.col("team_share"), "hidden").otherwise("auto")


def team_board(rows: DataFrame, now: datetime, days: int = 7, pin_days: int = 7, least: int = 2) -> DataFrame:
    """What the team sees, with ``pin``: pinned rows first; of the others those of the first tier that matter and that nobody turned down; no hidden ones."""
    judged = since(rows.where("is_relevant"), now, days).withColumn("pin", pin_state(now, pin_days))
    own = (F.col("tier") == 1) & (F.coalesce("importance", F.lit(0)) >= least) & (F.coalesce("feedback", F.lit(0)) != -1)
    return judged.where((F.col("pin") == "pinned") | ((F.col("pin") == "auto") & own))


def by_ids(rows: DataFrame, ids: list, most: int = MOST_IDS) -> DataFrame:
    """Rows of the given ids; what is no whole number is passed over, and no more than ``most`` are asked for."""
    wanted = [int(i) for i in ids if str(i).strip().isdecimal()][:most]
    return rows.where(F.col("id").isin(wanted)) if wanted else rows.where("false")


def brand_of(brands: tuple[str, ...], other: str = "other") -> Column:
    return F.when(F.col("brand").isin(*brands), F.col("brand")).otherwise(other)


def sentiment_of() -> Column:
    """Anything but negative and positive reads as neutral."""
    return F.when(F.col("sentiment").isin("negative", "positive"), F.col("sentiment")).otherwise("neutral")


def lane(home: str) -> Column:
    """The section a story files under: the home brand's by sentiment, all others in the middle."""
    return F.when(F.col("brand") == home, sentiment_of()).otherwise("neutral")


def lanes(rows: DataFrame, home: str) -> DataFrame:
    """(lane, n): how many stories each section holds."""
    return rows.groupBy(lane(home).alias("lane")).agg(F.count("*").alias("n"))


def wins(rows: DataFrame) -> DataFrame:
    """(brand, n): positive stories by brand."""
    return rows.where(F.col("sentiment") == "positive").groupBy("brand").agg(F.count("*").alias("n"))


def hero(rows: DataFrame, home: str) -> DataFrame:
    """The one story to lift above the lanes: of the negative lane the most important, then the newest; no row if it is empty."""
    order = [F.desc(F.coalesce("importance", F.lit(0))), F.desc(F.coalesce("published_at", "seen_at")), F.asc("id")]
    return rows.where(lane(home) == "negative").orderBy(*order).limit(1)


def parked() -> Column:
    """Whether a story got no verdict."""
    return (F.col("category") == "unclassified") & (F.col("confidence") == 0) & F.col("summary").isNull()


def missing_author(rows: DataFrame, most: int) -> DataFrame:
    """Relevant stories without an author, most important first, then latest seen."""
    return rows.where(F.col("is_relevant") & F.col("author").isNull()).orderBy(F.desc("importance"), F.desc("seen_at"), "id").limit(most)


def chosen(rows: DataFrame, coverage: DataFrame, outlet: str | None = None, author: str | None = None, pinned: bool | None = None, **equal) -> DataFrame:
    """Rows of a link's filters: equal columns, an outlet or author of any instance in any case, pinned ones."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    for column, value in (("outlet", outlet), ("author", author)):
        if value is not None:
            hit = coverage.where(F.lower(F.trim(column)) == value.strip().lower()).select(F.col("item_id").alias("id")).distinct()
            rows = rows.join(hit, "id", "left_semi")
    return rows if pinned is None else rows.where(F.col("pinned") == pinned)


def confidence_tier(high: float = 0.8, low: float = 0.5) -> Column:
    """Cut-offs are arguments; a story without a figure has no tier."""
    return F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= low, "medium").when(F.col("confidence").isNotNull(), "low")


def coverage_lists(coverage: DataFrame, ids: DataFrame) -> DataFrame:
    """(item_id, instances): for the stories of ``ids`` their instances (outlet, author, url, published_at), earliest first, undated last."""
    mine = coverage.join(ids.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi")
    one = F.struct(F.col("published_at").isNull().alias("_u"), "published_at", "outlet", "url", "author")
    shown = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["outlet"].alias("outlet"), x["author"].alias("author"), x["url"].alias("url"), x["published_at"].alias("published_at")))
    return mine.groupBy("item_id").agg(shown.alias("instances"))


def broken_feeds(health: DataFrame, feeds: DataFrame, now: datetime, days: int = 3) -> DataFrame:
    """Feeds of the registry that never worked or last did so over ``days`` days ago; retired feeds are passed over."""
    cut = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return health.where(F.col("last_ok_at").isNull() | (F.col("last_ok_at") < cut)).join(feeds.select("feed_id").distinct(), "feed_id", "left_semi")


def queue(rows: DataFrame, wanted: Column, *order: Column, stage) -> DataFrame:
    """The rows of a queue in its order, which must tell them apart, with their place from 1: a range-partitioned sort, not one task."""
    found = paging.placed(rows.where(wanted), list(order), stage)
    return found.withColumn("place", F.col("place") + 1)


def queues(every: dict[str, tuple[DataFrame, Column, list[Column]]], stage) -> DataFrame:
    """(queue, id, place) of several queues: by name the rows (id, ..), which of them wait, and their order."""
    parts = [queue(rows, wanted, *order, stage=stage).select(F.lit(name).alias("queue"), F.col("id").cast("string").alias("id"), "place") for name, (rows, wanted, order) in every.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failed_signins(log: DataFrame, email: str | None, ip: str | None, since_at: datetime, most: int = 100) -> DataFrame:
    """How many sign-ins of an address or a machine failed since then, counted up to ``most``."""
    hit = log.where((F.col("action") == "login_failed") & (F.col("created_at") >= F.lit(since_at).cast("timestamp_ntz")))
    return hit.where((F.col("email") == email) | (F.col("ip") == ip)).limit(most).agg(F.count("*").alias("n"))


def stale_lines(documents: DataFrame, now: datetime, days: int = 45, shown: int = 90) -> DataFrame:
    """(id, date, line, age_days): lines that begin with a date in brackets and are older than ``days``, oldest first in each document."""
    lines = documents.select("id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw"))
    pattern = r"^\s*[\[(](\d{4}-\d{2}-\d{2})[\])]\s*(.+)$"
    dated = lines.where(F.col("raw").rlike(pattern)).select(
        "id", "pos", F.regexp_extract("raw", pattern, 1).alias("date"), F.substring(F.regexp_extract("raw", pattern, 2), 1, shown).alias("line")
    )
    age = F.datediff(F.lit(now.date()), F.try_to_date("date", "yyyy-MM-dd"))
    return dated.withColumn("age_days", age.cast("long")).where(F.col("age_days") > days)


def document_review(documents: DataFrame, now: datetime, stale_days: int = 45, review_days: int = 60) -> DataFrame:
    """(id, state, stale, oldest, age_days): whether documents (id, content, updated_at) want pruning or a review.

    Stale dated lines warn, and the oldest is named, of equals the first; else an update over ``review_days`` ago warns. An empty document is fine,
    one that could not be read (null content) is unknown.
    """
    found = stale_lines(documents, now, stale_days).groupBy("id").agg(F.count("*").alias("stale"), F.max_by("line", F.struct("age_days", F.expr("-pos"))).alias("oldest"))
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000)
    rows = documents.join(found, "id", "left").withColumn("age_days", age)
    empty = F.trim(F.regexp_replace("content", r"\s+", " ")) == ""
    state = F.when(F.col("content").isNull(), "unknown").when(empty, "ok").when(F.col("stale") > 0, "warn").when(F.col("age_days") > review_days, "warn").otherwise("ok")
    return rows.select("id", state.alias("state"), F.coalesce("stale", F.lit(0)).alias("stale"), "oldest", "age_days")


def callouts(outlets: DataFrame, authors: DataFrame, categories: DataFrame, least: int = 2) -> DataFrame:
    """(kind, name, n, share): the outlet and author with most home negatives, from ``least`` on, and the category with most negatives and its share of all."""

    def top(board_: DataFrame, kind: str, name: str) -> DataFrame:
        rows = board_.where(F.col("home_negative") >= least).orderBy(F.desc("home_negative"), F.asc("key")).limit(1)
        return rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("home_negative").alias("n"), F.lit(None).cast("long").alias("share"))

    every = categories.agg(F.sum("negative").alias("all"))
    first = categories.where("negative > 0").orderBy(F.desc("negative"), "category").limit(1).crossJoin(F.broadcast(every))  # one row each
    share = half_up(100.0 * F.col("negative") / F.greatest("all", F.lit(1))).cast("long")
    worst = first.select(F.lit("category").alias("kind"), F.col("category").alias("name"), F.col("negative").alias("n"), share.alias("share"))
    return top(outlets, "outlet", "outlet").unionByName(top(authors, "author", "author")).unionByName(worst)


def rising_callout(threads: DataFrame) -> DataFrame:
    """(kind, name, n, share) of the narratives board: how many rise, and the biggest of them by total, then the least id; no row if none does."""
    rising = threads.where("rising")
    first = rising.agg(F.min_by("name", F.struct(-F.col("total"), "thread")).alias("name"), F.count("*").alias("n"))
    return first.where("n > 0").select(F.lit("rising").alias("kind"), "name", "n", F.lit(None).cast("long").alias("share"))


def manual_alert(rows: DataFrame, sent: DataFrame, qualifies: Column, force: bool = False) -> DataFrame:
    """(id, verdict): whether an alert may go out by hand: hidden and unqualified stories are refused, and one per story unless forced."""
    known = sent.select("id").distinct().withColumn("_sent", F.lit(True))
    verdict = (
        F.when(~F.col("is_relevant"), "hidden").when(~F.coalesce(qualifies, F.lit(False)), "not-qualifying")
        .when(F.col("_sent") & F.lit(not force), "already-sent").otherwise("ok")
    )
    return rows.join(known, "id", "left").select("id", verdict.alias("verdict"))


def channel_state(rungs: DataFrame) -> DataFrame:
    """(channel, state) of rungs (channel, live, rung, state): a missing rung warns, but is unknown where the channel is off; then unknown; then ok."""
    missing, unsure = F.max((F.col("state") == "missing").cast("int")), F.max((F.col("state") == "unknown").cast("int"))
    by = rungs.groupBy("channel", "live").agg(missing.alias("m"), unsure.alias("u"))
    state = F.when((F.col("m") == 1) & F.col("live"), "warn").when((F.col("m") == 1) | (F.col("u") == 1), "unknown").otherwise("ok")
    return by.select("channel", state.alias("state"))
