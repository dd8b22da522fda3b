"""The ingest chain: cards from clusters, duplicates of stored stories, and the digest.

A duplicate is never thrown away: it is merged, which means that its outlets become coverage of
the story that is stored already. Order of arrival is a column, so reruns agree.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.operators.dedupe import classes, first_wins, similar_pairs
from coverwell.operators.filters import digest


def instance_key() -> Column:
    """What makes two instances of a card one: the link, or the outlet and headline where there is none."""
    return F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("headline", F.lit(""))))


def card_instances(members: DataFrame, order: list[Column]) -> DataFrame:
    """(card, id, outlet, author, url, published_at): the instances of every card, the first of equals in ``order``."""
    kept = first_wins(members, F.struct("card", instance_key()), order)
    return kept.select("card", "id", F.col("source").alias("outlet"), "author", F.coalesce("url", F.lit("")).alias("url"), "published_at")


def cards(members: DataFrame, best: list[Column], named_only: bool = False) -> DataFrame:
    """One row a card: its winner, the first in ``best``, with how many members and other sources it stands for.

    ``shown`` is the source with ``+ N more`` for the distinct sources of the other members;
    with ``named_only`` members without a source are no source.
    """
    kept = [F.col(c) for c in members.columns if c != "card"]
    won = members.groupBy("card").agg(F.min_by(F.struct(*kept), F.struct(*best)).alias("w"), F.count("*").alias("n"))
    others = members.join(won.select("card", F.col("w.id").alias("_winner")), "card").where(F.col("id") != F.col("_winner"))
    nameless = F.max(F.col("source").isNull().cast("int")) if not named_only else F.lit(0)
    more = others.groupBy("card").agg((F.count_distinct(F.nullif("source", F.lit("")) if named_only else F.col("source")) + nameless).alias("more"))
    out = won.join(more, "card", "left").select("card", "w.*", "n", F.coalesce("more", F.lit(0)).cast("long").alias("more"))
    return out.withColumn("shown", F.when(F.col("more") > 0, F.concat("source", F.lit(" + "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.col("source")))


def newest_last_null(at: str) -> Column:
    """Sorts newest first and undated rows last."""
    return -F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0))


def headline_order() -> list[Column]:
    """Best tier first, none counting as nine, then newest, then first to arrive."""
    tier = F.when(F.coalesce("tier", F.lit(0)) == 0, 9).otherwise(F.col("tier"))
    return [tier, newest_last_null("published_at"), F.col("id")]


def summary_order() -> list[Column]:
    """Most important first, then newest, then first to arrive."""
    return [-F.coalesce("importance", F.lit(0)), newest_last_null("published_at"), F.col("id")]


def summary_first(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per summary hash, the first in ``order``; rows without a summary stay, each by its own hash."""
    return first_wins(rows, F.coalesce("summary_hash", F.concat(F.lit("nosum-"), "hash")), order)


def crossrun_exact(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, seen, into_id): whether the hash is stored, and the stored story it belongs to, the least id of several."""
    known = stored.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("id").alias("into_id"), F.lit(True).alias("seen"))
    return new.select("id", "hash").join(known, "hash", "left").select("id", F.coalesce("seen", F.lit(False)).alias("seen"), "into_id")


def crossrun_summary(new: DataFrame, pool: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, into_id): the stored story with the same summary hash, else the first similar one by ``pos``; null if none."""
    exact = pool.where(F.col("summary_hash").isNotNull()).groupBy("summary_hash").agg(F.min("id").alias("by_hash"))
    mine, members = classes(new.select("id", "toks"), [], "id")  # copies meet others once
    theirs, _ = classes(pool.select("id", "toks", "pos"), [], "pos")
    met = similar_pairs(mine, theirs.select("id", "toks"), least).join(theirs.select(F.col("id").alias("b"), "pos"), "b")
    like = met.groupBy(F.col("a").alias("first")).agg(F.min_by("b", "pos").alias("by_words"))
    like = members.join(like, "first").select("id", "by_words")
    out = new.select("id", "summary_hash").join(exact, "summary_hash", "left").join(like, "id", "left")
    return out.select("id", F.coalesce("by_hash", "by_words").alias("into_id"))


def attach_merged(coverage: DataFrame, merged: DataFrame, instances: DataFrame) -> DataFrame:
    """``coverage`` and the instances of merged items under the story they went into; (item_id, url) stays unique.

    ``merged`` has (id, into_id); an item without a target adds nothing, one without instances
    is none here, since a card always has its own.
    """
    moved = instances.join(merged.where(F.col("into_id").isNotNull()), instances["card"] == merged["id"])
    moved = moved.select(F.col("into_id").alias("item_id"), "outlet", "author", "url", instances["id"].alias("_order"))
    fresh = moved.join(coverage.select("item_id", "url"), ["item_id", "url"], "left_anti")
    kept = first_wins(fresh, F.struct("item_id", "url"), [F.col("_order")])
    return coverage.select("item_id", "outlet", "author", "url").unionByName(kept.select("item_id", "outlet", "author", "url"))


def merge_duplicates(stories: DataFrame, coverage: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories, coverage) after folding each drop_id of ``pairs`` into its keep_id.

    The instances of the dropped story move unless the kept one has their link; a story without
    instances moves as itself. Rows without a link stay behind, and the dropped story is no longer relevant.
    Of several moves to one link the least dropped id and the first outlet win.
    """
    pairs = pairs.where("keep_id <> drop_id").select("keep_id", "drop_id").distinct()
    own = coverage.select(F.col("item_id").alias("drop_id"), "outlet", "author", "url").join(pairs, "drop_id")
    bare = pairs.join(coverage.select(F.col("item_id").alias("drop_id")), "drop_id", "left_anti")
    itself = bare.join(stories.select(F.col("id").alias("drop_id"), F.col("source").alias("outlet"), "author", "url"), "drop_id")
    moved = own.unionByName(itself.select(*own.columns)).where(F.coalesce("url", F.lit("")) != "")
    moved = moved.withColumn("item_id", F.col("keep_id")).join(coverage.select("item_id", "url"), ["item_id", "url"], "left_anti")
    moved = first_wins(moved, F.struct("item_id", "url"), [F.col("drop_id"), F.col("outlet"), F.col("author")])
    columns = ["item_id", "outlet", "author", "url"]
    hidden = pairs.select(F.col("drop_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    left = stories.join(hidden, "id", "left").withColumn("is_relevant", F.col("is_relevant") & F.col("_gone").isNull()).drop("_gone")
    return left, coverage.select(*columns).unionByName(moved.select(*columns))


def digest_merge(stored: DataFrame, run: DataFrame, now: datetime, same: DataFrame | None = None) -> DataFrame:
    """What the digest carries: stored relevant stories of the last day, and of this run those whose hash is not among them.

    ``same`` (id) are stories that the last sweep calls the same as another one; without it none goes.
    """
    base = digest(stored.where("is_relevant"), now)
    columns = [c for c in base.columns if c in run.columns]
    both = base.select(*columns).unionByName(run.join(base.select("hash").distinct(), "hash", "left_anti").select(*columns))
    return both if same is None else both.join(same.select("id").distinct(), "id", "left_anti")


def subject_counts(rows: DataFrame) -> DataFrame:
    """What the subject line says: stories, negatives, and those of importance four or more."""
    return rows.agg(
        F.count("*").alias("stories"), F.count_if(F.col("sentiment") == "negative").alias("negatives"), F.count_if(F.coalesce("importance", F.lit(0)) >= 4).alias("high")
    )


def recipients(*lists: DataFrame, column: str = "number") -> DataFrame:
    """(number): the digits of all lists, of eight or more, each once."""
    out = None
    for each in lists:
        digits = each.select(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "[^0-9]", "").alias("number")).where(F.length("number") >= 8)
        out = digits if out is None else out.unionByName(digits)
    return out.distinct()


def with_headlines(top: DataFrame, headlines: DataFrame, fallback: Column) -> DataFrame:
    """``top`` with the headline of each id, or ``fallback`` where none is stored."""
    return top.join(headlines.select("id", "headline"), "id", "left").withColumn("headline", F.coalesce("headline", fallback))
