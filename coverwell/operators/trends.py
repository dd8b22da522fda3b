"""Daily trends and leaderboards over stories and their coverage.

Every function takes the clock or the axis explicitly. Aggregates combine on the map side;
leaderboards end in a top-k, never in a sort of all rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.operators import bylines

def is_negative() -> Column:
    return F.col("sentiment") == "negative"


def count_if(test: Column) -> Column:
    return F.count_if(test)


def axis(frame: DataFrame, first: date, last: date) -> DataFrame:
    """(idx, day): every civil day from ``first`` to ``last``; ``frame`` gives the session."""
    return frame.sparkSession.range(1).select(F.posexplode(F.sequence(F.lit(first), F.lit(last))).alias("idx", "day"))


def totals(stories: DataFrame, home: str) -> DataFrame:
    neg, pos = is_negative(), F.col("sentiment") == "positive"
    return stories.agg(
        F.count("*").alias("items"), count_if(neg).alias("negatives"), count_if(pos).alias("positives"),
        (F.count("*") - count_if(neg) - count_if(pos)).alias("neutrals"), count_if(F.col("brand") == home).alias("home_mentions"),
        count_if((F.col("brand") == home) & neg).alias("home_negatives"),
    )


def share_of_voice(stories: DataFrame, days: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """(brand, idx, day, mentions, negatives) for every brand and day, zeros included."""
    counted = stories.groupBy("brand", "day").agg(F.count("*").alias("n"), count_if(is_negative()).alias("neg"))
    spine = days.select("idx", "day", F.explode(F.array(*map(F.lit, brands))).alias("brand"))
    return counted.join(F.broadcast(spine), ["brand", "day"], "right").select(
        "brand", F.col("idx").cast("long"), "day", F.coalesce("n", F.lit(0)).alias("mentions"), F.coalesce("neg", F.lit(0)).alias("negatives")
    )


def sentiment_matrix(stories: DataFrame) -> DataFrame:
    n = lambda s: count_if(F.col("sentiment") == s).alias(s)
    return stories.groupBy("brand").agg(n("negative"), n("neutral"), n("positive"), F.count("*").alias("total"))


def category_board(stories: DataFrame, home: str) -> DataFrame:
    return stories.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(
        F.count("*").alias("total"), count_if(is_negative()).alias("negative"),
        count_if(is_negative() & (F.col("brand") == home)).alias("home_negative"),
    )


def carried(stories: DataFrame, coverage: DataFrame) -> DataFrame:
    """Stories by outlet: coverage rows, or the story's own outlet and author where it has none."""
    met = stories.join(coverage.withColumnRenamed("author", "_author"), F.col("id") == F.col("item_id"), "left")
    return met.withColumns(
        {
            "outlet": F.when(F.col("item_id").isNull(), F.col("source")).otherwise(F.col("outlet")),
            "byline": F.when(F.col("item_id").isNull(), F.col("author")).otherwise(F.col("_author")),
            "pos": F.coalesce("pos", F.lit(0)),
        }
    )


def _board(rows: DataFrame, key: Column, shown: str, home: str, most: int | None) -> DataFrame:
    """Counts each story once per key, its first row in order of coverage; names keep the casing seen first."""
    keyed = rows.withColumn("key", key).where(F.col("key") != "")
    once = keyed.groupBy("key", "id").agg(
        F.min(F.struct("pos", F.col(shown).alias("shown"), "outlet", "sentiment", "brand")).alias("r")
    )
    neg = F.col("r.sentiment") == "negative"
    board = once.groupBy("key").agg(
        F.min_by("r.shown", "id").alias(shown), F.count("*").alias("mentions"), count_if(neg).alias("negative"),
        count_if(F.col("r.sentiment") == "positive").alias("positive"), count_if(F.col("r.sentiment") == "neutral").alias("neutral"),
        count_if(neg & (F.col("r.brand") == home)).alias("home_negative"),
    )
    order = [F.desc("home_negative"), F.desc("negative"), F.desc("mentions"), F.asc("key")]
    return board if most is None else board.orderBy(*order).limit(most)


def outlet_leaderboard(rows: DataFrame, home: str, most: int | None = 300) -> DataFrame:
    return _board(rows, F.lower(F.trim("outlet")), "outlet", home, most)


def author_leaderboard(rows: DataFrame, home: str, most: int | None = 300) -> DataFrame:
    """Authors, with the first three outlets that each was seen in."""
    named = rows.where(F.col("byline").isNotNull() & ~F.trim("byline").isin("", "—")).withColumn("author", F.col("byline"))
    board = _board(named, F.lower(F.trim("byline")), "author", home, most)
    seen = named.groupBy(F.lower(F.trim("byline")).alias("key"), "outlet").agg(F.min(F.struct("id", "pos")).alias("at"))
    ranked = seen.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("at", "outlet"))).where("n <= 3")
    outlets = ranked.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "outlet"))), lambda x: x["outlet"]), "|").alias("outlets"))
    return board.join(outlets, "key")


def byline_coverage(rows: DataFrame) -> DataFrame:
    """Exact distinct outlets, authors and stories with a byline."""
    signed = F.col("byline").isNotNull() & ~F.trim("byline").isin("", "—")
    return rows.agg(
        F.count_distinct(F.lower(F.trim("outlet"))).alias("outlets"), F.count_distinct(F.when(signed, F.lower(F.trim("byline")))).alias("authors"),
        F.count_distinct(F.when(signed, F.col("id"))).alias("signed_stories"),
    )


def half_movement(series: DataFrame, n_days: int) -> DataFrame:
    """Negatives of the first and second half of the axis per brand; the odd middle day is left out, and no change is given from zero."""
    half = n_days // 2
    first, second = F.sum(F.when(F.col("idx") < half, F.col("negatives")).otherwise(0)), F.sum(F.when(F.col("idx") >= n_days - half, F.col("negatives")).otherwise(0))
    rows = series.groupBy("brand").agg(first.alias("before"), second.alias("after"))
    return rows.withColumn("change_pct", F.when(F.col("before") > 0, F.floor(100.0 * (F.col("after") - F.col("before")) / F.col("before") + 0.5)))


def series(rows: DataFrame, key: Column, days: int, idx: str = "idx") -> DataFrame:
    """(key, total, series): how many rows a key has on each day of an axis of ``days``; rows off the axis count in neither."""
    by_day = rows.where(F.col(idx).between(0, days - 1)).groupBy(key.alias("key"), F.col(idx).alias("_i")).agg(F.count("*").alias("n"))
    found = by_day.groupBy("key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("_i", "n"))).alias("m"))  # an entry a day
    each = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return found.select("key", "total", each.cast("array<bigint>").alias("series"))


def once_per_key(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` of ``carried`` with ``key``, each story once a key: its first row in order of coverage; empty keys go."""
    keyed = rows.withColumn("key", key).where(F.col("key") != "")
    kept = [F.col(c) for c in keyed.columns]
    return keyed.groupBy(F.col("key").alias("_k"), F.col("id").alias("_i")).agg(F.min_by(F.struct(*kept), F.struct("pos", "outlet")).alias("r")).select("r.*")


def people(rows: DataFrame) -> DataFrame:
    """Rows of ``carried`` whose byline names a person: none that is empty, a dash, or reads like a publication."""
    named = F.col("byline").isNotNull() & ~F.trim("byline").isin("", "—")
    return rows.where(named & ~F.coalesce(bylines.outlet_like(F.col("byline"), F.col("outlet")), F.lit(False)))
