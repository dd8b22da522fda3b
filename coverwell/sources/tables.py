"""Reading the tables, and the story, coverage and ledger views that the analytics run on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Africa/Cairo"
BRANDS = ("home", "rival_a", "rival_b", "rival_c")
HOME = "home"
#: The clock of the queries; operators never read the machine's.
NOW = datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_day(at):
    """The civil day of a zone-less UTC timestamp."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), at))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories: id, brand, sentiment, category, importance, source, author, published_at, seen_at, at, day."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    brand = F.when(F.col("user_id") % 5 < 4, F.get(F.array(*map(F.lit, BRANDS)), (F.col("user_id") % 5).cast("int"))).otherwise("other")
    sentiment = (
        F.when(F.col("event_type") == "error", "negative").when(F.col("event_type").isin("purchase", "signup"), "positive").otherwise("neutral")
    )
    rows = e.select(
        F.col("event_id").alias("id"), brand.alias("brand"), sentiment.alias("sentiment"),
        F.concat(F.lit("cat"), (k % 6).cast("string")).alias("category"), (1 + F.col("event_id") % 5).cast("long").alias("importance"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "OUTLET ").otherwise("Outlet "), (F.col("user_id") % 40).cast("string")).alias("source"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("Author "), (F.col("user_id") % 25).cast("string"))).alias("author"),
        F.when(F.col("event_id") % 10 != 0, ts).alias("published_at"), (ts + F.expr("interval 2 hours")).alias("seen_at"), "user_id",
    )
    rows = rows.withColumn("at", F.coalesce("published_at", "seen_at"))
    return rows.withColumn("day", local_day(F.col("at")))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets that carried a story: item_id, pos, outlet, author. Only every third story has rows."""
    s = stories(spark, sf_dir).where("id % 3 = 0")
    more = F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(7)))
    return s.select("id", "user_id", "author", more.alias("pos", "step")).select(
        F.col("id").alias("item_id"), "pos", F.concat(F.lit("Outlet "), ((F.col("user_id") + F.col("step")) % 40).cast("string")).alias("outlet"),
        F.when(F.col("pos") == 0, F.col("author")).alias("author"),
    )


#: The same views in SQL, for the oracles.
SQL = """
k AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
stories AS (
  SELECT *, CAST(timezone('Africa/Cairo', timezone('UTC', "at")) AS DATE) AS day FROM (
    SELECT *, coalesce(published_at, seen_at) AS "at" FROM (
      SELECT event_id AS id, user_id,
        CASE user_id % 5 WHEN 0 THEN 'home' WHEN 1 THEN 'rival_a' WHEN 2 THEN 'rival_b' WHEN 3 THEN 'rival_c' ELSE 'other' END AS brand,
        CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('purchase', 'signup') THEN 'positive' ELSE 'neutral' END AS sentiment,
        'cat' || CAST(k % 6 AS VARCHAR) AS category, CAST(1 + event_id % 5 AS BIGINT) AS importance,
        CASE WHEN event_id % 2 = 0 THEN 'OUTLET ' ELSE 'Outlet ' END || CAST(user_id % 40 AS VARCHAR) AS source,
        CASE WHEN event_id % 7 <> 0 THEN 'Author ' || CAST(user_id % 25 AS VARCHAR) END AS author,
        CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS TIMESTAMP) END AS published_at, CAST(ts AS TIMESTAMP) + INTERVAL 2 HOUR AS seen_at
      FROM k)))
, instances AS (
  SELECT id AS item_id, pos, 'Outlet ' || CAST((user_id + step) % 40 AS VARCHAR) AS outlet, CASE WHEN pos = 0 THEN author END AS author
  FROM stories, (VALUES (0, 0), (1, 1), (2, 7)) AS v(pos, step) WHERE id % 3 = 0)
"""
