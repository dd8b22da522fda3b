"""Queries of the ingest chain and of the board, with their SQL. They bind documents, events and customers as the registry does."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.functions import text as T
from coverwell.operators import board, dedupe, filters, health, ingest, trends
from coverwell.operators.meeting import hashed
from coverwell.plans.registry import _CARRIED, _NORMAL, _TOKENS, ORACLES, _board_sql, query
from coverwell.sources import tables as S
from coverwell.sources.staging import staged
from coverwell.sources.tables import BRANDS, HOME, NOW, table


def _items(spark, sf_dir) -> DataFrame:
    """Documents as items of a run: the text is headline and summary, the language the block."""
    d = table(spark, sf_dir, "documents")
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 100).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), T.content_hash(F.col("text")).alias("hash"), F.col("text").alias("headline"), "source", F.col("lang").alias("block"),
        T.tokens(F.col("text")).alias("toks"), (F.col("doc_id") % 3).cast("int").alias("tier"), (1 + F.col("doc_id") % 5).cast("long").alias("importance"),
        F.when(F.col("doc_id") % 10 != 0, F.lit(NOW).cast("timestamp_ntz") - hours).alias("published_at"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://a.example/"), (F.col("doc_id") % 50).cast("string"))).alias("url"),
        F.lit(None).cast("string").alias("author"),
    ).withColumn("summary_hash", F.when(F.col("id") % 6 != 0, F.col("hash")))


_ITEMS = rf"""
i AS MATERIALIZED (SELECT doc_id AS id, sha256({_NORMAL}) AS hash, text AS headline, source, lang AS block, {_TOKENS} AS toks, CAST(doc_id % 3 AS INT) AS tier,
  CAST(1 + doc_id % 5 AS BIGINT) AS importance, CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 100 AS INT)) END AS published_at,
  CASE WHEN doc_id % 7 <> 0 THEN 'https://a.example/' || CAST(doc_id % 50 AS VARCHAR) END AS url FROM documents)
"""


def _clusters_sql(least: float, block: str) -> str:
    """Greedy leader clusters one row after the other; the leaders so far are the state."""
    return f"""WITH RECURSIVE {_ITEMS},
links AS MATERIALIZED (SELECT b.id, list(a.id) AS before FROM i a JOIN i b ON a.id < b.id AND len(a.toks) > 0 AND len(b.toks) > 0 {block}
  AND len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) >= {least} GROUP BY b.id),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i.id) AS n, i.id, coalesce(before, []) AS before FROM i LEFT JOIN links USING (id)),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
  UNION ALL SELECT n, id, coalesce(found, id), CASE WHEN found IS NULL THEN list_append(leaders, id) ELSE leaders END
  FROM (SELECT o.n, o.id, r.leaders, list_min(list_filter(o.before, lambda x: list_contains(r.leaders, x))) AS found FROM r JOIN o ON o.n = r.n + 1)),
c AS (SELECT id, leader FROM r WHERE n > 0)
"""


ORACLES["headline_clusters"] = _clusters_sql(0.55, "AND a.block = b.block") + "SELECT * FROM c"
ORACLES["summary_clusters"] = _clusters_sql(0.5, "") + "SELECT * FROM c"


def _cards_sql(order: str, clusters: str) -> str:
    return f"""{clusters},
m AS (SELECT i.*, leader AS card, row_number() OVER (PARTITION BY leader ORDER BY {order}) AS k FROM i JOIN c USING (id)),
w AS (SELECT card, max(id) FILTER (k = 1) AS id, max(source) FILTER (k = 1) AS source, count(*) AS n, count(DISTINCT source) FILTER (k > 1) AS more FROM m GROUP BY card)
SELECT card, id, n, more, CASE WHEN more > 0 THEN source || ' + ' || CAST(more AS VARCHAR) || ' more' ELSE source END AS shown FROM w"""


def _members(spark, sf_dir, least: float, blocked: bool) -> DataFrame:
    items = _items(spark, sf_dir)
    found = dedupe.leader_clusters(items.select("id", "toks", "block"), least, blocked, staged)
    return items.join(found.withColumnRenamed("leader", "card"), "id")


_NEWEST = "coalesce(published_at, TIMESTAMP '1970-01-01') DESC, id"


@query(_cards_sql(f"CASE WHEN tier = 0 THEN 9 ELSE tier END, {_NEWEST}", _clusters_sql(0.55, "AND a.block = b.block")), views=False)
def headline_cards(spark, sf_dir):
    return ingest.cards(_members(spark, sf_dir, 0.55, True), ingest.headline_order()).select("card", "id", "n", "more", "shown")


@query(_cards_sql(f"importance DESC, {_NEWEST}", _clusters_sql(0.5, "")), views=False)
def summary_cards(spark, sf_dir):
    return ingest.cards(_members(spark, sf_dir, 0.5, False), ingest.summary_order(), named_only=True).select("card", "id", "n", "more", "shown")


@query(f"""{_clusters_sql(0.55, "AND a.block = b.block")}
SELECT card, id, outlet, url FROM (SELECT leader AS card, id, source AS outlet, coalesce(url, '') AS url,
  row_number() OVER (PARTITION BY leader, coalesce(url, source || '|' || headline) ORDER BY id) AS k FROM i JOIN c USING (id)) WHERE k = 1""", views=False)
def card_instances(spark, sf_dir):
    return ingest.card_instances(_members(spark, sf_dir, 0.55, True), [F.col("id")]).select("card", "id", "outlet", "url")


@query(f"WITH {_ITEMS} SELECT min(id) AS id FROM i GROUP BY CASE WHEN id % 6 <> 0 THEN hash ELSE 'nosum-' || hash END", views=False)
def summary_first(spark, sf_dir):
    return ingest.summary_first(_items(spark, sf_dir), [F.col("id")]).select("id")


_STORED = "s AS (SELECT * FROM i WHERE source = (SELECT min(source) FROM documents))"


def _stored(items: DataFrame) -> DataFrame:
    """The items of the first source stand for what is stored already."""
    least = items.agg(F.min("source").alias("_least"))
    return items.join(F.broadcast(least), F.col("source") == F.col("_least")).drop("_least")


@query(f"WITH {_ITEMS}, {_STORED} SELECT i.id, k.hash IS NOT NULL AS seen, k.id AS into_id FROM i LEFT JOIN (SELECT hash, min(id) AS id FROM s GROUP BY hash) k ON i.hash = k.hash", views=False)
def crossrun_exact(spark, sf_dir):
    items = _items(spark, sf_dir)
    return ingest.crossrun_exact(items, _stored(items))


_INTO = f"""WITH {_ITEMS}, {_STORED},
h AS (SELECT hash, min(id) AS id FROM s WHERE id % 6 <> 0 GROUP BY hash),
p AS (SELECT i.id, min(s.id) AS match FROM i JOIN s ON len(i.toks) > 0 AND len(s.toks) > 0
  AND len(list_intersect(i.toks, s.toks)) / (len(i.toks) + len(s.toks) - len(list_intersect(i.toks, s.toks))) >= 0.5 GROUP BY i.id),
t AS (SELECT i.id, coalesce(h.id, p.match) AS into_id FROM i LEFT JOIN h ON i.id % 6 <> 0 AND i.hash = h.hash LEFT JOIN p ON p.id = i.id)
"""


def _into(spark, sf_dir) -> DataFrame:
    items = staged(_items(spark, sf_dir).select("id", "summary_hash", "source", hashed(F.col("toks")).alias("toks")))  # words are cut once
    return ingest.crossrun_summary(items, _stored(items).withColumn("pos", F.col("id")))


@query(_INTO + "SELECT * FROM t", views=False)
def crossrun_summary(spark, sf_dir):
    return _into(spark, sf_dir)


@query(_INTO + """,
cov AS (SELECT id AS item_id, source AS outlet, url FROM s WHERE id % 2 = 0),
moved AS (SELECT into_id AS item_id, source AS outlet, coalesce(url, '') AS url, row_number() OVER (PARTITION BY into_id, coalesce(url, '') ORDER BY id) AS k FROM t JOIN i USING (id)
  WHERE into_id IS NOT NULL)
SELECT item_id, outlet, url FROM cov UNION ALL
SELECT item_id, outlet, url FROM moved m WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.item_id = m.item_id AND cov.url = m.url) AND k = 1""", views=False)
def attach_merged(spark, sf_dir):
    items = _items(spark, sf_dir)
    known = _stored(items).where("id % 2 = 0").select(F.col("id").alias("item_id"), F.col("source").alias("outlet"), "author", "url")
    own = ingest.card_instances(items.withColumn("card", F.col("id")), [F.col("id")])
    return ingest.attach_merged(known, _into(spark, sf_dir), own).select("item_id", "outlet", "url")


@query("""
, own AS (SELECT item_id, outlet, 'u' || CAST(pos AS VARCHAR) || outlet AS url FROM instances),
pairs AS (SELECT id AS drop_id, id - 3 AS keep_id FROM stories WHERE id % 30 IN (6, 7)),
moved AS (SELECT keep_id AS item_id, drop_id, outlet, url FROM pairs JOIN own ON item_id = drop_id
  UNION ALL SELECT keep_id, drop_id, source, 's' || CAST(user_id AS VARCHAR) FROM pairs JOIN stories ON id = drop_id WHERE drop_id NOT IN (SELECT item_id FROM own))
SELECT item_id, outlet, url FROM own UNION ALL
SELECT item_id, outlet, url FROM (SELECT *, row_number() OVER (PARTITION BY item_id, url ORDER BY drop_id, outlet) AS k FROM moved m
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.item_id = m.item_id AND own.url = m.url)) WHERE k = 1""")
def merge_duplicates(spark, sf_dir):
    rows = S.stories(spark, sf_dir).withColumns({"is_relevant": F.lit(True), "url": F.concat(F.lit("s"), F.col("user_id").cast("string"))})
    cov = S.coverage(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), F.col("pos").cast("string"), F.col("outlet")))
    pairs = rows.where("id % 30 in (6, 7)").select(F.col("id").alias("drop_id"), (F.col("id") - 3).alias("keep_id"))
    return ingest.merge_duplicates(rows, cov, pairs)[1].select("item_id", "outlet", "url")


@query("""
, run AS (SELECT * FROM stories WHERE id % 3 = 0), base AS (SELECT * FROM stories WHERE id % 2 = 0 AND seen_at >= TIMESTAMP '2024-01-30' AND importance >= 2),
d AS (SELECT * FROM base UNION ALL SELECT * FROM run WHERE id % 100 NOT IN (SELECT id % 100 FROM base))
SELECT count(*) AS stories, count(*) FILTER (sentiment = 'negative') AS negatives, count(*) FILTER (importance >= 4) AS high FROM d WHERE id % 5 <> 0""")
def digest_merge(spark, sf_dir):
    rows = S.stories(spark, sf_dir).withColumns({"is_relevant": F.col("id") % 2 == 0, "hash": F.col("id") % 100})
    merged = ingest.digest_merge(rows, rows.where("id % 3 = 0"), NOW, rows.where("id % 5 = 0").select("id"))
    return ingest.subject_counts(merged)


@query(r"""
WITH n AS (SELECT regexp_replace(c_name || '-555', '[^0-9]', '', 'g') AS number FROM customer UNION ALL SELECT regexp_replace(s_name, '[^0-9]', '', 'g') FROM supplier)
SELECT DISTINCT number FROM n WHERE length(number) >= 8""", views=False)
def recipients(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("-555")).alias("number"))
    return ingest.recipients(c, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("number")))


@query("SELECT c_custkey AS id, coalesce(o_orderpriority, '(no headline)') AS headline FROM customer LEFT JOIN orders ON o_orderkey = c_custkey", views=False)
def top_story_headlines(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("headline"))
    return ingest.with_headlines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), heads, F.lit("(no headline)"))


def _flagged(spark, sf_dir) -> DataFrame:
    return S.stories(spark, sf_dir).withColumns({"is_relevant": F.col("id") % 4 != 0, "pinned": F.col("id") % 11 == 0})


@query("""SELECT id, importance FROM stories WHERE id % 4 <> 0 AND coalesce(published_at, seen_at) >= TIMESTAMP '2024-01-24'
ORDER BY importance DESC, published_at DESC NULLS LAST, seen_at DESC, id LIMIT 200""")
def board_scan(spark, sf_dir):
    return board.board(_flagged(spark, sf_dir), NOW).select("id", "importance")


@query("SELECT id, source FROM stories WHERE id IN (3, 14, 159)")
def by_ids(spark, sf_dir):
    return board.by_ids(S.stories(spark, sf_dir), ["3", 14, "x", " 159 ", "-2", "1.5"]).select("id", "source")


@query("""SELECT CASE WHEN brand = 'home' THEN sentiment ELSE 'neutral' END AS lane, count(*) AS n FROM stories GROUP BY 1""")
def lanes(spark, sf_dir):
    return board.lanes(S.stories(spark, sf_dir), HOME)


@query("SELECT brand, count(*) AS n FROM stories WHERE sentiment = 'positive' GROUP BY brand")
def brand_wins(spark, sf_dir):
    return board.wins(S.stories(spark, sf_dir))


@query("""SELECT id, importance FROM stories WHERE brand = 'home' AND sentiment = 'negative' ORDER BY importance DESC, "at" DESC, id LIMIT 1""")
def hero_story(spark, sf_dir):
    return board.hero(S.stories(spark, sf_dir), HOME).select("id", "importance")


@query("SELECT id, CASE WHEN user_id % 5 = 4 THEN 'other' ELSE brand END AS brand, CASE WHEN id % 13 = 0 THEN 'neutral' ELSE sentiment END AS sentiment FROM stories")
def normalised(spark, sf_dir):
    rows = S.stories(spark, sf_dir).withColumns({"sentiment": F.when(F.col("id") % 13 != 0, F.col("sentiment")), "brand": F.nullif("brand", F.lit("other"))})
    return rows.select("id", board.brand_of(BRANDS).alias("brand"), board.sentiment_of().alias("sentiment"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 0", views=False)
def parked_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("lang") == "en", "unclassified").alias("category"), (F.col("doc_id") % 3).alias("confidence"), F.lit(None).cast("string").alias("summary"))
    return rows.where(board.parked()).select("doc_id")


@query("SELECT id, importance FROM stories WHERE id % 4 <> 0 AND author IS NULL ORDER BY importance DESC, seen_at DESC, id LIMIT 50")
def missing_author(spark, sf_dir):
    return board.missing_author(_flagged(spark, sf_dir), 50).select("id", "importance")


@query("""SELECT id FROM stories s WHERE id % 11 = 0 AND sentiment = 'neutral'
AND EXISTS (SELECT 1 FROM instances i WHERE i.item_id = s.id AND lower(trim(outlet)) = 'outlet 3')""")
def board_filters(spark, sf_dir):
    return board.chosen(_flagged(spark, sf_dir), S.coverage(spark, sf_dir), outlet=" OUTLET 3", pinned=True, sentiment="neutral").select("id")


@query("""
WITH h AS (SELECT event_type || user_id AS feed_id, max(CAST(ts AS TIMESTAMP)) FILTER (event_id % 7 = 0) AS last_ok_at FROM events GROUP BY 1)
SELECT feed_id, last_ok_at FROM h WHERE (last_ok_at IS NULL OR last_ok_at < TIMESTAMP '2024-01-28') AND feed_id NOT LIKE 'click%'""", views=False)
def broken_feeds(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    e = e.withColumn("feed_id", F.concat("event_type", F.col("user_id").cast("string")))
    health = e.groupBy("feed_id").agg(F.max(F.when(F.col("event_id") % 7 == 0, F.col("at"))).alias("last_ok_at"))
    return board.broken_feeds(health, e.where("event_type <> 'click'").select("feed_id"), NOW)


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier WHERE s_nationkey % 2 = 0""", views=False)
def pending_queue(spark, sf_dir):
    return board.queue(table(spark, sf_dir, "supplier"), F.col("s_nationkey") % 2 == 0, F.col("s_acctbal"), F.col("s_suppkey"), stage=staged).select("s_suppkey", "place")


@query("""SELECT least(count(*), 100) AS n FROM events WHERE event_type = 'error' AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-20'
AND (user_id = 7 OR event_id % 50 = 3)""", views=False)
def failed_signins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "login_failed").alias("action"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("user_id").cast("string").alias("email"), (F.col("event_id") % 50).cast("string").alias("ip"),
    )
    return board.failed_signins(e, "7", "3", datetime(2024, 1, 20))


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS line, CAST(DATE '2001-09-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS age_days
FROM orders WHERE DATE '2001-09-01' - CAST(o_orderdate AS DATE) > 45""", views=False)
def stale_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("a note\r\n ["), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("] "), F.col("o_orderpriority"), F.lit("\n(2001-02-30) no day"))
    return board.stale_lines(o.select(F.col("o_orderkey").alias("id"), line.alias("content")), datetime(2001, 9, 1)).drop("pos")


_CALLOUTS = (
    _CARRIED
    + _board_sql("outlet", "outlet", "outlet <> ''").replace("once AS", "once_o AS").replace("FROM once", "FROM once_o").replace("board AS", "board_o AS")
    + _board_sql("byline", "author", "byline IS NOT NULL").replace("once AS", "once_a AS").replace("FROM once", "FROM once_a").replace("board AS", "board_a AS")
)


@query(f"""{_CALLOUTS}
, cats AS (SELECT category, count(*) FILTER (sentiment = 'negative') AS n FROM stories GROUP BY category)
(SELECT 'outlet' AS kind, outlet AS name, home_negative AS n, CAST(NULL AS BIGINT) AS share FROM board_o WHERE home_negative >= 2 ORDER BY home_negative DESC, key LIMIT 1)
UNION ALL (SELECT 'author', author, home_negative, NULL FROM board_a WHERE home_negative >= 2 ORDER BY home_negative DESC, key LIMIT 1)
UNION ALL (SELECT 'category', category, n, CAST(floor(100.0 * n / (SELECT greatest(sum(n), 1) FROM cats) + 0.5) AS BIGINT) FROM cats WHERE n > 0 ORDER BY n DESC, category LIMIT 1)""")
def callouts(spark, sf_dir):
    rows = trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir))
    return board.callouts(trends.outlet_leaderboard(rows, HOME), trends.author_leaderboard(rows, HOME), trends.category_board(S.stories(spark, sf_dir), HOME))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'hidden' WHEN NOT (importance >= 4 OR (brand <> 'other' AND sentiment = 'negative')) THEN 'not-qualifying'
WHEN id % 9 = 0 THEN 'already-sent' ELSE 'ok' END AS verdict FROM stories""")
def manual_alert(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return board.manual_alert(rows, rows.where("id % 9 = 0"), filters.instant_alert(BRANDS))


@query("""SELECT p_brand AS channel, CASE WHEN max(CASE WHEN p_size = 50 THEN 1 ELSE 0 END) = 1 THEN 'warn' WHEN max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) = 1 THEN 'unknown' ELSE 'ok' END AS state
FROM part GROUP BY p_brand""", views=False)
def channel_states(spark, sf_dir):
    state = F.when(F.col("p_size") == 50, "missing").when(F.col("p_size") > 45, "unknown").otherwise("ok")
    return board.channel_state(table(spark, sf_dir, "part").select(F.col("p_brand").alias("channel"), F.lit(True).alias("live"), state.alias("state")))


@query("""SELECT count(*) AS stored, count(*) FILTER (id % 4 <> 0) AS relevant FROM stories
WHERE seen_at BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31'""")
def ingest_volume(spark, sf_dir):
    return health.ingest_volume(_flagged(spark, sf_dir), NOW)


@query("""
WITH m AS (SELECT count(*) AS calls, coalesce(round(sum(value), 6), 0.0) AS spent FROM events
  WHERE CAST(ts AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20')
SELECT calls, spent, round(spent / 20 * 31, 4) AS projected,
  CASE WHEN calls = 0 THEN 'unknown' WHEN spent >= 40000 THEN 'crit' WHEN spent / 20 * 31 > 40000 THEN 'warn' ELSE 'ok' END AS state FROM m""", views=False)
def month_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("value").alias("cost"))
    return health.month_projection(e, datetime(2024, 1, 20), 40_000.0)
