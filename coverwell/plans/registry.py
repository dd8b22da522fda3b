"""Named queries over the driver's tables, and the SQL that each is compared with.

The story, coverage and ledger views are bindings of the driver's tables to the records that
the operators expect; both sides use the same expressions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.functions import text as T
from coverwell.operators import dedupe, filters, health, ledger, narratives, reports, runs, surge, trends
from coverwell.sources import feeds
from coverwell.sources import tables as S
from coverwell.sources.staging import staged
from coverwell.sources.tables import BRANDS, HOME, NOW, table
from coverwell.streaming import stream

QUERIES = {}
ORACLES = {}
FIRST, LAST = date(2024, 1, 1), date(2024, 1, 31)
RANGE = (date(2024, 1, 17), date(2024, 1, 31))
BRANDS_SQL = "(VALUES ('home'), ('rival_a'), ('rival_b'), ('rival_c'), ('other')) AS b(brand)"
AXIS_SQL = "axis AS (SELECT idx, DATE '2024-01-01' + CAST(idx AS INTEGER) AS day FROM range(31) AS r(idx))"
ALL_BRANDS = (*BRANDS, "other")


def query(sql: str | None = None, views: bool = True):
    """Registers a query under its name with its SQL; ``views`` puts the story views before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {S.SQL}{sql}" if views else sql
        return f

    return add


def days(frame: DataFrame) -> DataFrame:
    return trends.axis(frame, FIRST, LAST)


@query("""
SELECT count(*) AS items, count(*) FILTER (sentiment = 'negative') AS negatives, count(*) FILTER (sentiment = 'positive') AS positives,
  count(*) FILTER (sentiment NOT IN ('negative', 'positive')) AS neutrals, count(*) FILTER (brand = 'home') AS home_mentions,
  count(*) FILTER (brand = 'home' AND sentiment = 'negative') AS home_negatives FROM stories""")
def totals(spark, sf_dir):
    return trends.totals(S.stories(spark, sf_dir), HOME)


@query(f""", {AXIS_SQL}
SELECT b.brand, a.idx, a.day, count(s.id) AS mentions, count(*) FILTER (s.sentiment = 'negative') AS negatives
FROM {BRANDS_SQL} CROSS JOIN axis a LEFT JOIN stories s ON s.brand = b.brand AND s.day = a.day GROUP BY ALL""")
def sov_daily(spark, sf_dir):
    rows = S.stories(spark, sf_dir)
    return trends.share_of_voice(rows, days(rows), ALL_BRANDS)


@query("""
SELECT brand, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (sentiment = 'positive') AS positive, count(*) AS total FROM stories GROUP BY brand""")
def sentiment_matrix(spark, sf_dir):
    return trends.sentiment_matrix(S.stories(spark, sf_dir))


@query("""
SELECT category, count(*) AS total, count(*) FILTER (sentiment = 'negative') AS negative,
  count(*) FILTER (sentiment = 'negative' AND brand = 'home') AS home_negative FROM stories GROUP BY category""")
def category_board(spark, sf_dir):
    return trends.category_board(S.stories(spark, sf_dir), HOME)


_CARRIED = """
, carried AS (
  SELECT s.id, s.sentiment, s.brand, coalesce(i.pos, 0) AS pos, CASE WHEN i.item_id IS NULL THEN s.source ELSE i.outlet END AS outlet,
    CASE WHEN i.item_id IS NULL THEN s.author ELSE i.author END AS byline
  FROM stories s LEFT JOIN instances i ON i.item_id = s.id)
"""


def _board_sql(key: str, shown: str, where: str) -> str:
    return f"""
, once AS (SELECT * FROM (
    SELECT *, lower(trim({key})) AS key, row_number() OVER (PARTITION BY lower(trim({key})), id ORDER BY pos, {key}, outlet) AS n
    FROM carried WHERE {where}) WHERE n = 1)
, board AS (
  SELECT key, arg_min({key}, id) AS {shown}, count(*) AS mentions, count(*) FILTER (sentiment = 'negative') AS negative,
    count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'negative' AND brand = 'home') AS home_negative
  FROM once GROUP BY key ORDER BY home_negative DESC, negative DESC, mentions DESC, key LIMIT 300)
"""


@query(_CARRIED + _board_sql("outlet", "outlet", "outlet <> ''") + "SELECT * FROM board")
def outlet_leaderboard(spark, sf_dir):
    return trends.outlet_leaderboard(trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir)), HOME)


@query(_CARRIED + _board_sql("byline", "author", "byline IS NOT NULL") + """
, seen AS (SELECT lower(trim(byline)) AS key, outlet, min(id * 10 + pos) AS first_at FROM carried WHERE byline IS NOT NULL GROUP BY ALL)
, top3 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_at, outlet) AS n FROM seen)
SELECT board.*, o.outlets FROM board JOIN (
  SELECT key, string_agg(outlet, '|' ORDER BY n) AS outlets FROM top3 WHERE n <= 3 GROUP BY key) o USING (key)""")
def author_leaderboard(spark, sf_dir):
    return trends.author_leaderboard(trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir)), HOME)


@query(_CARRIED + """
SELECT count(DISTINCT lower(trim(outlet))) AS outlets, count(DISTINCT lower(trim(byline))) AS authors,
  count(DISTINCT id) FILTER (byline IS NOT NULL) AS signed_stories FROM carried""")
def byline_coverage(spark, sf_dir):
    return trends.byline_coverage(trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir)))


@query(f""", {AXIS_SQL}
, daily AS (SELECT b.brand, a.idx, count(*) FILTER (s.sentiment = 'negative') AS negatives
  FROM {BRANDS_SQL} CROSS JOIN axis a LEFT JOIN stories s ON s.brand = b.brand AND s.day = a.day GROUP BY ALL)
, halves AS (SELECT brand, CAST(sum(CASE WHEN idx < 15 THEN negatives ELSE 0 END) AS BIGINT) AS before,
  CAST(sum(CASE WHEN idx >= 16 THEN negatives ELSE 0 END) AS BIGINT) AS after FROM daily GROUP BY brand)
SELECT *, CASE WHEN before > 0 THEN CAST(floor(100.0 * (after - before) / before + 0.5) AS BIGINT) END AS change_pct FROM halves""")
def half_movement(spark, sf_dir):
    rows = S.stories(spark, sf_dir)
    return trends.half_movement(trends.share_of_voice(rows, days(rows), ALL_BRANDS), 31)


_PERIODS = """
, p AS (SELECT *, day >= DATE '2024-01-17' AS now FROM stories WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-31')
"""


@query(_PERIODS + """
, g AS (SELECT brand, count(*) FILTER (now) AS now, count(*) FILTER (NOT now) AS before,
  count(*) FILTER (now AND sentiment = 'negative') AS negative_now, count(*) FILTER (NOT now AND sentiment = 'negative') AS negative_before FROM p GROUP BY brand)
SELECT *, CAST(floor(100.0 * now / greatest(sum(now) OVER (), 1) + 0.5) AS BIGINT) AS share_now,
  CAST(floor(100.0 * before / greatest(sum(before) OVER (), 1) + 0.5) AS BIGINT) AS share_before FROM g""")
def period_compare(spark, sf_dir):
    return reports.period_compare(reports.periods(S.stories(spark, sf_dir), *RANGE))


@query(_PERIODS + """
SELECT category, count(*) FILTER (now) AS now, count(*) FILTER (NOT now) AS before,
  count(*) FILTER (now) - count(*) FILTER (NOT now) AS change FROM p GROUP BY category""")
def category_movement(spark, sf_dir):
    return reports.category_movement(reports.periods(S.stories(spark, sf_dir), *RANGE))


@query(_PERIODS + """
(SELECT id, sentiment, importance, category, source FROM p WHERE now AND brand = 'home' AND sentiment = 'negative' ORDER BY importance DESC, id LIMIT 6)
UNION ALL
(SELECT id, sentiment, importance, category, source FROM p WHERE now AND brand = 'home' AND sentiment = 'positive' ORDER BY importance DESC, id LIMIT 4)""")
def spotlights(spark, sf_dir):
    return reports.spotlights(reports.periods(S.stories(spark, sf_dir), *RANGE), HOME)


@query(_PERIODS + 'SELECT brand, id, "at", source, sentiment, importance FROM p WHERE now ORDER BY "at" DESC, id LIMIT 400')
def coverage_log(spark, sf_dir):
    return reports.coverage_log(reports.periods(S.stories(spark, sf_dir), *RANGE))


_WEIGHTED = """
, weighted AS (SELECT s.*, greatest(coalesce(n, 1), 1) AS weight FROM stories s
  LEFT JOIN (SELECT item_id, count(*) AS n FROM instances GROUP BY item_id) i ON i.item_id = s.id WHERE sentiment = 'negative')
"""
_JUDGED = """floor(mean * 10 + 0.5) / 10 AS mean1, floor(stddev * 10 + 0.5) / 10 AS stddev1, floor((mean + 2 * stddev) * 10 + 0.5) / 10 AS threshold1,
  floor(v / greatest(mean, 1.0) * 10 + 0.5) / 10 AS multiple, v >= 4 AND v > mean AND v >= mean + 2 * stddev AS fires"""


@query(f"""{_WEIGHTED}, {AXIS_SQL}
, daily AS (SELECT b.brand, a.idx, a.day, CAST(coalesce(sum(w.weight), 0) AS BIGINT) AS v
  FROM {BRANDS_SQL} CROSS JOIN axis a LEFT JOIN weighted w ON w.brand = b.brand AND w.day = a.day GROUP BY ALL)
, t AS (SELECT *, avg(v) OVER past AS mean, stddev_pop(v) OVER past AS stddev FROM daily
  WINDOW past AS (PARTITION BY brand ORDER BY idx ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))
SELECT brand, day, v, {_JUDGED} FROM t WHERE idx >= 21""")
def surge_calendar(spark, sf_dir):
    rows = surge.weighted(S.stories(spark, sf_dir), S.coverage(spark, sf_dir))
    return surge.trailing(surge.calendar_series(rows, days(rows), ALL_BRANDS))


@query(f"""{_WEIGHTED}
, aged AS (SELECT brand, weight, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us("at")) / 86400000000) AS BIGINT) AS bucket FROM weighted)
, by_bucket AS (SELECT brand, bucket, sum(weight) AS w FROM aged WHERE bucket BETWEEN 0 AND 21 GROUP BY ALL)
, s AS (SELECT brand, CAST(coalesce(sum(w) FILTER (bucket = 0), 0) AS BIGINT) AS v, coalesce(sum(w) FILTER (bucket > 0), 0) AS s,
  coalesce(sum(w * w) FILTER (bucket > 0), 0) AS s2 FROM by_bucket GROUP BY brand)
, t AS (SELECT *, s / 21.0 AS mean, sqrt(greatest(s2 / 21.0 - (s / 21.0) * (s / 21.0), 0)) AS stddev FROM s)
SELECT brand, v, {_JUDGED} FROM t""")
def surge_rolling(spark, sf_dir):
    return surge.rolling(surge.weighted(S.stories(spark, sf_dir), S.coverage(spark, sf_dir)), NOW, ALL_BRANDS)


@query(f"""{_WEIGHTED}
SELECT brand, rank, id, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY weight DESC, id) AS rank FROM weighted WHERE day = DATE '2024-01-30') WHERE rank <= 3""")
def surge_top_stories(spark, sf_dir):
    rows = surge.weighted(S.stories(spark, sf_dir), S.coverage(spark, sf_dir))
    return surge.top_stories(rows, date(2024, 1, 30)).withColumn("rank", F.col("rank").cast("long"))


_NORMAL = "trim(regexp_replace(lower(text), '[^a-z0-9\\x{0600}-\\x{06ff} ]', '', 'g'))"
ORACLES["content_hash"] = f"SELECT doc_id, sha256({_NORMAL}) AS hash FROM documents"


@query()
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT min(doc_id) AS doc_id, sha256({_NORMAL}) AS hash FROM documents GROUP BY 2", views=False)
def exact_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return dedupe.first_wins(docs, F.col("hash"), [F.col("doc_id")])


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_GATE_SQL = "[" + ", ".join(f"'{w}'" for w in T.GATE_STOPWORDS) + "]"
_PHRASE_SQL = "[" + ", ".join(f"'{w}'" for w in T.PHRASE_STOPWORDS) + "]"
_TOKENS = rf"""list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9_ \t\n\x0B\f\r\x{{0600}}-\x{{06ff}}]', ' ', 'g'),
  '[ \t\n\x0B\f\r]+'), lambda t: length(t) >= 4 AND NOT list_contains({_STOP_SQL}, t)))"""
_GATE_WORDS = r"string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{0600}-\x{06ff} ]', ' ', 'g'), ' +')"


def _doc_tokens(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return docs.select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("toks"), at.alias("at"), F.col("lang").alias("block"))


@query(rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS toks, TIMESTAMP '2024-01-31' + to_hours(CAST(doc_id AS INTEGER)) AS "at" FROM documents),
p AS (SELECT a.doc_id AS keep, b.doc_id AS drop, len(list_intersect(a.toks, b.toks)) AS n, len(a.toks) AS la, len(b.toks) AS lb
  FROM d a JOIN d b ON a.doc_id < b.doc_id AND b."at" - a."at" <= INTERVAL 5 DAY AND len(a.toks) > 0 AND len(b.toks) > 0)
SELECT keep, drop, floor(n / (la + lb - n) * 100 + 0.5) / 100 AS score, CASE WHEN n / (la + lb - n) >= 0.55 THEN 'lexical' ELSE 'semantic' END AS band
FROM p WHERE n / (la + lb - n) >= 0.5""", views=False)
def jaccard_pairs(spark, sf_dir):
    return dedupe.duplicate_pairs(_doc_tokens(spark, sf_dir), least=0.5, most=None, stage=staged)


@query(rf"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS toks FROM documents), b AS (SELECT item_id, {_TOKENS} AS toks FROM benchmark),
p AS (SELECT id, item_id, len(list_intersect(d.toks, b.toks)) AS n, len(d.toks) AS la, len(b.toks) AS lb FROM d, b WHERE len(d.toks) > 0 AND len(b.toks) > 0)
SELECT d.id, min(item_id) FILTER (n / (la + lb - n) >= 0.1) AS match FROM d LEFT JOIN p USING (id) GROUP BY d.id""", views=False)
def crossrun_match(spark, sf_dir):
    new = _doc_tokens(spark, sf_dir).select("id", "toks", F.lit("all").alias("block"))
    pool = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("toks"), F.lit("all").alias("block"), F.col("item_id").alias("pos")
    )
    return dedupe.crossrun_match(new, pool, least=0.1)


def _gate_rows(spark, sf_dir, name: str, key: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")
    toks = T.gate_tokens(F.col("text"))
    return rows.select("id", toks.alias("toks"), T.phrases(F.col("text")).alias("pairs")).withColumn("strong", T.strong_tokens(F.col("toks")))


@query(rf"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, {_GATE_WORDS} AS ws FROM documents UNION ALL SELECT 'b', item_id, {_GATE_WORDS} FROM benchmark),
t AS (SELECT side, id, list_distinct(list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({_GATE_SQL}, x))) AS toks,
  list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({_PHRASE_SQL}, x)) AS pw FROM w),
r AS (SELECT side, id, toks, list_filter(toks, lambda x: length(x) >= 5) AS strong,
  list_distinct([pw[i] || ' ' || pw[i + 1] FOR i IN range(1, len(pw))]) AS pairs FROM t),
p AS (SELECT a.id, b.id AS match, len(list_intersect(a.toks, b.toks)) AS n, len(a.toks) AS la, len(b.toks) AS lb,
  len(list_intersect(a.strong, b.strong)) AS shared, len(list_intersect(a.pairs, b.pairs)) AS phrases FROM r a, r b WHERE a.side = 'b' AND b.side = 'd'),
q AS (SELECT *, CASE WHEN la = 0 OR lb = 0 THEN 0 ELSE n / (la + lb - n) END AS j FROM p),
s AS (SELECT *, greatest(j, shared / 3.0, phrases / 3.0) AS score FROM q WHERE j < 0.5 AND n > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS k FROM s WHERE score > 0)
SELECT id, match, round(score, 6) AS score FROM best WHERE k = 1 AND (j >= 0.12 OR shared >= 2 OR phrases >= 2)""", views=False)
def semantic_candidates(spark, sf_dir):
    return dedupe.gated_candidates(_gate_rows(spark, sf_dir, "benchmark", "item_id"), _gate_rows(spark, sf_dir, "documents", "doc_id"), most=None)


@query(ORACLES["semantic_candidates"].replace("a.side = 'b' AND b.side = 'd'", "a.side = 'd' AND b.side = 'b'"), views=False)
def semantic_candidates_documents(spark, sf_dir):
    """Documents as the new rows, matched against benchmark as the stored pool."""
    return dedupe.gated_candidates(_gate_rows(spark, sf_dir, "documents", "doc_id"), _gate_rows(spark, sf_dir, "benchmark", "item_id"), most=None)


@query()
def headline_clusters(spark, sf_dir):
    return dedupe.leader_clusters(_doc_tokens(spark, sf_dir), 0.55, True, staged)


@query()
def summary_clusters(spark, sf_dir):
    return dedupe.leader_clusters(_doc_tokens(spark, sf_dir), 0.5, False, staged)


@query("""
SELECT i.* FROM instances i WHERE item_id % 30 <> 6
UNION ALL
SELECT DISTINCT item_id - 3, pos, outlet, author FROM instances m WHERE item_id % 30 = 6
  AND NOT EXISTS (SELECT 1 FROM instances k WHERE k.item_id = m.item_id - 3 AND k.outlet = m.outlet)""")
def merge_instances(spark, sf_dir):
    cov = S.coverage(spark, sf_dir)
    drops = cov.where("item_id % 30 = 6").select(F.col("item_id").alias("pair"), F.col("item_id").alias("drop_id")).distinct()
    keeps = drops.select("pair", (F.col("pair") - 3).alias("keep_id"))
    return dedupe.merge_instances(keeps, drops, cov)


WORDS = ("purchase", "error")


@query("SELECT event_id FROM events WHERE event_id % 2 = 1 OR regexp_matches(event_type, '(?i)purchase|error')", views=False)
def prefilter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(filters.worth_reading(F.col("event_id") % 2 == 0, F.col("event_type"), WORDS)).select("event_id")


@query("SELECT id FROM stories WHERE published_at IS NULL OR published_at > TIMESTAMP '2024-01-29'")
def freshness(spark, sf_dir):
    return filters.fresh(S.stories(spark, sf_dir), NOW).select("id")


@query("""SELECT id, CASE WHEN importance >= 5 THEN 'URGENT' ELSE 'ALERT' END AS tier FROM stories
WHERE importance >= 4 OR (brand <> 'other' AND sentiment = 'negative')""")
def instant_alerts(spark, sf_dir):
    return S.stories(spark, sf_dir).where(filters.instant_alert(BRANDS)).select("id", filters.alert_tier().alias("tier"))


@query("SELECT id, importance FROM stories WHERE seen_at >= TIMESTAMP '2024-01-30' AND importance >= 2")
def digest(spark, sf_dir):
    return filters.digest(S.stories(spark, sf_dir), NOW).select("id", "importance")


@query("""
SELECT c_custkey AS subscriber, s.id FROM customer, stories s WHERE s.seen_at >= TIMESTAMP '2024-01-30' AND s.importance >= 2
  AND (c_custkey % 100 = 0 OR s.category = 'cat' || CAST(c_nationkey % 6 AS VARCHAR))""")
def subscriber_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    topics = F.when(F.col("c_custkey") % 100 != 0, F.array(F.concat(F.lit("cat"), (F.col("c_nationkey") % 6).cast("string"))))
    subs = c.select(F.col("c_custkey").alias("subscriber"), topics.alias("topics"))
    return filters.subscriber_items(subs, filters.digest(S.stories(spark, sf_dir), NOW))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/?#@]+([/?#]|$)') AND length(trim(url)) <= 2048 AND NOT regexp_matches(trim(url), '[\x00-\x1f\x7f-\x9f]') THEN trim(url) END AS safe,
  regexp_matches(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '(?i)(^|/)(tag|tags|keyword|keywords|category|categories|topic|topics|search|share)(/|$)')
    OR regexp_matches(url, '[?&](s|q|search)(=|&|#|$)') OR regexp_matches(url, '[?&][^&#]*=(\+|%2B|%2b)?[0-9]{11,15}(&|#|$)') AS non_article
FROM pages""", views=False)
def url_rules(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.safe_url(F.col("url")).alias("safe"), filters.non_article(F.col("url")).alias("non_article"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""", views=False)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def _runs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("job"), F.col("ts").cast("timestamp_ntz").alias("started_at"), (F.col("event_id") % 9 != 0).alias("ok"))


_RUNS = "WITH runs AS (SELECT event_id AS id, event_type AS job, CAST(ts AS TIMESTAMP) AS started_at, event_id % 9 <> 0 AS ok FROM events)"


@query(_RUNS + "SELECT job, id, started_at, ok FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started_at DESC, id DESC) AS n FROM runs) WHERE n = 1", views=False)
def latest_run(spark, sf_dir):
    return health.latest_run(_runs(spark, sf_dir))


LIMITS = {"view": 2.0, "click": 26.0, "purchase": 26.0, "signup": 192.0, "never": 192.0}


@query(_RUNS + """
SELECT l.job, l.lim AS "limit", CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(started_at))) / 3600000000) AS BIGINT) AS age_hours,
  CASE WHEN max(started_at) IS NULL THEN 'unknown' WHEN (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(started_at))) / 3600000000 > l.lim THEN 'warn' ELSE 'ok' END AS state
FROM (VALUES ('view', 2.0::DOUBLE), ('click', 26.0), ('purchase', 26.0), ('signup', 192.0), ('never', 192.0)) AS l(job, lim) LEFT JOIN runs USING (job) GROUP BY l.job, l.lim""", views=False)
def run_overdue(spark, sf_dir):
    return health.overdue(_runs(spark, sf_dir), LIMITS, NOW)


@query(_RUNS + """, o AS (SELECT job, max(started_at) FILTER (ok) AS last_ok FROM runs GROUP BY job)
SELECT o.job, count(*) FILTER (NOT ok AND (last_ok IS NULL OR started_at > last_ok)) AS streak, last_ok FROM o JOIN runs USING (job) GROUP BY o.job, last_ok""", views=False)
def failure_streak(spark, sf_dir):
    return health.failure_streaks(_runs(spark, sf_dir))


@query(_RUNS + """, i AS (SELECT *, sum(CAST(ok AS BIGINT)) OVER (PARTITION BY job ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
c AS (SELECT job, island, count(*) AS n FROM i WHERE NOT ok GROUP BY ALL) SELECT job, max(n) AS longest FROM c GROUP BY job""", views=False)
def longest_streak(spark, sf_dir):
    return runs.longest_streak(_runs(spark, sf_dir))


@query("""
WITH a AS (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(CAST(ts AS TIMESTAMP))) / 3600000000 AS age FROM events),
n AS (SELECT count(DISTINCT event_id) FILTER (age >= 0 AND age < 24) AS day, count(DISTINCT event_id) FILTER (age >= 0 AND age < 720) AS month FROM a)
SELECT *, CASE WHEN greatest(day / 400.0, month / 12000.0) >= 0.95 THEN 'crit' WHEN greatest(day / 400.0, month / 12000.0) >= 0.8 THEN 'warn' ELSE 'ok' END AS state FROM n""", views=False)
def quota(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return health.quota(log, NOW, 400, 12_000)


def _usage(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    return c.select(
        F.col("role").alias("stage"), n.alias("tokens_in"), F.floor(n / 4).alias("tokens_out"),
        F.when(F.col("turn") % 3 == 0, n).otherwise(0).alias("cache_write"), F.when(F.col("turn") % 3 == 1, n * 2).otherwise(0).alias("cache_read"),
    )


_USAGE = """WITH u AS (SELECT role AS stage, CAST(length(text) AS BIGINT) AS tokens_in, CAST(floor(length(text) / 4) AS BIGINT) AS tokens_out,
  CASE WHEN turn % 3 = 0 THEN length(text) ELSE 0 END AS cache_write, CASE WHEN turn % 3 = 1 THEN length(text) * 2 ELSE 0 END AS cache_read FROM conversations)"""
PRICES = {"assistant": (1.0, 5.0), "system": (3.0, 15.0)}


@query(_USAGE + """
SELECT stage, count(*) AS calls, round(sum(((tokens_in + 1.25 * cache_write + 0.1 * cache_read) * CASE WHEN stage = 'assistant' THEN 1.0::DOUBLE ELSE 3.0 END
  + tokens_out * CASE WHEN stage = 'assistant' THEN 5.0::DOUBLE ELSE 15.0 END) / 1e6), 6) AS cost FROM u GROUP BY stage""", views=False)
def usage_cost(spark, sf_dir):
    return health.usage_cost(_usage(spark, sf_dir), PRICES, "system")


@query(_USAGE + """
SELECT stage, count(*) FILTER (cache_read + cache_write > 0) AS calls, CAST(sum(cache_read) AS BIGINT) AS reads, CAST(sum(cache_write) AS BIGINT) AS writes,
  CASE WHEN count(*) FILTER (cache_read + cache_write > 0) >= 5 THEN round(sum(cache_read) / (sum(cache_read) + sum(cache_write)), 6) END AS ratio FROM u GROUP BY stage""", views=False)
def cache_ratio(spark, sf_dir):
    return health.cache_ratio(_usage(spark, sf_dir))


@query("""
, a AS (SELECT CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(seen_at)) / 3600000000 / 24) AS BIGINT) AS age, importance >= 3 AS relevant FROM stories)
, n AS (SELECT count(*) FILTER (age BETWEEN 0 AND 6) AS stored, count(*) FILTER (age BETWEEN 0 AND 6 AND relevant) AS kept,
  count(*) FILTER (age BETWEEN 7 AND 27) AS stored_before, count(*) FILTER (age BETWEEN 7 AND 27 AND relevant) AS kept_before FROM a)
SELECT *, round(kept / stored, 6) AS rate, round(kept_before / stored_before, 6) AS rate_before,
  CASE WHEN stored < 100 OR stored_before < 100 OR kept_before = 0 THEN 'unknown' WHEN (kept / stored) / (kept_before / stored_before) - 1 <= -0.7 THEN 'crit'
    WHEN abs((kept / stored) / (kept_before / stored_before) - 1) >= 0.5 THEN 'warn' ELSE 'ok' END AS state FROM n""")
def relevance_baseline(spark, sf_dir):
    return health.relevance_baseline(S.stories(spark, sf_dir).withColumn("relevant", F.col("importance") >= 3), NOW)


@query("""
, n AS (SELECT count(*) AS total, count(*) FILTER (author IS NULL) AS missing,
  count(*) FILTER (author IS NULL AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(seen_at)) / 3600000000 > 36) AS stale FROM stories)
SELECT *, CASE WHEN total < 20 THEN 'unknown' WHEN missing / total >= 0.75 THEN 'warn' ELSE 'ok' END AS state FROM n""")
def author_backlog(spark, sf_dir):
    return health.author_backlog(S.stories(spark, sf_dir), NOW)


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT state FROM ({ORACLES[name]})" for name in ("run_overdue", "quota", "relevance_baseline", "author_backlog")) + """)
SELECT CASE WHEN count(*) FILTER (state = 'crit') > 0 THEN 'crit' WHEN count(*) FILTER (state = 'warn') > 0 THEN 'warn' WHEN count(*) FILTER (state = 'unknown') > 0 THEN 'unknown'
  WHEN count(*) > 0 THEN 'ok' END AS overall, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'warn') AS warn,
  count(*) FILTER (state = 'crit') AS crit FROM s""", views=False)
def health_rollup(spark, sf_dir):
    states = [f(spark, sf_dir).select("state") for f in (run_overdue, quota, relevance_baseline, author_backlog)]
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return health.rollup(rows)


@query(r"""
WITH d AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9\x{0600}-\x{06ff}]+', ' ', 'g')), ' ') AS ws FROM benchmark),
g AS (SELECT DISTINCT id, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (
  SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES (2), (3), (4), (5)) AS v(n) WHERE len(ws) >= n))
SELECT phrase, count(*) AS n_docs FROM g GROUP BY phrase ORDER BY n_docs DESC, length(phrase) DESC, phrase LIMIT 20""", views=False)
def ngram_phrase(spark, sf_dir):
    return narratives.best_phrases(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(ORACLES["ngram_phrase"].replace("item_id AS id", "doc_id AS id").replace("FROM benchmark", "FROM documents"), views=False)
def ngram_phrase_documents(spark, sf_dir):
    return narratives.best_phrases(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _thread_stories(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    brand = F.get(F.array(*map(F.lit, ALL_BRANDS)), (F.col("doc_id") % 5).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), brand.alias("brand"), F.concat(F.lit("cat"), (F.col("doc_id") % 3).cast("string")).alias("category"), "text",
        F.when(F.col("doc_id") % 4 == 0, "negative").when(F.col("doc_id") % 4 == 1, "positive").otherwise("neutral").alias("sentiment"),
        (F.col("doc_id") % 30).alias("idx"), (1 + F.col("doc_id") % 7).alias("importance"), F.col("text").alias("headline"),
    )


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_THREADS = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS id, (['home', 'rival_a', 'rival_b', 'rival_c', 'other'])[1 + doc_id % 5] AS brand, 'cat' || CAST(doc_id % 3 AS VARCHAR) AS category,
  CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS sentiment, doc_id % 30 AS idx, 1 + doc_id % 7 AS importance, text AS headline,
  row_number() OVER (ORDER BY doc_id) AS rn,
  [w for w in string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{{0600}}-\x{{06ff}} ]', ' ', 'g'), ' ') if length(w) >= 3 AND w NOT IN {_listed(narratives.STOP)}] AS ws FROM documents),
t AS MATERIALIZED (SELECT DISTINCT rn, w, length(w) >= 4 AND NOT regexp_full_match(w, '[0-9\x{{0660}}-\x{{0669}}]+') AND w NOT IN {_listed(narratives.GENERIC)} AS strong FROM (SELECT rn, unnest(ws) AS w FROM d)),
n AS (SELECT rn, count(*) AS n FROM t GROUP BY rn),
p AS (SELECT x.rn AS a, y.rn AS b, count(*) AS both_, count(*) FILTER (x.strong) AS s FROM t x JOIN t y ON x.w = y.w AND x.rn < y.rn GROUP BY ALL),
c AS (SELECT a, b, CAST(both_ AS DOUBLE) / (na.n + nb.n - both_) AS j, s, da.brand = db.brand AND da.category = db.category AS loose,
  CASE WHEN db.category IN {_listed(narratives.CATCH_ALL)} THEN 3 ELSE 2 END + CASE WHEN da.category = db.category THEN 0 ELSE 1 END
  + CASE WHEN da.brand <> db.brand AND da.brand <> 'other' AND db.brand <> 'other' THEN 2 ELSE 0 END AS need
  FROM p JOIN d da ON da.rn = a JOIN d db ON db.rn = b JOIN n na ON na.rn = a JOIN n nb ON nb.rn = b),
k AS (SELECT a, b, greatest(CASE WHEN loose AND j >= 0.22::DOUBLE THEN j ELSE -1 END, CASE WHEN s >= need THEN 0.2::DOUBLE + 0.02::DOUBLE * s ELSE -1 END) AS score FROM c),
l AS MATERIALIZED (SELECT d.rn, d.id, f.earlier FROM d LEFT JOIN (SELECT b, list(a) AS earlier FROM (SELECT a, b FROM k WHERE score >= 0 QUALIFY score = max(score) OVER (PARTITION BY b)) GROUP BY b) f ON f.b = d.rn),
r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS th UNION ALL
  SELECT l.rn, list_append(r.th, coalesce(list_min([r.th[x] for x in l.earlier]), l.id)) FROM r JOIN l ON l.rn = r.rn + 1),
whole AS (SELECT arg_max(th, rn) AS th FROM r),
m AS MATERIALIZED (SELECT d.*, whole.th[d.rn] AS thread FROM d, whole)"""


@query(_THREADS + " SELECT id, thread FROM m", views=False)
def narrative_threads(spark, sf_dir):
    rows = _thread_stories(spark, sf_dir)
    return narratives.threads(rows, narratives.thread_links(rows, stage=staged), staged)


@query(_THREADS + rf""",
g AS (SELECT DISTINCT id, thread, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase, len([w for w in ws[i:i + n - 1] if w NOT IN {_listed(narratives.GENERIC)}]) > 0 AS telling
  FROM (SELECT id, thread, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM m, (VALUES (2), (3), (4), (5)) AS v(n) WHERE len(ws) >= n)),
f AS (SELECT thread, phrase, n, count(*) AS docs FROM g WHERE telling GROUP BY ALL HAVING count(*) >= 2),
near AS (SELECT * FROM f QUALIFY docs >= max(docs) OVER (PARTITION BY thread) - 1),
nm AS (SELECT thread, phrase FROM near QUALIFY row_number() OVER (PARTITION BY thread ORDER BY n DESC, docs DESC, phrase) = 1),
br AS (SELECT thread, brand FROM m GROUP BY thread, brand QUALIFY row_number() OVER (PARTITION BY thread ORDER BY count(*) DESC, min(id)) = 1),
ct AS (SELECT thread, category FROM m GROUP BY thread, category QUALIFY row_number() OVER (PARTITION BY thread ORDER BY count(*) DESC, min(id)) = 1),
a AS (SELECT thread, count(*) AS total, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (idx >= 20) AS recent, count(*) FILTER (idx < 20) AS earlier,
  list(id ORDER BY importance DESC, id) AS every, first(headline ORDER BY importance DESC, id) AS headline, list(idx) AS at_ FROM m GROUP BY thread HAVING count(*) >= 2),
b AS (SELECT *, recent >= 2 AND recent / 10 > 1.5::DOUBLE * (earlier / 20) AS rising,
  CASE WHEN earlier > 0 THEN least(99.0::DOUBLE, floor(10 * (recent / 10) / (earlier / 20) + 0.5::DOUBLE) / 10) END AS rising_score FROM a)
SELECT b.thread, CASE WHEN br.brand = 'other' THEN '' ELSE br.brand || ' · ' END || coalesce(nm.phrase, array_to_string(regexp_split_to_array(trim(regexp_replace(
    regexp_extract(headline, '(?s)^(.*?)(?:[:：.．…]|\s[-–—]\s|$)', 1), '["''«»“”]', '', 'g')), '\s+')[1:7], ' ')) AS name, br.brand, ct.category, total, negative, neutral, positive,
  [CAST(len([x for x in at_ if x = day]) AS BIGINT) for day in range(30)] AS series, rising, rising_score, headline, every[1:100] AS ids, total AS ids_total
FROM b JOIN br USING (thread) JOIN ct USING (thread) LEFT JOIN nm USING (thread)
ORDER BY rising DESC, coalesce(rising_score, 0) DESC, total DESC, b.thread LIMIT 20""", views=False)
def narrative_board(spark, sf_dir):
    rows = _thread_stories(spark, sf_dir)
    found = narratives.threads(rows, narratives.thread_links(rows, stage=staged), staged)
    return narratives.thread_board(rows, found, 30, stage=staged)


@query("SELECT CAST(timezone('Africa/Cairo', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", views=False)
def stream_daily(spark, sf_dir):
    return stream.daily_counts(stream.events(spark, sf_dir), stream.shared_dir(spark))


@query("""
SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id""", views=False)
def stream_dedupe(spark, sf_dir):
    rows = stream.events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return stream.merge_by_key(rows, "user_id", "event_id", stream.shared_dir(spark)).select("user_id", "event_id", "event_type", "n")




def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


_ORDERS = "WITH o AS (SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"


@query(_ORDERS + """, c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS status FROM customer)
SELECT coalesce(o.key, c.key) AS key, cust, coalesce(c.status, o.status) AS status, priority FROM o FULL JOIN c ON o.key = c.key""", views=False)
def upsert(spark, sf_dir):
    changes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "X").alias("status"))
    return ledger.upsert(_orders(spark, sf_dir), changes, "key")


@query("""
, target AS (SELECT DISTINCT lower(outlet) AS outlet, 0 AS item_id FROM instances WHERE item_id % 6 = 0)
, new AS (SELECT lower(source) AS outlet, min(id) AS item_id FROM stories GROUP BY 1)
SELECT * FROM target UNION ALL SELECT * FROM new WHERE outlet NOT IN (SELECT outlet FROM target)""")
def insert_ignore(spark, sf_dir):
    target = S.coverage(spark, sf_dir).where("item_id % 6 = 0").select(F.lower("outlet").alias("outlet"), F.lit(0).cast("long").alias("item_id")).distinct()
    new = S.stories(spark, sf_dir).select(F.lower("source").alias("outlet"), F.col("id").alias("item_id"))
    return ledger.insert_ignore(target, new, ["outlet"], [F.col("item_id")])


@query(_ORDERS + "SELECT * FROM o WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", views=False)
def delete_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("cust"))
    return ledger.delete(_orders(spark, sf_dir), gone, "cust").select("key", "cust", "status", "priority")


@query("SELECT id FROM stories WHERE NOT (id % 4 = 1 AND id % 8 = 1)")
def semantic_verdicts(spark, sf_dir):
    rows = S.stories(spark, sf_dir).select("id")
    verdicts = rows.where("id % 4 = 1").select("id", (F.col("id") % 8 == 1).alias("same"))
    return ledger.apply_verdicts(rows, verdicts)


@query("""
, c AS (SELECT *, 'u' || CAST(pos AS VARCHAR) AS url, pos = 0 AS wrapped FROM instances)
SELECT item_id, lower(trim(outlet)) AS key, arg_min(outlet, CAST(wrapped AS INT) * 10 + pos) AS outlet, arg_min(url, CAST(wrapped AS INT) * 10 + pos) AS url,
  min(author) FILTER (author IS NOT NULL) AS author FROM c GROUP BY item_id, lower(trim(outlet))""")
def outlet_collapse(spark, sf_dir):
    cov = S.coverage(spark, sf_dir).withColumns({"url": F.concat(F.lit("u"), F.col("pos").cast("string")), "wrapped": F.col("pos") == 0})
    return ledger.collapse_outlets(cov)


@query("""
SELECT CASE WHEN NOT (published_at IS NULL OR published_at > TIMESTAMP '2024-01-29') THEN 'fresh' WHEN importance < 2 THEN 'relevant'
  WHEN NOT (importance >= 4 OR (brand <> 'other' AND sentiment = 'negative')) THEN 'alert' ELSE 'delivered' END AS lost_at, count(*) AS n FROM stories GROUP BY 1""")
def ingest_funnel(spark, sf_dir):
    rows = S.stories(spark, sf_dir)
    stages = [("fresh", filters.fresh(rows, NOW)), ("relevant", rows.where("importance >= 2")), ("alert", rows.where(filters.instant_alert(BRANDS)))]
    return ledger.funnel(rows, stages)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS bad FROM orders", views=False)
def delivery_status(spark, sf_dir):
    return ledger.delivery(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), ("F", "P"))


@query("""
WITH RECURSIVE e AS (SELECT event_id AS id, event_type || CAST(user_id AS VARCHAR) AS title, CAST(ts AS TIMESTAMP) AS "at" FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY title ORDER BY "at", id) AS k FROM e),
s AS (SELECT id, title, "at", k, "at" AS last, true AS sent FROM n WHERE k = 1 UNION ALL
  SELECT n.id, n.title, n."at", n.k, CASE WHEN epoch_us(n."at") - epoch_us(s.last) >= 22 * 3600000000 THEN n."at" ELSE s.last END,
    epoch_us(n."at") - epoch_us(s.last) >= 22 * 3600000000 FROM s JOIN n ON n.title = s.title AND n.k = s.k + 1)
SELECT id, title, "at" FROM s WHERE sent""", views=False)
def alert_throttle(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string")).alias("title"), F.col("ts").cast("timestamp_ntz").alias("at")
    )
    return ledger.throttled(e, 22)


@query("""
SELECT coalesce(n.k, s.k) AS id, CASE WHEN n.k IS NULL THEN 'extra' WHEN s.k IS NULL THEN 'missing' ELSE 'applied' END AS state
FROM (SELECT n_nationkey AS k FROM nation) n FULL JOIN (SELECT DISTINCT s_nationkey + 3 AS k FROM supplier) s ON n.k = s.k""", views=False)
def schema_drift(spark, sf_dir):
    code = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return ledger.schema_drift(code, table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 3).alias("id")).distinct())


@query("""
SELECT 'f' || CAST(item_id % 7 AS VARCHAR) AS feed_id, count(*) AS n FROM benchmark WHERE item_id % 11 <> 0 GROUP BY 1""", views=False)
def feed_items(spark, sf_dir):
    """Every benchmark item as a feed of one entry; each eleventh body is hostile and must be turned away."""
    b = table(spark, sf_dir, "benchmark")
    safe = F.regexp_replace(F.col("text"), "[<>&]", " ")
    head = F.when(F.col("item_id") % 11 == 0, '<!DOCTYPE r [<!ENTITY x "y">]>').otherwise("")
    body = F.concat(head, F.lit("<rss><channel><item><title>"), safe, F.lit("</title><link>https://a.example/1</link></item></channel></rss>"))
    found = feeds.items(b.select(F.concat(F.lit("f"), (F.col("item_id") % 7).cast("string")).alias("feed_id"), body.alias("body")))
    return found.groupBy("feed_id").agg(F.count("*").alias("n"))
