"""Queries of streams with state, over tables that arrive in slices, and of the contracts between the stages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.functions import text as T
from coverwell.operators import board, contracts, dedupe, health, ingest, ledger, paging, reports, trends
from coverwell.plans import registry
from coverwell.plans.registry import _GATE_SQL, _GATE_WORDS, _PHRASE_SQL, _TOKENS, _gate_rows, query
from coverwell.sources import feeds
from coverwell.sources import tables as S
from coverwell.sources.staging import staged
from coverwell.sources.tables import NOW, table
from coverwell.streaming import state, stream


def _day(at):
    return F.datediff(F.col(at).cast("date"), F.lit("2024-01-01"))


@query("""
WITH runs AS (SELECT event_type AS job, CAST(ts AS TIMESTAMP) AS started_at, event_id % 9 <> 0 AS ok, 'failed at ' || coalesce(props, '') AS error FROM events),
o AS (SELECT job, max(started_at) FILTER (ok) AS last_ok FROM runs GROUP BY job)
SELECT o.job, count(*) FILTER (since) AS streak, last_ok, arg_max(error, started_at) FILTER (since) AS last_error
FROM o JOIN (SELECT r.*, NOT ok AND (last_ok IS NULL OR started_at > last_ok) AS since FROM runs r JOIN o USING (job)) r USING (job) GROUP BY o.job, last_ok""", views=False)
def stream_failure_streak(spark, sf_dir):
    """The streaks of ``failure_streak``, kept by a stream whose runs arrive eight days at a time."""
    e = table(spark, sf_dir, "events")
    runs = e.select(
        F.col("event_type").alias("job"), F.col("ts").cast("timestamp_ntz").alias("started_at"), (F.col("event_id") % 9 != 0).alias("ok"),
        F.concat(F.lit("failed at "), F.coalesce("props", F.lit(""))).alias("error"), F.floor(_day("ts") / 8).cast("int").alias("slice"),
    )
    where = stream.shared_dir(spark)
    tables = []
    state.replay(runs, "slice", where, lambda s: tables.append(state.failure_streaks(s, where)))
    return tables[-1].read()


@query("""
WITH RECURSIVE e AS (SELECT event_id AS id, event_type || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 100 <> 99 THEN CAST(ts AS TIMESTAMP) END AS "at" FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY title ORDER BY "at", id) AS k FROM e WHERE "at" IS NOT NULL),
s AS (SELECT id, title, "at", k, "at" AS last, true AS sent FROM n WHERE k = 1 UNION ALL
  SELECT n.id, n.title, n."at", n.k, CASE WHEN epoch_us(n."at") - epoch_us(s.last) >= 22 * 3600000000 THEN n."at" ELSE s.last END,
    epoch_us(n."at") - epoch_us(s.last) >= 22 * 3600000000 FROM s JOIN n ON n.title = s.title AND n.k = s.k + 1)
SELECT id, title, "at" FROM s WHERE sent UNION ALL SELECT id, title, "at" FROM e WHERE "at" IS NULL""", views=False)
def stream_alert_throttle(spark, sf_dir):
    """``alert_throttle`` as a stream that forgets a title once its 22 hours have passed; one alert in a hundred has no time."""
    e = table(spark, sf_dir, "events")
    alerts = e.select(
        F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string")).alias("title"),
        F.when(F.col("event_id") % 100 != 99, F.col("ts").cast("timestamp_ntz")).alias("at"), F.floor(_day("ts") / 8).cast("int").alias("slice"),
    )
    where = stream.shared_dir(spark)
    sent = []
    state.replay(alerts, "slice", where, lambda s: sent.append(state.throttled(s.drop("slice"), where, 22)))
    return sent[-1]


@query("""
WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS TIMESTAMP) END AS published_at,
  CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 8) AS INT) + CASE WHEN event_id % 49 = 0 THEN 1 ELSE 0 END AS slice FROM events),
m AS (SELECT slice, max(max(published_at)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM a GROUP BY slice)
SELECT id, published_at, slice, CASE WHEN published_at IS NULL THEN 'undated' WHEN published_at <= mark - INTERVAL 48 HOUR THEN 'late' ELSE 'kept' END AS branch
FROM a JOIN m USING (slice)""", views=False)
def stream_late_rows(spark, sf_dir):
    """Each story with its branch; one in 49 arrives a slice after those of its time."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp_ntz")).alias("published_at"),
        (F.floor(_day("ts") / 8) + (F.col("event_id") % 49 == 0).cast("int")).cast("int").alias("slice"),
    )
    where = stream.shared_dir(spark)
    parted = []
    state.replay(rows, "slice", where, lambda s: parted.append(state.split_late(s, where, "published_at", 48)))
    return parted[-1].select("id", "published_at", "slice", "branch")


def _band_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    at = F.when(F.col("doc_id") % 97 != 0, F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("doc_id") * 2).cast("int")))
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return d.select(F.col("doc_id").alias("id"), at.alias("at"), T.tokens(line).alias("head"), T.tokens(F.col("text")).alias("summ"))


@query(f"""
WITH l AS (SELECT doc_id AS id, CASE WHEN doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-31' + to_hours(CAST(doc_id * 2 AS INTEGER)) ELSE TIMESTAMP '1970-01-01' END AS "at",
  string_split(coalesce(text, ''), chr(10))[1] AS line, text AS whole FROM documents),
d AS (SELECT id, "at", head, summ FROM (SELECT id, "at", whole, {_TOKENS} AS head FROM (SELECT *, line AS text FROM l)) JOIN
  (SELECT id, {_TOKENS} AS summ FROM (SELECT id, whole AS text FROM l)) USING (id)),
p AS (SELECT a.id AS x, b.id AS y, a."at" AS ax, b."at" AS ay, len(list_intersect(a.head, b.head)) AS h, len(a.head) + len(b.head) AS hs,
  len(list_intersect(a.summ, b.summ)) AS s, len(a.summ) + len(b.summ) AS ss
  FROM d a JOIN d b ON a.id < b.id AND b."at" BETWEEN a."at" - INTERVAL 5 DAY AND a."at" + INTERVAL 5 DAY),
q AS (SELECT *, CASE WHEN h = 0 THEN 0 ELSE h / (hs - h) END AS head, CASE WHEN s = 0 THEN 0 ELSE s / (ss - s) END AS summ FROM p)
SELECT CASE WHEN ax <= ay THEN x ELSE y END AS keep, CASE WHEN ax <= ay THEN y ELSE x END AS drop, floor(greatest(head, summ) * 100 + 0.5) / 100 AS score,
  floor(head * 100 + 0.5) / 100 AS head_score, floor(summ * 100 + 0.5) / 100 AS summ_score, CASE WHEN head >= 0.55 OR summ >= 0.5 THEN 'lexical' ELSE 'semantic' END AS band
FROM q WHERE greatest(head, summ) >= 0.4""", views=False)
def banded_duplicates(spark, sf_dir):
    """Documents as stories two hours apart, first lines as headlines; a few are undated."""
    return dedupe.banded_pairs(_band_rows(spark, sf_dir), 0.4, most=None, stage=staged)


@query(rf"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, doc_id - 4611686018427387904 AS pos, {_GATE_WORDS} AS ws FROM documents
  UNION ALL SELECT 'b', item_id, item_id, {_GATE_WORDS} FROM benchmark),
t AS (SELECT side, id, pos, list_distinct(list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({_GATE_SQL}, x))) AS toks,
  list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({_PHRASE_SQL}, x)) AS pw FROM w),
r AS (SELECT side, id, pos, toks, list_filter(toks, lambda x: length(x) >= 5) AS strong,
  list_distinct([pw[i] || ' ' || pw[i + 1] FOR i IN range(1, len(pw))]) AS pairs FROM t),
p AS (SELECT a.id, b.side, b.id AS other, b.pos, len(list_intersect(a.toks, b.toks)) AS n, len(a.toks) AS la, len(b.toks) AS lb,
  len(list_intersect(a.strong, b.strong)) AS shared, len(list_intersect(a.pairs, b.pairs)) AS phrases FROM r a JOIN r b ON a.side = 'b' AND b.pos < a.pos),
q AS (SELECT *, CASE WHEN la = 0 OR lb = 0 THEN 0 ELSE n / (la + lb - n) END AS j FROM p),
s AS (SELECT *, greatest(j, shared / 3.0, phrases / 3.0) AS score FROM q WHERE j < 0.5 AND n > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS k FROM s WHERE score > 0)
SELECT id, CASE WHEN side = 'd' THEN other END AS match, CASE WHEN side = 'b' THEN other END AS run_match, round(score, 6) AS score
FROM best WHERE k = 1 AND (j >= 0.12 OR shared >= 2 OR phrases >= 2)""", views=False)
def semantic_run_candidates(spark, sf_dir):
    """Benchmark items as the stories of a run: each sees the stored documents and the items before it."""
    new = _gate_rows(spark, sf_dir, "benchmark", "item_id").withColumn("pos", F.col("id"))
    return dedupe.gated_in_run(new, _gate_rows(spark, sf_dir, "documents", "doc_id").withColumn("pos", F.col("id")), most=None)


def _provider(items: list[dict], ask: int) -> list[dict]:
    """Answers from the labels that the items carry: fails on some, skips some at first, and some however often it is asked."""
    if any(x["id"] % 31 == 0 for x in items):
        raise ValueError("no JSON in the answer")
    open_ = [(i, x) for i, x in enumerate(items) if x["quality"] == x["quality"] and x["quality"] is not None]
    told = [(i, x) for i, x in open_ if (x["id"] % 7 or ask >= 1) and x["id"] % 13]
    return [{"i": i, "is_relevant": x["quality"] == 1, "category": "toxic" if x["toxic"] == 1 else "clean"} for i, x in reversed(told)]


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("seen_at"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return d.join(labels, "id", "left")


_ANSWERED = "d.doc_id % 31 <> 0 AND d.doc_id % 13 <> 0 AND l.quality IS NOT NULL"


@query(f"""
SELECT d.doc_id AS id, CASE WHEN {_ANSWERED} THEN quality = 1 END AS is_relevant, CASE WHEN {_ANSWERED} THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END END AS category,
  {_ANSWERED} AS resolved FROM documents d LEFT JOIN labels l USING (doc_id)""", views=False)
def classified(spark, sf_dir):
    """Documents in batches of 25 through a provider that fails, skips and forgets; labels are its verdicts."""
    told = contracts.classify(_labelled(spark, sf_dir).select("id", "quality", "toxic"), _by_value(_provider), "is_relevant boolean, category string")
    return told.select("id", "is_relevant", "category", "resolved")


@query(f"""
WITH p AS (SELECT doc_id, {_ANSWERED} AS done, quality = 1 AS good, row_number() OVER (ORDER BY doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE TIMESTAMP '2024-01-31' - to_minutes(CAST(doc_id AS INTEGER)) >= TIMESTAMP '2024-01-29')
SELECT count(*) FILTER (n <= 50) AS found, count(*) FILTER (n <= 50 AND done) AS resolved, count(*) FILTER (n <= 50 AND done AND good) AS kept,
  count(*) FILTER (n <= 50 AND NOT done) AS still_parked, count(*) - count(*) FILTER (n <= 50 AND done) AS remaining FROM p""", views=False)
def rescreen_report(spark, sf_dir):
    """The newest 50 parked documents of two days, asked for again; 50 is what one call may take."""
    return contracts.rescreen(_labelled(spark, sf_dir), _by_value(_provider), "is_relevant boolean, category string", NOW)[1]


def _by_value(f):
    """A copy of ``f`` that travels to the workers with its code, so they need no module of ours."""
    import types

    return types.FunctionType(f.__code__, {"__builtins__": __builtins__}, f.__name__)


@query("""
WITH c AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_custkey % 6 = 0 AS team_share,
  CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-01-01' END AS team_share_at FROM customer),
p AS (SELECT o_custkey AS key,
    arg_max({'v': nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE ' N' || o_orderkey END), '')}, o_orderkey) FILTER (o_orderkey % 3 = 0) AS name,
    arg_max({'v': o_orderpriority}, o_orderkey) FILTER (o_orderkey % 5 = 0) AS segment,
    arg_max({'v': CASE o_orderkey % 12 WHEN 0 THEN true WHEN 4 THEN false END, 't': CASE WHEN o_orderkey % 12 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END}, o_orderkey) FILTER (o_orderkey % 4 = 0) AS pin
  FROM orders GROUP BY 1)
SELECT c.key, CASE WHEN p.name IS NULL THEN c.name ELSE p.name.v END AS name, CASE WHEN p.segment IS NULL THEN c.segment ELSE p.segment.v END AS segment, balance,
  CASE WHEN p.pin IS NULL THEN c.team_share ELSE p.pin.v END AS team_share, CASE WHEN p.pin IS NULL THEN c.team_share_at ELSE p.pin.t END AS team_share_at
FROM c LEFT JOIN p USING (key)""", views=False)
def patched_fields(spark, sf_dir):
    """Customers after the patches that orders stand for: names set or cleared, segments, pins with their stamps."""
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "customer")
    target = c.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        (F.col("c_custkey") % 6 == 0).alias("team_share"), F.when(F.col("c_custkey") % 6 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("team_share_at"),
    )
    name = F.when(k % 2 == 0, "  ").otherwise(F.concat(F.lit(" N"), k.cast("string")))
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), k.alias("seq"), F.col("o_orderdate").cast("timestamp_ntz").alias("_at"),
        contracts.given(contracts.text_or_null(name), k % 3 == 0).alias("name"), contracts.given(F.col("o_orderpriority"), k % 5 == 0).alias("segment"),
        contracts.given(F.when(k % 12 == 0, True).when(k % 12 == 4, False), k % 4 == 0).alias("team_share"),
    )
    return contracts.patched(target, contracts.pin_patch(log, "_at").drop("_at"), "key", "seq")


_WINDOWS = {"day": (24, 100), "month": (720, 2100)}


@query("""
WITH e AS (SELECT event_id AS id, event_type AS sender, CAST(ts AS TIMESTAMP) AS ts, event_id // 200 AS page FROM events),
pg AS (SELECT sender, page, min(ts) AS oldest FROM e GROUP BY ALL),
pn AS (SELECT *, coalesce(lead(oldest) OVER (PARTITION BY sender ORDER BY page), TIMESTAMP '2024-01-31') AS newest FROM pg),
kept AS (SELECT sender, page, epoch_us(oldest) AS lo, epoch_us(newest) AS hi FROM pn WHERE (page * 7 + length(sender)) % 23 <> 5 OR sender = 'view'),
o AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY sender ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM kept),
i AS (SELECT *, sum(opens) OVER (PARTITION BY sender ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM o),
s AS (SELECT sender, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY sender, island),
b AS (SELECT sender, CASE WHEN lo <= first THEN 0 ELSE lo END AS lo FROM s JOIN (SELECT sender, min(lo) FILTER (page = 0) AS first FROM kept GROUP BY 1) USING (sender)
  WHERE hi = epoch_us(TIMESTAMP '2024-01-31')),
w(win, hours, cap) AS (VALUES ('day', 24, 100), ('month', 720, 2100)),
n AS (SELECT sender, win, hours, cap, count(DISTINCT id) FILTER (dated AND age BETWEEN 0 AND hours * 3600000000) AS n, count(DISTINCT id) FILTER (NOT dated) AS undated
  FROM (SELECT *, NOT (sender = 'signup' AND id % 1000 < 3) AS dated, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) AS age FROM e), w GROUP BY ALL),
c AS (SELECT n.*, undated = 0 AND coalesce(lo <= epoch_us(TIMESTAMP '2024-01-31') - hours * 3600000000, false) AS complete FROM n LEFT JOIN b USING (sender))
SELECT sender, win AS "window", n, undated, complete,
  CASE WHEN n / cap >= 0.95 THEN 'crit' WHEN n / cap >= 0.8 THEN 'warn' WHEN NOT complete THEN 'unknown' ELSE 'ok' END AS state FROM c""", views=False)
def log_coverage(spark, sf_dir):
    """Each sender's sends of a day and a month, with whether the pages read of its log cover them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sender"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("event_id") / 200).alias("page"))
    pages = e.groupBy("sender", "page").agg(F.min("ts").alias("oldest")).withColumn("ended", F.col("page") == 0)
    newest = F.coalesce(F.lead("oldest").over(W.partitionBy("sender").orderBy("page")), F.lit(NOW).cast("timestamp_ntz"))  # a row for each page
    pages = pages.withColumn("newest", newest).where(((F.col("page") * 7 + F.length("sender")) % 23 != 5) | (F.col("sender") == "view"))
    dated = ~((F.col("sender") == "signup") & (F.col("id") % 1000 < 3))
    log = e.select("id", "sender", F.when(dated, F.col("ts")).alias("created_at"))
    return contracts.window_coverage(pages, log, "sender", NOW, _WINDOWS)


@query("""
WITH r AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS a, CAST(ts AS TIMESTAMP) + to_minutes(CAST(user_id % 45 AS INTEGER)) AS b FROM events WHERE user_id % 45 > 0)
SELECT x.id, count(y.id) - 1 AS overlaps FROM r x JOIN r y ON y.a < x.b AND y.b > x.a GROUP BY x.id""", views=False)
def overlapping_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp_ntz")
    return contracts.overlaps(e.select(F.col("event_id").alias("id"), at.alias("started_at"), (at + F.make_dt_interval(mins=(F.col("user_id") % 45).cast("int"))).alias("ended_at")))


@query("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id) - 1 AS place FROM events)
SELECT event_id, place, place // 1000 + 1 AS page FROM p""", views=False)
def export_pages(spark, sf_dir):
    """All events, newest first, with the page of 1,000 that each is on: nothing ends at a ceiling."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return paging.paged(rows, [F.col("ts").desc(), F.col("event_id").asc()], 1000, staged).select("event_id", "place", "page")


@query(registry._CARRIED + registry._board_sql("byline", "author", "byline IS NOT NULL AND trim(byline) NOT IN ('', '—')").replace("LIMIT 300", "") + """
, p AS (SELECT *, row_number() OVER (ORDER BY home_negative DESC, negative DESC, mentions DESC, key) - 1 AS place FROM board)
SELECT place // 15 + 1 AS page, count(*) AS n, arg_min(key, place) AS first, arg_max(key, place) AS last, max(max(place // 15 + 1)) OVER () AS pages,
  CAST(min(place) + 1 AS VARCHAR) || '–' || CAST(max(place) + 1 AS VARCHAR) || ' of ' || CAST(sum(count(*)) OVER () AS VARCHAR) AS label FROM p GROUP BY place // 15""")
def author_pages(spark, sf_dir):
    """The author board in pages of 15: first and last name of each, and what its pager says."""
    board = trends.author_leaderboard(trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir)), S.HOME, None)
    pages = staged(paging.paged(board, [F.desc("home_negative"), F.desc("negative"), F.desc("mentions"), F.asc("key")], 15, staged))
    index = paging.page_index(pages, ["key"]).join(paging.counter(pages, 15), "page")
    return index.select("page", "n", F.col("first.key").alias("first"), F.col("last.key").alias("last"), "pages", "label")


def _fetched(spark, sf_dir):
    """Feeds of up to 20 documents each, RSS or Atom by turns; some answer 500, some bodies are hostile, cut off or missing."""
    d = table(spark, sf_dir, "documents")
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .,]+", " "))
    k, feed = F.col("doc_id"), F.floor(F.col("doc_id") / 20)
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name.split(' ')[0]}>"))
    title = F.concat(F.substring(plain, 1, 40), F.lit(" &amp;amp; "), k.cast("string"), F.when(k % 3 == 0, " - Outlet One").otherwise(""))
    link = F.when(k % 11 == 0, "javascript:x").otherwise(F.concat(F.lit("https://a.example/"), k.cast("string")))
    body = F.concat(F.lit("&lt;p&gt;"), F.substring(plain, 1, 400), F.lit("&lt;/p&gt;"))
    date = F.date_format(F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=k.cast("int")), "dd MMM yyyy HH:mm:ss")
    iso = F.date_format(F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    credit = F.when(k % 4 == 0, "Mona Adel").when(k % 4 == 1, "newsroom").when(k % 4 == 2, "By Ann Bee")
    rss_body = F.when(k % 5 == 0, tag("description", body)).when(k % 5 == 1, F.concat(F.lit("<description> </description>"), tag("content:encoded", body))).when(k % 5 == 2, tag("summary", body)).otherwise("")
    rss = tag("item", F.concat(tag("title", title), tag("link", link), F.coalesce(tag("dc:creator", credit), F.lit("")), F.when(k % 6 != 0, tag("pubDate", F.concat(F.lit("Mon, "), date, F.lit(" +0000")))).otherwise("<pubDate>soon</pubDate>"), rss_body))
    atom = tag("entry", F.concat(
        tag("title", title), F.lit('<link href="'), link, F.lit('"/>'), F.coalesce(tag("author", tag("name", credit)), F.lit("")),
        F.when(k % 6 != 0, tag("updated", F.concat(iso, F.lit("+00:00")))).otherwise(""), F.when(k % 5 == 0, tag("summary", body)).when(k % 5 == 1, tag("content", body)).otherwise(""),
    ))
    entries = d.select(feed.alias("f"), F.struct(k.alias("k"), F.when(feed % 2 == 0, rss).otherwise(atom).alias("x")).alias("e"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]), "")  # 20 documents to a feed
    bodies = entries.groupBy("f").agg(joined.alias("x"))
    head = F.when(F.col("f") % 7 == 3, '<!DOCTYPE r [<!ENTITY x "y">]>').otherwise("")
    full = F.when(F.col("f") % 2 == 0, F.concat(head, F.lit('<rss xmlns:dc="d" xmlns:content="c"><channel>'), F.col("x"), F.lit("</channel>"), F.when(F.col("f") % 7 == 2, "").otherwise("</rss>")))
    full = full.otherwise(F.concat(head, F.lit("<feed>"), F.col("x"), F.lit("</feed>")))
    status = F.when(F.col("f") % 7 == 5, 500).otherwise(200)
    return bodies.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("feed_id"), status.alias("status"), F.when(F.col("f") % 7 != 6, full).alias("body"))


_FETCHED = r"""
WITH d AS (SELECT doc_id AS k, doc_id // 20 AS f, 'f' || (doc_id // 20) AS feed_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]+', ' ', 'g')) AS plain,
  row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos FROM documents),
why AS (SELECT DISTINCT f, feed_id, CASE WHEN f % 7 = 5 THEN 'http 500' WHEN f % 7 = 6 THEN 'missing' WHEN f % 7 = 3 THEN 'entities' WHEN f % 7 = 2 AND f % 2 = 0 THEN 'not a feed' END AS error FROM d),
t AS (SELECT d.*, error, trim(substr(plain, 1, 40) || ' & ' || k) || CASE WHEN k % 3 = 0 THEN ' - Outlet One' ELSE '' END AS title FROM d JOIN why USING (f)),
i AS (SELECT feed_id, CAST(pos AS INT) AS pos, CASE WHEN k % 3 = 0 AND length(title) - 13 > 20 THEN left(title, length(title) - 13) ELSE title END AS headline,
    CASE WHEN k % 3 = 0 AND length(title) - 13 > 20 THEN 'Outlet One' ELSE feed_id END AS source,
    CASE k % 4 WHEN 0 THEN 'Mona Adel' WHEN 2 THEN 'Ann Bee' END AS author, 'https://a.example/' || k AS url,
    CASE WHEN k % 6 <> 0 THEN CAST(TIMESTAMP '2024-01-31' - to_hours(CAST(k AS INT)) AS TIMESTAMP) END AS published_at,
    CASE WHEN k % 5 < 2 OR (k % 5 = 2 AND f % 2 = 0) THEN substr(trim(regexp_replace(substr(plain, 1, 400), '\s+', ' ', 'g')), 1, 300) ELSE '' END AS snippet
  FROM t WHERE error IS NULL AND k % 11 <> 0),
v AS (SELECT * FROM i WHERE length(headline) > 15)
"""


@query(_FETCHED + "SELECT * FROM v", views=False)
def feed_scan(spark, sf_dir):
    """The valid items of feeds made of documents, with every field."""
    return feeds.scan(_fetched(spark, sf_dir))[0].withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(_FETCHED + """SELECT feed_id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM d WHERE d.f = why.f) ELSE 0 END AS entries,
  (SELECT count(*) FROM v WHERE v.feed_id = why.feed_id) AS valid FROM why""", views=False)
def feed_scan_health(spark, sf_dir):
    """The health row of each feed of ``feed_scan``."""
    return feeds.scan(_fetched(spark, sf_dir))[1]


def _carried(spark, sf_dir):
    """Stories by outlet, one byline in nine being the outlet's own name."""
    rows = trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir))
    return rows.withColumn("byline", F.when(F.col("id") % 9 == 0, F.concat(F.lit("The "), F.initcap("outlet"))).otherwise(F.col("byline")))


_BYLINES = registry._CARRIED + """
, named AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'The ' || upper(outlet[1]) || lower(outlet[2:]) ELSE byline END AS credit FROM carried)
, people AS (SELECT * FROM named WHERE credit IS NOT NULL AND trim(credit) NOT IN ('', '—') AND id % 9 <> 0)
"""


@query(_BYLINES + """
, once AS (SELECT * FROM (SELECT *, lower(trim(credit)) AS key, row_number() OVER (PARTITION BY lower(trim(credit)), id ORDER BY pos, outlet) AS k FROM people) WHERE k = 1)
SELECT key, arg_min(credit, id) AS author, count(*) AS mentions, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative' AND brand = 'home') AS home_negative FROM once GROUP BY key""")
def people_board(spark, sf_dir):
    """The whole author board of people: credits that read like a publication are no authors."""
    return trends.author_leaderboard(trends.people(_carried(spark, sf_dir)), S.HOME, None).drop("outlets")


def _series_sql(rows: str, key: str) -> str:
    return f"""
, d AS (SELECT {key} AS key, date_diff('day', DATE '2024-01-01', day) AS i, count(*) AS n FROM ({rows}) JOIN (SELECT id AS sid, day FROM stories) ON sid = id
  WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL)
, a AS (SELECT k.key, x.i, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT key FROM d) k CROSS JOIN range(31) AS x(i) LEFT JOIN d ON d.key = k.key AND d.i = x.i)
SELECT key, CAST(sum(n) AS BIGINT) AS total, list(CAST(n AS BIGINT) ORDER BY i) AS series FROM a GROUP BY key"""


_ONCE = "SELECT * FROM (SELECT *, lower(trim({0})) AS k, row_number() OVER (PARTITION BY lower(trim({0})), id ORDER BY pos, outlet) AS n_ FROM {1} WHERE {0} <> '') WHERE n_ = 1"


def _on_axis(rows):
    return rows.withColumn("idx", F.datediff("day", F.lit(registry.FIRST)))


@query(registry._CARRIED + _series_sql(_ONCE.format("outlet", "carried"), "k"))
def outlet_series(spark, sf_dir):
    rows = trends.carried(S.stories(spark, sf_dir), S.coverage(spark, sf_dir))
    return trends.series(_on_axis(trends.once_per_key(rows, F.lower(F.trim("outlet")))), F.col("key"), 31)


@query(_BYLINES + _series_sql(_ONCE.format("credit", "people"), "k"))
def author_series(spark, sf_dir):
    return trends.series(_on_axis(trends.once_per_key(trends.people(_carried(spark, sf_dir)), F.lower(F.trim("byline")))), F.col("key"), 31)


@query(_series_sql("SELECT id, coalesce(category, 'other') AS c FROM stories", "c"))
def category_series(spark, sf_dir):
    return trends.series(_on_axis(S.stories(spark, sf_dir)), F.coalesce("category", F.lit("other")), 31)


@query(registry._PERIODS + """
SELECT count(*) FILTER (now) AS now, count(*) FILTER (NOT now) AS before, count(DISTINCT trim(source)) FILTER (now) AS sources_now,
  count(DISTINCT trim(source)) FILTER (NOT now) AS sources_before FROM p""")
def report_sources(spark, sf_dir):
    return reports.sources(reports.periods(S.stories(spark, sf_dir), *registry.RANGE))


@query(registry._PERIODS + """
, n AS (SELECT * FROM p WHERE now ORDER BY "at" DESC, id LIMIT 400), t AS (SELECT greatest(count(*) - 400, 0) AS truncated FROM p WHERE now)
SELECT id, CASE WHEN brand = 'other' THEN 'Market' ELSE brand END AS grp, "at", source, sentiment, importance,
  row_number() OVER (ORDER BY list_position(['home', 'rival_a', 'rival_b', 'rival_c', 'other'], brand), "at" DESC, id) AS place, truncated FROM n, t""")
def report_appendix(spark, sf_dir):
    return reports.appendix(reports.periods(S.stories(spark, sf_dir), *registry.RANGE), S.BRANDS, "Market")


@query("""
WITH u AS (SELECT conv_id * 100 + turn AS id, role AS stage, CASE WHEN conv_id % 10 <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(conv_id % 60 AS INT)) - to_minutes(CAST(turn AS INT)) END AS created_at,
  CASE WHEN turn % 3 = 0 THEN length(text) ELSE 0 END AS w, CASE WHEN turn % 3 = 1 THEN length(text) * 2 ELSE 0 END AS r FROM conversations),
k AS (SELECT * FROM u WHERE stage IN ('assistant', 'system') AND (created_at IS NULL OR created_at >= TIMESTAMP '2024-01-30'))
SELECT count(*) FILTER (r + w > 0) AS calls, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(w) AS BIGINT) AS writes,
  coalesce(arg_max(r + w > 0, {'a': created_at, 'b': id}) FILTER (created_at IS NOT NULL), false) AS still_caching, round(sum(r) / (sum(r) + sum(w)), 6) AS ratio FROM k""", views=False)
def cache_efficiency(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n, at = F.length("text").cast("long"), F.lit(NOW).cast("timestamp_ntz")
    at = F.when(F.col("conv_id") % 10 != 0, at - F.make_dt_interval(hours=(F.col("conv_id") % 60).cast("int"), mins=F.col("turn").cast("int")))
    usage = c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("stage"), at.alias("created_at"),
        F.when(F.col("turn") % 3 == 0, n).otherwise(0).alias("cache_write"), F.when(F.col("turn") % 3 == 1, n * 2).otherwise(0).alias("cache_read"),
    )
    return health.cache_efficiency(usage, ("assistant", "system"), NOW)


@query("""SELECT count(*) AS eligible FROM stories WHERE id % 4 <> 0 AND importance >= 2 AND seen_at >= TIMESTAMP '2024-01-28 05:00:00' AND seen_at < TIMESTAMP '2024-01-29 05:00:00'""")
def digest_eligible(spark, sf_dir):
    rows = S.stories(spark, sf_dir).withColumn("is_relevant", F.col("id") % 4 != 0)
    return health.digest_eligible(rows, NOW, datetime(2024, 1, 29, 5))


@query("""SELECT id, id % 2 = 0 AND NOT (id % 30 IN (6, 7)) AS is_relevant FROM stories""")
def merged_stories(spark, sf_dir):
    """The other half of a merge: the dropped stories are hidden, all others stay as they are."""
    rows = S.stories(spark, sf_dir).withColumns({"is_relevant": F.col("id") % 2 == 0, "url": F.concat(F.lit("s"), F.col("user_id").cast("string"))})
    cov = S.coverage(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), F.col("pos").cast("string"), F.col("outlet")))
    pairs = rows.where("id % 30 in (6, 7)").select(F.col("id").alias("drop_id"), (F.col("id") - 3).alias("keep_id"))
    return ingest.merge_duplicates(rows, cov, pairs)[0].select("id", "is_relevant")


@query("""
, c AS (SELECT item_id, outlet, author, 'u' || pos AS url, CASE WHEN pos < 2 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(pos * 5 + item_id % 7 AS INT)) END AS published_at FROM instances)
SELECT item_id, count(*) AS n, string_agg(outlet || '|' || url, ',' ORDER BY published_at NULLS LAST, outlet, url) AS shown FROM c WHERE item_id % 2 = 0 GROUP BY item_id""")
def coverage_lists(spark, sf_dir):
    """The instances of the even stories, earliest first."""
    at = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("pos") * 5 + F.col("item_id") % 7).cast("int"))
    cov = S.coverage(spark, sf_dir).select("item_id", "outlet", "author", F.concat(F.lit("u"), F.col("pos").cast("string")).alias("url"), F.when(F.col("pos") < 2, at).alias("published_at"))
    found = board.coverage_lists(cov, S.stories(spark, sf_dir).where("id % 2 = 0").select("id"))
    shown = F.array_join(F.transform("instances", lambda x: F.concat(x["outlet"], F.lit("|"), x["url"])), ",")
    return found.select("item_id", F.size("instances").cast("long").alias("n"), shown.alias("shown"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_acctbal, c_nationkey, c_mktsegment FROM customer), q AS (
SELECT 'access' AS queue, id, row_number() OVER (ORDER BY c_acctbal, id) AS place FROM c WHERE c_nationkey % 3 = 0 UNION ALL
SELECT 'resets', id, row_number() OVER (ORDER BY c_acctbal DESC, id) FROM c WHERE c_nationkey % 3 = 1 UNION ALL
SELECT 'subscribers', id, row_number() OVER (ORDER BY id) FROM c WHERE c_mktsegment = 'BUILDING' UNION ALL
SELECT 'feedback', id, row_number() OVER (ORDER BY c_nationkey % 2, c_acctbal DESC, id) FROM c UNION ALL
SELECT 'users', id, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, id) FROM c)
SELECT queue, CAST(id AS VARCHAR) AS id, place FROM q""", views=False)
def desk_queues(spark, sf_dir):
    """The five queues of the desk over customers: access and resets, active subscribers, feedback (open first), users by role."""
    c = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    i, old, new, k = F.col("id").asc(), F.col("c_acctbal").asc(), F.col("c_acctbal").desc(), F.col("c_nationkey")
    return board.queues({
        "access": (c, k % 3 == 0, [old, i]), "resets": (c, k % 3 == 1, [new, i]), "subscribers": (c, F.col("c_mktsegment") == "BUILDING", [i]),
        "feedback": (c, F.lit(True), [(k % 2).asc(), new, i]), "users": (c, F.lit(True), [F.col("c_mktsegment").asc(), new, i]),
    }, staged)


@query("""
WITH a AS (SELECT item_id, 'engine ' || item_id % 3 AS engine, item_id % 13 <> 0 AS judged, CASE item_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'mixed' END AS s,
  item_id % 9 AS sev, item_id % 6 = 0 AS framing, item_id % 5 AS issues FROM benchmark),
f AS (SELECT *, judged AND (framing OR issues > 3 OR s = 'negative') AS flagged, CASE WHEN judged THEN CAST(greatest(1, least(5, sev)) AS DOUBLE) END AS severity FROM a)
SELECT engine, count(*) AS checked, count(*) FILTER (flagged) AS flagged, max(severity) AS worst FROM f GROUP BY engine""", views=False)
def audit_summary(spark, sf_dir):
    """Benchmark items as answers of three engines with verdicts of all shapes."""
    k = F.col("item_id")
    issues = F.when(k % 5 > 3, F.array(F.lit(""), F.lit("wrong owner"))).when(k % 5 > 0, F.array(F.lit(""), F.lit(None)))
    answers = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("engine "), (k % 3).cast("string")).alias("engine"), F.col("text").alias("question"), (k % 13 != 0).alias("judged"),
        F.when(k % 4 == 0, "negative").when(k % 4 == 1, "positive").when(k % 4 == 2, "mixed").alias("sentiment"), (k % 9).cast("string").alias("severity"),
        F.when(k % 6 == 0, True).alias("negative_framing"), issues.alias("issues"), F.lit("note").alias("note"),
    )
    return health.audit_summary(health.audit_findings(answers))


@query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
c AS (SELECT page_id, html, CASE WHEN regexp_matches(html, '(?i)<(article|main)[\s>]') THEN length(regexp_extract(html, '(?is)^(.*?)<(?:article|main)[\s>]', 1))
  WHEN regexp_matches(html, '(?i)<h1[\s>]') THEN length(regexp_extract(html, '(?is)^(.*?)<h1[\s>]', 1)) ELSE 0 END AS at_ FROM p)
SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(html, at_ + 1), '(?is)<script.*?</script>', ' ', 'g'),
  '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '\s+', ' ', 'g')), 1, 3500) AS text FROM c""", views=False)
def article_texts(spark, sf_dir):
    """The opening of each page's article; 3,500 characters are what the byline check reads."""
    return table(spark, sf_dir, "pages").select("page_id", T.article_text(F.col("html")).alias("text"))


@query("""
SELECT lower(event_type) AS status, count(*) AS n, lower(event_type) IN ('error', 'signup') AS bad FROM events
WHERE (event_id % 50 = 0 OR CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-29 22:00:00') AND user_id % 3 < 2 GROUP BY ALL""", views=False)
def recent_delivery(spark, sf_dir):
    """Sends of one sender in the last 26 hours by status; one in fifty is undated."""
    e = table(spark, sf_dir, "events")
    sender = F.when(F.col("user_id") % 3 == 0, "Desk <Desk@A.example>").when(F.col("user_id") % 3 == 1, "desk@a.example ").otherwise("other@a.example")
    log = e.select(F.initcap("event_type").alias("status"), sender.alias("sender"), F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp_ntz")).alias("created_at"))
    return ledger.recent_delivery(log, ("error", "signup"), "desk@a.example", NOW)


@query("""
WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS line, o_orderkey % 7 AS k FROM orders),
s AS (SELECT *, CASE WHEN k < 5 AND DATE '2001-09-01' - d > 45 THEN 1 ELSE 0 END AS stale, DATE '2001-09-01' - d AS age FROM o)
SELECT id, CASE WHEN k = 6 THEN 'unknown' WHEN k = 5 THEN 'ok' WHEN stale > 0 OR age > 60 THEN 'warn' ELSE 'ok' END AS state, CAST(stale AS BIGINT) AS stale,
  CASE WHEN stale > 0 THEN line END AS oldest, CAST(age AS BIGINT) AS age_days FROM s""", views=False)
def document_reviews(spark, sf_dir):
    """Orders as documents of one dated line; some are empty or could not be read."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    line = F.concat(F.lit("["), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("] "), F.col("o_orderpriority"))
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    docs = o.select(F.col("o_orderkey").alias("id"), F.when(k < 5, line).when(k == 5, " \n").alias("content"), day.alias("updated_at"))
    return board.document_review(docs, datetime(2001, 9, 1))


@query("""SELECT id, "at" FROM stories WHERE id % 4 <> 0 AND "at" >= TIMESTAMP '2024-01-24' ORDER BY "at" DESC, importance DESC, id LIMIT 200""")
def board_newest(spark, sf_dir):
    return board.newest_first(S.stories(spark, sf_dir).withColumn("is_relevant", F.col("id") % 4 != 0), NOW).select("id", "at")


@query("""SELECT id, count(*) OVER () AS shown, CAST(5 AS BIGINT) AS total, count(*) OVER () < 5 AS subset FROM stories WHERE id IN (3, 14, 159)""")
def board_linked(spark, sf_dir):
    return board.linked(S.stories(spark, sf_dir), ["3", 14, "x", " 159 ", "-2"], 5).select("id", "shown", "total", "subset")


@query("""
, r AS (SELECT *, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS team_share, CASE WHEN id % 10 <> 5 THEN seen_at END AS stamp, id % 3 AS tier, CASE id % 7 WHEN 0 THEN -1 WHEN 1 THEN 1 END AS feedback
  FROM stories WHERE id % 4 <> 0 AND "at" >= TIMESTAMP '2024-01-24'),
p AS (SELECT *, CASE WHEN team_share AND (stamp IS NULL OR stamp >= TIMESTAMP '2024-01-28') THEN 'pinned' WHEN NOT team_share THEN 'hidden' ELSE 'auto' END AS pin FROM r)
SELECT id, pin FROM p WHERE pin = 'pinned' OR (pin = 'auto' AND tier = 1 AND importance >= 2 AND coalesce(feedback, 0) <> -1)""")
def team_board(spark, sf_dir):
    """Stories with pins, hides and thumbs; pins hold three days."""
    k = F.col("id")
    rows = S.stories(spark, sf_dir).withColumns({
        "is_relevant": k % 4 != 0, "team_share": F.when(k % 5 == 0, True).when(k % 5 == 1, False), "team_share_at": F.when(k % 10 != 5, F.col("seen_at")),
        "tier": k % 3, "feedback": F.when(k % 7 == 0, -1).when(k % 7 == 1, 1),
    })
    return board.team_board(rows, NOW, 7, 3).select("id", "pin")
