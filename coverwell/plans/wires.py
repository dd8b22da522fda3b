"""Queries of feed and mail text, of bylines, of the run ledger and of the health ladders, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from coverwell.functions import wires
from coverwell.operators import bylines, runs
from coverwell.plans.registry import query
from coverwell.sources import tables as S
from coverwell.sources.tables import NOW, table

SEARCH = "https://news.example/rss/search"
WRAPPER = "news.example"


@query(f"""
WITH q AS (SELECT p_partkey, '"' || p_name || '" OR (' || p_type || ') ~ it''s 5*2! & ' || chr(1601 + CAST(p_size % 20 AS INT)) || ' when:2d' AS q FROM part)
SELECT p_partkey, '{SEARCH}?q=' || replace(replace(replace(replace(replace(url_encode(q), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')
  || '&hl=ar&gl=EG&ceid=EG:ar' AS url FROM q""", views=False)
def search_urls(spark, sf_dir):
    letter = F.substring(F.lit("".join(chr(1601 + i) for i in range(20))), (F.col("p_size") % 20 + 1).cast("int"), F.lit(1))
    q = F.concat(F.lit('"'), F.col("p_name"), F.lit('" OR ('), F.col("p_type"), F.lit(") ~ it's 5*2! & "), letter)
    return table(spark, sf_dir, "part").select("p_partkey", wires.search_url(q, "ar", SEARCH).alias("url"))


@query(f"""
WITH esc AS (SELECT p_partkey, replace(replace(url_encode('"' || p_name || '" when:2d'), '%28', '('), '%29', ')') AS q FROM part),
st AS (SELECT n_regionkey, '(' || string_agg('site%3A' || lower(replace(n_name, ' ', '-')) || '.example', '%20OR%20' ORDER BY n_nationkey) || ')' AS q FROM nation GROUP BY 1)
SELECT 'p' || p_partkey AS feed_id, p_brand AS brand, '{SEARCH}?q=' || q || CASE WHEN p_partkey % 2 = 0 THEN '&hl=en-US&gl=US&ceid=US:en' ELSE '&hl=ar&gl=EG&ceid=EG:ar' END AS url, false AS direct, true AS urgent
FROM esc JOIN part USING (p_partkey)
UNION ALL SELECT 'r' || r_regionkey, NULL, '{SEARCH}?q=' || st.q || '%20(home%20OR%20rival)%20when%3A2d&hl=ar&gl=EG&ceid=EG:ar', true, false FROM region JOIN st ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, NULL, 'https://feeds.example/' || s_suppkey, true, false FROM supplier""", views=False)
def feed_registry(spark, sf_dir):
    """Parts as searches by name, regions as groups of their nations' sites, suppliers as outlets with a feed of their own."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    p = table(spark, sf_dir, "part")
    queries = p.select(key("p", "p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("q"), F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("ar").alias("locale"))
    domain = F.concat(F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-"))), F.lit(".example"))
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", domain.alias("d")))).alias("ds"))
    sites = table(spark, sf_dir, "region").join(own, F.col("n_regionkey") == F.col("r_regionkey"))
    sites = sites.select(key("r", "r_regionkey").alias("id"), F.transform("ds", lambda x: x["d"]).alias("domains"), F.lit("(home OR rival)").alias("terms"), F.lit("ar").alias("locale"))
    direct = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), F.concat(F.lit("https://feeds.example/"), F.col("s_suppkey").cast("string")).alias("url"))
    return runs.feed_registry(queries, sites, direct, SEARCH)


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS wrapped, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN NOT wrapped THEN 'https://a.example/' || CAST(o_orderkey AS VARCHAR)
  WHEN o_custkey % 5 > 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) THEN 'https://b.example/' || CAST(o_custkey AS VARCHAR)
  ELSE 'https://www.news.example/' || CAST(o_custkey AS VARCHAR) END AS resolved_url FROM r""", views=False)
def decoded_links(spark, sf_dir):
    key = lambda c: F.col(c).cast("string")
    wrapped = F.concat(F.lit("https://www.news.example/"), key("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, wrapped).otherwise(F.concat(F.lit("https://a.example/"), key("o_orderkey"))).alias("url"))
    c = table(spark, sf_dir, "customer").withColumn("url", F.concat(F.lit("https://www.news.example/"), key("c_custkey")))
    known = c.select("url", F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("https://b.example/"), key("c_custkey"))).otherwise(F.col("url")).alias("target"))
    return runs.decode_links(rows, known, WRAPPER).select("o_orderkey", "resolved_url")


@query("""
SELECT page_id, regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '(^|[.])example[.]com$') AS wrapped FROM pages""", views=False)
def wrapper_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", wires.wrapper_host(F.col("url"), "example.com").alias("wrapped"))


@query("""
SELECT c_custkey, c_name || chr(CAST(64 + c_custkey % 5000 AS INT)) || ' ' || chr(CAST(128512 + c_custkey % 40 AS INT)) || '…&bogus;<&#0;&#xD800;&#99999999999; &' AS text FROM customer""", views=False)
def decoded_entities(spark, sf_dir):
    code, face = (64 + F.col("c_custkey") % 5000).cast("string"), F.hex(128512 + F.col("c_custkey") % 40)
    coded = F.concat("c_name", F.lit("&amp;#"), code, F.lit("; &#x"), face, F.lit(";&hellip;&bogus;&LT;&#0;&#xD800;&#99999999999; &amp;"))
    return table(spark, sf_dir, "customer").select("c_custkey", wires.decode_entities(coded).alias("text"))


@query("""
WITH d AS (SELECT c_custkey, '2023-' || lpad(CAST(c_custkey % 15 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0') AS d FROM customer)
SELECT c_custkey, CASE WHEN TRY_CAST(d AS DATE) IS NOT NULL THEN d END AS day FROM d""", views=False)
def clean_dates(spark, sf_dir):
    two = lambda n: F.lpad((F.col("c_custkey") % n).cast("string"), 2, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", wires.clean_date(F.concat(F.lit("2023-"), two(15), F.lit("-"), two(33))).alias("day"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n,
  CASE WHEN p_size % 2 = 0 THEN 'call ' || p_brand ELSE p_type END AS action FROM part""", views=False)
def angle_actions(spark, sf_dir):
    act = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ACTION - call "), F.col("p_brand"), F.lit("\n"))).otherwise("Action: — \n")
    text = F.concat(F.lit("no label here\r\n Read · "), F.col("p_name"), F.lit("\n"), act, F.lit("\nPublic / press: "), F.col("p_type"))
    lines = wires.angle_lines(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(lines).cast("long").alias("n"), wires.action_line(lines).alias("action"))


@query("""
, a AS (SELECT id, importance, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us("at")) / 3600000000) AS h FROM stories)
SELECT id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN CAST(CAST(floor(h + 0.5) AS BIGINT) AS VARCHAR) || 'h ago'
  ELSE CAST(CAST(floor(h / 24 + 0.5) AS BIGINT) AS VARCHAR) || 'd ago' END AS age, greatest(1, least(5, (importance - 1) * 2)) AS level FROM a""")
def age_labels(spark, sf_dir):
    return S.stories(spark, sf_dir).select("id", wires.age_label(F.col("at"), NOW).alias("age"), wires.impact_level((F.col("importance") - 1) * 2).alias("level"))


@query("""
SELECT s_suppkey, s_name AS name, CAST(s_suppkey AS VARCHAR) || '@a.example' AS email FROM supplier
UNION ALL SELECT s_suppkey, NULL, 'desk@b.example' FROM supplier""", views=False)
def recipients_named(spark, sf_dir):
    csv = F.concat(F.lit(" , "), "s_name", F.lit(" < "), F.col("s_suppkey").cast("string"), F.lit("@a.example>,, desk@b.example "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(wires.named_recipients(csv)))


@query(r"""
SELECT doc_id, sha256('<source_text>' || chr(10) || regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', ' ', 'g') || '( / SOURCE_text ) ' || chr(10) || '</source_text>') AS hash
FROM documents""", views=False)
def fenced_texts(spark, sf_dir):
    body = wires.neutralised(F.concat(F.coalesce("text", F.lit("")), F.lit("< / SOURCE_text >\x07")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(wires.fenced(body), "UTF-8"), 256).alias("hash"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN '[{"id":' || CAST(c_custkey AS VARCHAR) || ',"ok":true}]' END AS answer FROM customer""", views=False)
def salvaged_answers(spark, sf_dir):
    array = F.concat(F.lit('[ {"id": '), F.col("c_custkey").cast("string"), F.lit(', "ok": true} ]'))
    said = F.when(F.col("c_custkey") % 3 == 0, array).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Here it is:\n"), array, F.lit("\nAsk me more."))).otherwise("none")
    return table(spark, sf_dir, "customer").select("c_custkey", wires.salvaged_json(said).alias("answer"))


_LEDGER = """WITH r AS (SELECT event_id AS id, event_type AS job, CAST(ts AS TIMESTAMP) AS started_at, CAST(value * 100 AS BIGINT) AS duration_ms,
  CASE WHEN event_id % 90 = 0 THEN 'running' WHEN event_id % 50 = 0 THEN 'error' ELSE 'ok' END AS status FROM events)"""


@query(_LEDGER + """, l AS (SELECT job, max(started_at) AS last FROM r WHERE job IN ('view', 'click', 'signup') GROUP BY job),
n AS (SELECT count(*) AS n FROM l WHERE (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 3600000000 > CASE job WHEN 'view' THEN 2 WHEN 'click' THEN 0.001 ELSE 200 END),
s AS (SELECT count(*) FILTER (status = 'running' AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(started_at)) / 60000000 > 30) AS n FROM r)
SELECT 'runs' AS "check", CASE WHEN n > 0 THEN 'crit' ELSE 'ok' END AS state, n FROM n UNION ALL SELECT 'runstall', 'warn', n FROM s""", views=False)
def run_checks(spark, sf_dir):
    status = F.when(F.col("event_id") % 90 == 0, "running").when(F.col("event_id") % 50 == 0, "error").otherwise("ok")
    ledger = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job"), status.alias("status"), F.col("ts").cast("timestamp_ntz").alias("started_at"), F.round(F.col("value") * 100).cast("long").alias("duration_ms")
    )
    return runs.run_checks(ledger, {"view": 2.0, "click": 0.001, "signup": 200.0}, NOW)


@query("""
SELECT brand, CASE WHEN max(seen_at) IS NULL OR (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(seen_at))) / 3600000000 > 20 THEN 'crit'
    WHEN (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(seen_at))) / 3600000000 > 8 THEN 'warn' ELSE 'ok' END AS freshness,
  CASE WHEN count(*) FILTER (id % 25 = 0) >= 20 THEN 'crit' WHEN count(*) FILTER (id % 25 = 0) > 0 THEN 'warn' ELSE 'ok' END AS parked,
  CASE WHEN count(*) / 250.0 >= 0.9 THEN 'crit' WHEN count(*) / 250.0 >= 0.6 THEN 'warn' ELSE 'ok' END AS storage,
  CASE WHEN max(published_at) >= TIMESTAMP '2024-01-30 05:00:00' THEN 'ok' WHEN count(*) FILTER (importance = 5) > 0 THEN 'crit' ELSE 'ok' END AS brief
FROM stories GROUP BY brand""")
def health_ladders(spark, sf_dir):
    by = S.stories(spark, sf_dir).groupBy("brand").agg(
        F.max("seen_at").alias("seen"), F.max("published_at").alias("sent"), F.count("*").alias("n"), F.count_if(F.col("id") % 25 == 0).alias("p"), F.count_if(F.col("importance") == 5).alias("w")
    )
    due = runs.brief_due(datetime(2024, 1, 31, 5, 30))
    return by.select(
        "brand", runs.freshness_state(F.col("seen"), datetime(2024, 1, 31, 12)).alias("freshness"), runs.parked_state(F.col("p")).alias("parked"),
        runs.storage_state(F.col("n"), F.lit(250.0)).alias("storage"), runs.brief_state(F.col("sent"), F.col("w"), due).alias("brief"),
    )


@query("""
, o AS (SELECT CASE WHEN author IS NOT NULL AND id % 11 > 0 THEN 'filled' WHEN author IS NOT NULL THEN 'writeFailed' WHEN id % 5 = 0 THEN 'unresolved'
  WHEN id % 2 = 0 THEN 'noByline' ELSE 'fetchFailed' END AS outcome FROM stories WHERE importance > 0)
SELECT v.outcome, count(o.outcome) AS n FROM (VALUES ('filled'), ('unresolved'), ('fetchFailed'), ('noByline'), ('writeFailed')) AS v(outcome) LEFT JOIN o USING (outcome) GROUP BY v.outcome""")
def backfill_outcomes(spark, sf_dir):
    rows = S.stories(spark, sf_dir).withColumns({"fetchable": F.col("id") % 5 > 0, "fetched": F.col("id") % 2 == 0, "written": F.col("id") % 11 > 0})
    return runs.backfill_outcomes(rows)


#: A credit for every rule, the page's headline being "Axis Marco speaks" and its outlet "The Outlet".
CREDITS = [
    ("By Rana Mamdouh", "ok", "Rana Mamdouh"), ("rana@site.example", "email", None), ("Staff Writer", "desk-word", None), ("Search here now", "ui-junk", None),
    ('x" data-astro', "markup", None), ("one-two-three", "slug", None), ("Mona Friday", "dateline-word", None), ("Fintech Gate", "outlet-name", None),
    ("The Outlet - Exclusive", "no-person-segment", None), ("R2 D2", "not-name-shaped", None), ("Fintech Gate: Riham Ali", "ok", "Riham Ali"),
    ("Rana Mamdouh, Sara Seif", "ok", "Rana Mamdouh"), ("Axis Marco", "in-headline", None), ("  ", "empty", None), ("كتب محمد أحمد", "ok", "محمد أحمد"),
]
#: Pages that name their writer in one way each.
PAGES = [
    ('<script type="application/ld+json">{"@graph":[{"author":[{"name":"%s"},"Cee Dee"]}]}</script>', "json-ld"),
    ('<meta content="%s" name="author"><p class="byline">By Cee Dee</p>', "meta"), ('<a class="x" href="/author/a">%s</a>', "byline"),
    ("<p>Prices rise: Axis CEO %s , Thursday 6 Aug 2026</p>", "dateline"),
]
_text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_list = lambda vs: f"[{', '.join(map(_text, vs))}]"


@query(f"""SELECT c_custkey, {_list(c[1] for c in CREDITS)}[c_custkey % {len(CREDITS)} + 1] AS reason, {_list(c[2] for c in CREDITS)}[c_custkey % {len(CREDITS)} + 1] AS name
FROM customer""", views=False)
def byline_verdicts(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(c[0]) for c in CREDITS]), (F.col("c_custkey") % len(CREDITS)).cast("int"))
    v = bylines.judge(raw, F.lit("The Outlet"), F.lit("Axis Marco speaks"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", "v.reason", F.when(F.col("v.ok"), F.col("v.name")).alias("name"))


@query(f"""SELECT c_custkey, {_list(p[1] for p in PAGES)}[c_custkey % {len(PAGES)} + 1] AS source, 'Ann ' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'eel' AS name FROM customer""", views=False)
def byline_trace(spark, sf_dir):
    writer = F.concat(F.lit("Ann "), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("c_custkey") % 26 + 1).cast("int"), F.lit(1)), F.lit("eel"))
    html = F.replace(F.get(F.array(*[F.lit(p[0]) for p in PAGES]), (F.col("c_custkey") % len(PAGES)).cast("int")), F.lit("%s"), writer)
    rows = table(spark, sf_dir, "customer").select("c_custkey", bylines.trace(html, F.lit("The Outlet"), F.lit(None).cast("string")).alias("t"))
    return rows.select("c_custkey", F.get("t", F.lit(0))["source"].alias("source"), bylines.byline(F.col("t")).alias("name"))


@query()
def byline_candidates(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", bylines.candidates(F.col("html")).alias("c"))
    return found.select("page_id", F.array_join(F.transform("c", lambda c: F.concat(c["source"], F.lit(":"), c["raw"])), "|").alias("names"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN ['json-ld', 'meta', 'byline', 'dateline'][doc_id % 8 + 1] WHEN doc_id % 8 = 6 THEN 'dateline' END AS source,
  CASE WHEN doc_id % 8 < 4 OR doc_id % 8 = 6 THEN 'Ann ' || chr(CAST(65 + n_nationkey AS INT)) || 'eel' END AS name
FROM documents JOIN nation ON n_nationkey = doc_id % 25""", views=False)
def byline_pages(spark, sf_dir):
    """Documents as pages with their whole text, signed in the ways that sites sign, by a desk, or not at all; writers come from the nations."""
    d = table(spark, sf_dir, "documents").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("doc_id") % 25)  # 25 rows
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n_nationkey") + 1, F.lit(1))
    name, k = F.concat(F.lit("Ann "), letter, F.lit("eel")), F.col("doc_id") % 8
    around = lambda before, after: F.concat(F.lit(before), name, F.lit(after))
    signed = F.when(k == 0, around('<script type="application/ld+json">{"@graph":[{"author":[{"name":"', '"},"Cee Dee"]},{"x":1}]}</script>'))
    signed = signed.when(k == 1, around('<meta content="', '" name="author"><p class="byline">By Cee Dee</p>')).when(k == 2, around('<div class="meta byline"> By ', "</div>"))
    signed = signed.when(k == 3, around("<p>Prices rise: Axis CEO ", " , Thursday 6 Aug 2026</p>")).when(k == 4, '<p class="byline">By Newsroom</p>')
    signed = signed.when(k == 6, around("<p>Prices rise: Axis CEO ", " , 6 \u0625\u0628\u0631\u064a\u0644 2026</p>")).otherwise("")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    html = F.concat(F.lit("<html><body>"), signed, F.lit("<p>"), text, F.lit("</p></body></html>"))
    t = d.select("doc_id", bylines.trace(html, F.lit("The Outlet"), F.lit(None).cast("string")).alias("t"))
    found = F.get(F.filter("t", lambda x: x["ok"]), F.lit(0))
    return t.select("doc_id", found["source"].alias("source"), found["name"].alias("name"))
