"""Edge cases of the feed scan, the boards' series, the desk's lists and the health figures."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from coverwell.functions import text as T
from coverwell.operators import board, filters, health, ledger, reports, trends
from coverwell.sources import feeds
from coverwell.sources.staging import shared_root, staged

NOW = datetime(2024, 1, 31)


def test_feed_scan_fields_and_health(spark):
    rss = (
        '<rss xmlns:dc="d" xmlns:content="c"><channel>'
        "<item><title>A headline of some length here - The Daily</title><link>https://x.example/1</link><dc:creator>By Mona Adel</dc:creator>"
        "<pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate><description> </description><content:encoded>&lt;p&gt;Body &amp;amp; more&lt;/p&gt;</content:encoded></item>"
        "<item><title>Too short</title><link>https://x.example/2</link></item>"
        "<item><title>No usable link in this headline</title><link>javascript:alert(1)</link></item>"
        "<item><title>Tom &amp;amp; Jerry without a date</title><link>https://x.example/3</link><author>newsroom</author><pubDate>soon</pubDate><summary>plain</summary></item>"
        "</channel></rss>"
    )
    atom = '<feed><entry><title>An entry of an Atom feed</title><link href="https://y.example/1"/><author><name>Ann Bee</name></author><updated>2024-01-30T10:00:00Z</updated></entry></feed>'
    many = "<rss><channel>" + "".join(f"<item><title>Headline number {i:05d} of many</title><link>https://z.example/{i}</link></item>" for i in range(100)) + "</channel></rss>"
    rows = [("rss", 200, rss), ("atom", 200, atom), ("many", 200, many), ("down", 503, rss), ("none", 200, None), ("cut", 200, "<rss><channel>"), ("page", 200, "<html></html>")]
    rows += [("evil", 200, '<!DOCTYPE r [<!ENTITY x "y">]><rss></rss>'), ("empty", 200, "<rss><channel></channel></rss>"), ("never", None, rss)]
    items, told = feeds.scan(spark.createDataFrame(rows, "feed_id string, status int, body string"))
    got = {(x.feed_id, x.pos): x for x in items.collect()}
    one, two, three = got["rss", 0], got["rss", 3], got["atom", 0]
    assert (one.headline, one.source, one.author, one.snippet) == ("A headline of some length here", "The Daily", "Mona Adel", "Body & more")
    assert one.published_at == three.published_at and (three.author, three.source, three.snippet) == ("Ann Bee", "atom", "")
    assert (two.headline, two.author, two.published_at, two.snippet) == ("Tom & Jerry without a date", None, None, "plain")
    assert {k for k in got if k[0] != "many"} == {("rss", 0), ("rss", 3), ("atom", 0)} and sum(k[0] == "many" for k in got) == 80
    assert {x.feed_id: (x.ok, x.error, x.entries, x.valid) for x in told.collect()} == {
        "rss": (True, None, 4, 2), "atom": (True, None, 1, 1), "many": (True, None, 80, 80), "down": (False, "http 503", 0, 0), "none": (False, "missing", 0, 0),
        "cut": (False, "not a feed", 0, 0), "page": (False, "not a feed", 0, 0), "evil": (False, "entities", 0, 0), "empty": (True, None, 0, 0), "never": (False, "http none", 0, 0),
    }


def test_items_and_links(spark):
    df = spark.createDataFrame([("x" * 15, "https://a.example"), ("x" * 16, "https://a.example"), ("x" * 16, "ftp://a"), (None, None)], "h string, u string")
    assert [r[0] for r in df.select(filters.valid_item(F.col("h"), F.col("u"))).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(filters.first_safe(F.col("u"), F.lit(" https://b.example "))).collect()] == ["https://a.example"] * 2 + ["https://b.example"] * 2


def test_subscribers_without_topics_get_all(spark):
    subs = spark.createDataFrame([("a", None), ("b", []), ("c", ["x", "x"]), ("d", ["none"])], "subscriber string, topics array<string>")
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, category string")
    got = filters.subscriber_items(subs, items).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 3)]


def test_series_and_people(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("a", 9), ("b", -1), (None, 1)], "k string, idx int")
    got = {x.key: (x.total, x.series) for x in trends.series(rows, F.col("k"), 3).collect()}
    assert got == {"a": (3, [1, 0, 2]), None: (1, [0, 1, 0])}
    names = [("Mona Adel", "Daily"), ("Daily", "The Daily"), ("News Gate", "x"), ("—", "x"), (" ", "x"), (None, "x"), ("Ann Bee", None)]
    kept = trends.people(spark.createDataFrame(names, "byline string, outlet string")).collect()
    assert sorted(x.byline for x in kept) == ["Ann Bee", "Mona Adel"]


def test_appendix_keeps_the_newest_and_says_what_is_left_out(spark):
    rows = [(i, ["rival", "home", "else"][i % 3], NOW - timedelta(hours=i), "s" if i else None, "neutral", 1, i < 9) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, brand string, at timestamp_ntz, source string, sentiment string, importance int, now boolean")
    got = reports.appendix(df, ("home", "rival"), "Market", 6).orderBy("place").collect()
    assert [(x.id, x.grp, x.truncated) for x in got] == [(1, "home", 3), (4, "home", 3), (0, "rival", 3), (3, "rival", 3), (2, "Market", 3), (5, "Market", 3)]
    assert tuple(reports.sources(df).first()) == (9, 3, 1, 1) and reports.appendix(df.limit(0), ("home",), "Market").collect() == []


@pytest.mark.parametrize("days, want", [(None, 30), ("", 30), ("7", 7), ("0", 30), ("-3", 1), ("999", 90), ("x", 30), (12.9, 12), ("inf", 30)])
def test_days_are_clamped(days, want):
    assert reports.clamped(days) == want


def test_cache_efficiency(spark):
    u = "id long, stage string, created_at timestamp_ntz, cache_read long, cache_write long"
    rows = [(i, "a", NOW - timedelta(hours=i), 3, 1) for i in range(4)] + [(9, "a", None, 4, 0), (10, "a", NOW - timedelta(hours=30), 99, 99), (11, "b", NOW, 99, 99)]
    got = health.cache_efficiency(spark.createDataFrame(rows, u), ("a",), NOW).first()
    assert (got.calls, got.reads, got.writes, got.still_caching, got.ratio) == (5, 16, 4, True, 0.8)
    last = health.cache_efficiency(spark.createDataFrame([*rows[1:], (12, "a", NOW, 0, 0)], u), ("a",), NOW).first()
    assert (last.calls, last.still_caching, last.ratio) == (4, False, None)
    assert tuple(health.cache_efficiency(spark.createDataFrame([], u), ("a",), NOW).first()) == (0, 0, 0, False, None)


def test_digest_window_end_is_movable(spark):
    rows = spark.createDataFrame([(True, 2, NOW), (True, 2, NOW - timedelta(hours=24)), (True, 1, NOW), (False, 5, NOW), (True, 3, NOW + timedelta(hours=1))], "is_relevant boolean, importance int, seen_at timestamp_ntz")
    assert health.digest_eligible(rows, NOW).first()[0] == 3 and health.digest_eligible(rows, NOW, NOW).first()[0] == 1


def test_audit_findings(spark):
    a = "engine string, question string, judged boolean, sentiment string, severity string, negative_framing boolean, issues array<string>, note string"
    rows = [
        ("e", "q", True, "mixed", "9", None, [], "n" * 400), ("e", "q", True, "negative", "x", False, None, None), ("f", "q", True, "positive", "0", False, ["", None, *"abcdefgh"], ""),
        ("f", "q", False, "negative", "5", True, ["x"], "n"), ("g", "q", None, None, None, None, None, None),
    ]
    found = health.audit_findings(spark.createDataFrame(rows, a))
    got = [(x.sentiment, x.severity, x.flagged, x.issues and len(x.issues), x.note and len(x.note)) for x in found.collect()]
    assert got[:3] == [("neutral", 5.0, False, [], 300), ("negative", 1.0, True, [], ""), ("positive", 1.0, True, 6, "")]
    assert [x.flagged for x in found.collect()][3:] == [False, False]
    assert sorted(map(tuple, health.audit_summary(found).collect())) == [("e", 2, 1, 5.0), ("f", 2, 1, 1.0), ("g", 1, 0, None)]


def test_queues_and_coverage_lists(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long").repartition(3)
    got = board.queues({"q": (rows, F.col("k") == 1, [F.col("id").desc()]), "none": (rows, F.lit(False), [F.col("id").asc()])}, staged).collect()
    assert [(x.queue, x.id) for x in sorted(got, key=lambda x: x.place)] == [("q", str(i)) for i in range(28, 0, -3)]
    c = spark.createDataFrame([(1, "b", None, "u2", NOW), (1, "a", "A", "u1", None), (1, "c", None, "u0", NOW - timedelta(1)), (2, "x", None, "u", NOW)], "item_id long, outlet string, author string, url string, published_at timestamp_ntz")
    lists = board.coverage_lists(c, spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()
    assert [(x.item_id, [i.outlet for i in x.instances]) for x in lists] == [(1, ["c", "b", "a"])]


def test_article_text_begins_at_the_article(spark):
    pages = ["<nav>menu</nav><ARTICLE class=x><h1>T</h1><script>x</script>a&nbsp;b <!-- c --></article>", "<p>menu</p><h1 id=1>T</h1>a", "<p>a\n b</p>", None, "x" * 4000, "<nav>n</nav><p>y</p><main>z</main><article>w</article>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    assert [r.t for r in df.select(T.article_text(F.col("html")).alias("t"), "i").orderBy("i").collect()] == ["T a b", "T a", "a b", "", "x" * 3500, "z w"]


def test_recent_delivery_is_the_senders(spark):
    rows = [("Sent", "Desk <D@a.b>", NOW), ("sent", " d@A.b ", None), ("bounced", "d@a.b", NOW - timedelta(hours=26)), ("bounced", "d@a.b", NOW - timedelta(hours=27)), ("", "d@a.b", NOW), ("sent", "e@a.b", NOW)]
    df = spark.createDataFrame(rows, "status string, sender string, created_at timestamp_ntz")
    assert sorted(map(tuple, ledger.recent_delivery(df, ("bounced",), "d@a.b", NOW).collect())) == [("bounced", 1, True), ("sent", 2, False)]
    assert sorted(map(tuple, ledger.recent_delivery(df, ("bounced",), None, NOW).collect())) == [("bounced", 1, True), ("sent", 3, False)]


def test_document_review(spark):
    day = lambda n: (NOW - timedelta(days=n)).strftime("%Y-%m-%d")
    rows = [(1, f"[{day(50)}] b\n[{day(70)}] a\n({day(3)}) c", NOW), (2, "text", NOW - timedelta(days=61)), (3, "text", NOW - timedelta(days=60)), (4, " \n", None), (5, None, None)]
    got = board.document_review(spark.createDataFrame(rows, "id long, content string, updated_at timestamp_ntz"), NOW).collect()
    assert {x.id: (x.state, x.stale, x.oldest) for x in got} == {1: ("warn", 2, "a"), 2: ("warn", 0, None), 3: ("ok", 0, None), 4: ("ok", 0, None), 5: ("unknown", 0, None)}


def test_a_cluster_needs_a_shared_folder(tmp_path):
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    assert shared_root(session("local[2]", None))
    for master in ("spark://x", "yarn", "local-cluster[1,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_root(session(master, None))


def test_pins_links_and_rising(spark):
    rows = [(1, True, NOW - timedelta(days=2)), (2, True, NOW - timedelta(days=4)), (3, True, None), (4, False, None), (5, None, None), (6, False, NOW)]
    df = spark.createDataFrame(rows, "id long, team_share boolean, team_share_at timestamp_ntz")
    assert [x.p for x in df.select(board.pin_state(NOW, 3).alias("p")).collect()] == ["pinned", "auto", "pinned", "hidden", "auto", "hidden"]
    assert [(x.id, x.shown, x.subset) for x in board.linked(df, [1, "9", 5], 2).collect()] == [(1, 2, False), (5, 2, False)]
    assert board.linked(df, ["x"], 2).collect() == []
    t = spark.createDataFrame([(1, "a", 5, True), (2, "b", 9, True), (3, "c", 99, False)], "thread long, name string, total long, rising boolean")
    assert [tuple(x) for x in board.rising_callout(t).collect()] == [("rising", "b", 2, None)] and board.rising_callout(t.where("not rising")).collect() == []


def test_subscribers_and_items_meet_in_chunks(spark):
    subs = spark.createDataFrame([(i, None if i % 10 == 0 else ["x"] if i % 2 else ["x", "y"]) for i in range(4000)], "subscriber long, topics array<string>")
    items = spark.createDataFrame([(j, ["x", "y", "z", None][j % 4]) for j in range(200)] + [(0, "y")], "id long, category string")
    got = filters.subscriber_items(subs, items)
    want = {(i, j) for i in range(4000) for j in range(200) if i % 10 == 0 or j % 4 == 0 or (i % 2 == 0 and j % 4 == 1)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want  # an item without a category goes to those who want all, and none comes twice
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("Join")  # no pair is moved
