"""Small cases of the analytics, and brute-force twins of the clusterings."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverwell.functions import text as T
from coverwell.operators import dedupe, filters, health, ledger, narratives, reports, surge, trends
from coverwell.plans import registry
from coverwell.sources.staging import staged


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_content_hash_deletes_punctuation_and_folds_case(spark):
    assert one(spark, "Hello, World!", T.content_hash) == one(spark, "hello world", T.content_hash)
    assert one(spark, "a-b", T.normal_form) == "ab"
    assert one(spark, None, T.content_hash) is None


def test_tokens(spark):
    assert one(spark, "The Quick, quick brown-fox said café", T.tokens) == ["quick", "brown"]
    assert one(spark, "المحمول في مصر", T.tokens) == ["المحمول"]
    assert one(spark, None, T.tokens) == []
    assert one(spark, "alpha beta gamma", T.phrases) == ["alpha beta", "beta gamma"]
    assert one(spark, "alpha", T.phrases) == []


def test_jaccard_of_empty_sets_is_zero(spark):
    row = spark.createDataFrame([([], ["a"], ["a", "b"])], "e array<string>, a array<string>, b array<string>")
    got = row.select(T.jaccard(F.col("e"), F.col("e")).alias("x"), T.jaccard(F.col("a"), F.col("b")).alias("y")).first()
    assert (got["x"], got["y"]) == (0.0, 0.5)


def test_half_up_rounds_towards_plus_infinity(spark):
    assert one(spark, -2.5, lambda c: T.half_up(c), "double") == -2
    assert one(spark, 2.5, lambda c: T.half_up(c), "double") == 3


def test_split_outlet_needs_twenty_characters(spark):
    assert one(spark, "A headline that is long enough - Outlet", T.split_outlet).outlet == "Outlet"
    assert one(spark, "Short - Outlet", T.split_outlet).outlet is None


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(5)
    sets = {i: sorted({r.choice("abcdefghijkl") for _ in range(r.randint(0, 7))}) for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id long, toks array<string>")
    for least in (0.3, 0.55, 0.8):
        got = {(x.a, x.b) for x in dedupe.similar_pairs(rows, rows, least, F.col("a") < F.col("b")).collect()}
        want = {
            (a, b) for a in sets for b in sets
            if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least
        }
        assert got == want


def leaders(sets, blocks, least):
    found, out = [], {}
    for i in sorted(sets):
        for j in found:
            a, b = set(sets[i]), set(sets[j])
            if a and b and blocks[i] == blocks[j] and len(a & b) / len(a | b) >= least:
                out[i] = j
                break
        else:
            found.append(i)
            out[i] = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_equal_the_sequential_ones(spark, seed):
    r = random.Random(seed)
    sets = {i: sorted({r.choice("abcdefgh") for _ in range(r.randint(0, 5))}) for i in range(50)}
    blocks = {i: r.choice("xy") for i in sets}
    rows = spark.createDataFrame([(i, sets[i], blocks[i]) for i in sets], "id long, toks array<string>, block string")
    got = {x.id: x.leader for x in dedupe.leader_clusters(rows, 0.5, True, staged).collect()}
    assert got == leaders(sets, blocks, 0.5)


def test_leader_clusters_do_not_chain(spark):
    rows = spark.createDataFrame([(1, list("abcd"), "x"), (2, list("bcde"), "x"), (3, list("cdef"), "x"), (4, [], "x"), (5, [], "x")], "id long, toks array<string>, block string")
    got = {x.id: x.leader for x in dedupe.leader_clusters(rows, 0.55, True, staged).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_threads_equal_the_sequential_ones(spark):
    r = random.Random(2)
    links = [(a, b, r.choice([0.3, 0.4, 0.5])) for b in range(40) for a in range(b) if r.random() < 0.06]
    got = {x.id: x.thread for x in narratives.threads(spark.createDataFrame([(i,) for i in range(40)], "id long"), spark.createDataFrame(links, "a long, b long, score double"), staged).collect()}
    want = {}
    for i in range(40):
        best = max(((s, -want[a]) for a, b, s in links if b == i), default=None)
        want[i] = i if best is None else -best[1]
    assert got == want


def test_best_thread_links_equal_all_pairs(spark):
    r = random.Random(5)
    words = ["alpha", "bravo", "delta", "echoes", "foxtrot", "golfing", "hotels", "indigo", "12345", "abc"]
    rows = [(i, r.choice(["home", "rival_a", "other"]), r.choice(["cat0", "corporate", None]), " ".join(r.choices(words, k=r.randrange(0, 7)))) for i in range(90)]
    best = {}
    for b, brand_b, cat_b, text_b in rows:
        for a, brand_a, cat_a, text_a in rows[:b]:
            p, q, same = set(text_a.split()), set(text_b.split()), cat_a == cat_b and cat_a is not None
            shared, j = len({w for w in p & q if len(w) > 3 and not w.isdigit()}), len(p & q) / max(1, len(p | q))
            need = (3 if cat_b == "corporate" else 2) + (not same) + 2 * ("other" not in (brand_a, brand_b) and brand_a != brand_b)
            score = max(j if same and brand_a == brand_b and j >= 0.22 else 0, 0.2 + 0.02 * shared if shared >= need else 0)
            if score:
                best.setdefault(b, []).append((score, a))
    want = {(a, b) for b, found in best.items() for s, a in found if s == max(found)[0]}
    stories = spark.createDataFrame(rows, "id long, brand string, category string, text string")
    assert {(x.a, x.b) for x in narratives.thread_links(stories, block=20).collect()} == want


def shuffled(spark, run):
    """What ``run`` gives, and the bytes that it wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    total = lambda: sum(x.apply(i).shuffleWriteBytes() for x in [stages()] for i in range(x.size()))
    before = total()
    out = run()
    return out, total() - before


def test_more_blocks_of_stories_write_no_more(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = [(i, "home", f"cat{i % 2}", " ".join(r.choices(words, k=60))) for i in range(800)]
    stories = spark.createDataFrame(rows, "id long, brand string, category string, text string")
    got = [shuffled(spark, lambda b=block: sorted((x.a, x.b, x.score) for x in narratives.thread_links(stories, block=b).collect())) for block in (400, 20)]
    assert got[0][0] == got[1][0] and len(got[0][0]) > 700
    assert got[1][1] < 3 * got[0][1]


def test_banded_pairs_equal_all_pairs_and_move_their_words_little(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows = []
    for i in range(900):
        summ = r.sample(words, 100) if i < 5 or r.random() < 0.7 else r.sample(rows[-r.randrange(1, 5)][3], 70) + r.sample(words, 30)
        head = r.choice([[], summ[:6], summ[1:6]])
        rows.append((i, None if i % 40 == 0 else datetime(1970, 1, 1) + timedelta(hours=r.choice([0, 8, i, 3 * i]) - 200), head, list(dict.fromkeys(summ))))
    want = set()
    us = [x[1] or datetime(1970, 1, 1) for x in rows]
    for y in range(900):
        for x in range(y):
            if abs(us[x] - us[y]) <= timedelta(days=5):
                h, s = (len(set(rows[x][k]) & set(rows[y][k])) / max(1, len(set(rows[x][k]) | set(rows[y][k]))) for k in (2, 3))
                if max(h, s) >= 0.4:
                    want.add((x, y) if us[x] <= us[y] else (y, x))
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, head array<string>, summ array<string>")
    got, moved = shuffled(spark, lambda: [(x.keep, x.drop) for x in dedupe.banded_pairs(df, 0.4, most=None).collect()])
    assert (sorted(set(got) - want)[:5], sorted(want - set(got))[:5], len(got) - len(want)) == ([], [], 0) and len(want) > 100
    assert moved < 2 * 8 * sum(len(x[2]) + len(x[3]) for x in rows)
    crowded = [(x.keep, x.drop) for x in dedupe.banded_pairs(df, 0.4, most=None, stage=staged, crowded=100).collect()]
    assert sorted(crowded) == sorted(got)


def test_threads_and_candidates_take_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    ids = {x.doc_id for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {x.id for x in registry.QUERIES["narrative_threads"](spark, sf).collect()} == ids
    assert {x.id for x in registry.QUERIES["semantic_candidates_documents"](spark, sf).collect()} <= ids


def test_throttled_alerts_go_out_again(spark):
    t = datetime(2024, 1, 1)
    rows = [(h, title, t + timedelta(hours=h)) for title in ("a", None) for h in range(0, 100, 5)] + [(7, "b", t), (8, "b", t + timedelta(hours=22)), (9, "c", None)]
    got = ledger.throttled(spark.createDataFrame(rows, "id long, title string, at timestamp_ntz"), 22).collect()
    assert sorted(x.id for x in got if x.title == "a") == sorted(x.id for x in got if x.title is None) == [0, 25, 50, 75]
    assert sorted(x.id for x in got if x.title in ("b", "c")) == [7, 8, 9]


def test_alert_throttle_equals_recursive_sql(spark):
    sf, duckdb = "/root/testdata/sf0.001", pytest.importorskip("duckdb")
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    want = duckdb.sql(f"""
WITH RECURSIVE e AS (SELECT event_id AS id, event_type || CAST(user_id AS VARCHAR) AS title, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM '{sf}/events.parquet'),
n AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY t, id) AS k FROM e),
s AS (SELECT id, title, k, t AS last, true AS sent FROM n WHERE k = 1 UNION ALL
  SELECT n.id, n.title, n.k, CASE WHEN n.t - s.last >= 22 * 3600000000 THEN n.t ELSE s.last END, n.t - s.last >= 22 * 3600000000
  FROM s JOIN n ON n.title = s.title AND n.k = s.k + 1)
SELECT id FROM s WHERE sent""").fetchall()
    assert sorted(x.id for x in registry.QUERIES["alert_throttle"](spark, sf).collect()) == sorted(x[0] for x in want)


def test_duplicate_pairs_keep_the_earlier_within_the_window(spark):
    t = datetime(2024, 1, 10)
    rows = [(1, list("abcd"), t), (2, list("abcd"), t - timedelta(days=1)), (3, list("abcd"), t + timedelta(days=60)), (4, list("wxyz"), t)]
    got = dedupe.duplicate_pairs(spark.createDataFrame(rows, "id long, toks array<string>, at timestamp_ntz")).collect()
    assert [(x.keep, x["drop"], x.score) for x in got] == [(2, 1, 1.0)]


def series(spark, today, past):
    values = [*past, today]
    return spark.createDataFrame([("b", i, date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "brand string, idx int, day date, v long")


@pytest.mark.parametrize("today, past, floor, fires", [(12, [1] * 21, 4, True), (12, [1] * 21, 20, False), (2, [0] * 21, 4, False), (4, [4] * 21, 4, False)])
def test_surge(spark, today, past, floor, fires):
    got = surge.trailing(series(spark, today, past), floor=floor).collect()
    assert [x.fires for x in got] == [fires]


def test_axis_invariant_across_daylight_saving(spark):
    from coverwell.sources.tables import local_day

    start = datetime(2024, 4, 20)
    rows = spark.createDataFrame([(i, start + timedelta(hours=5 * i), "b", "negative" if i % 3 == 0 else "neutral") for i in range(100)], "id long, at timestamp_ntz, brand string, sentiment string")
    rows = rows.withColumn("day", local_day(F.col("at")))
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    series_ = trends.share_of_voice(rows, trends.axis(rows, first, last), ("b", "quiet"))
    got = series_.groupBy("brand").agg(F.sum("mentions").alias("m"), F.sum("negatives").alias("n")).collect()
    assert {x.brand: (x.m, x.n) for x in got} == {"b": (100, 34), "quiet": (0, 0)}


def test_ranges_are_refused_not_clamped():
    assert reports.parse_range("2024-01-01", "2024-01-31") == (date(2024, 1, 1), date(2024, 1, 31))
    for bad in (("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-06-01"), ("x", "2024-01-01")):
        with pytest.raises(ValueError):
            reports.parse_range(*bad)


def test_url_rules(spark):
    cases = {
        "https://a.example/tag/x": (True, True), "https://a.example/archives/341270": (True, False), "https://a.example/?x=12345678901": (True, True),
        "https://user@a.example/x": (False, False), "javascript:alert(1)": (False, False), "//a.example/x": (False, False), "https://a.example/?q=1": (True, True),
        "https://a.example/cash/share?a=1": (True, True),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {x.u: (x.s is not None, x.n) for x in rows.select("u", filters.safe_url(F.col("u")).alias("s"), filters.non_article(F.col("u")).alias("n")).collect()}
    assert got == cases


def test_failure_streak_resets_on_success(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "j", t + timedelta(hours=i), ok) for i, ok in enumerate([True, False, False, True, False])] + [(9, "k", t, False)]
    runs = spark.createDataFrame(rows, "id long, job string, started_at timestamp_ntz, ok boolean")
    got = {x.job: (x.streak, x.last_ok) for x in health.failure_streaks(runs).collect()}
    assert got == {"j": (1, t + timedelta(hours=3)), "k": (1, None)}


@pytest.mark.parametrize("n, state", [(79, "ok"), (80, "warn"), (95, "crit")])
def test_quota_edges(spark, n, state):
    now = datetime(2024, 1, 31)
    log = spark.createDataFrame([(i, now - timedelta(hours=1)) for i in range(n)], "id long, created_at timestamp_ntz")
    assert health.quota(log, now, 100, 100_000).first().state == state


def test_overdue_never_run_is_unknown(spark):
    now = datetime(2024, 1, 31)
    runs = spark.createDataFrame([("a", now - timedelta(hours=3)), ("b", now)], "job string, started_at timestamp_ntz")
    got = {x.job: x.state for x in health.overdue(runs, {"a": 2.0, "b": 2.0, "c": 2.0}, now).collect()}
    assert got == {"a": "warn", "b": "ok", "c": "unknown"}


def test_subscribers_without_topics_get_all(spark):
    subs = spark.createDataFrame([(1, None), (2, ["x"]), (3, ["z"])], "subscriber long, topics array<string>")
    items = spark.createDataFrame([(10, "x"), (11, "y")], "id long, category string")
    assert sorted(map(tuple, filters.subscriber_items(subs, items).collect())) == [(1, 10), (1, 11), (2, 10)]


def test_feeds(spark):
    from coverwell.sources import feeds

    rss = "<rss><channel>" + "".join(f"<item><title>A headline that is long enough {i} - Outlet</title><link>https://a.example/{i}</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description></item>" for i in range(90)) + "</channel></rss>"
    atom = '<feed><entry><title>Entry</title><link href="https://b.example/1"/><published>2024-01-15T10:00:00Z</published><author><name>Jane Roe</name></author></entry></feed>'
    hostile = '<?xml version="1.0"?><!DOCTYPE r [<!ENTITY a "b">]><rss><channel><item><title>&a;</title></item></channel></rss>'
    rows = spark.createDataFrame([("rss", rss), ("atom", atom), ("bad", hostile), ("none", None), ("broken", "<rss><channel>"), ("big", "x" * (feeds.BODY_CAP + 1))], "feed_id string, body string")
    verdicts = {x.feed_id: x.reject for x in feeds.parsed(rows).select("feed_id", "reject").collect()}
    assert verdicts == {"rss": None, "atom": None, "bad": "entities", "none": "missing", "broken": None, "big": "too-large"}
    got = feeds.items(rows).collect()
    assert sum(x.feed_id == "rss" for x in got) == 80 and sum(x.feed_id == "atom" for x in got) == 1
    first = next(x for x in got if x.feed_id == "rss" and x.pos == 0)
    assert (first.headline, first.source, first.snippet, first.published_at) == ("A headline that is long enough 0", "Outlet", "Some text", datetime(2024, 1, 15, 10))
    entry = next(x for x in got if x.feed_id == "atom")
    assert (entry.author, entry.url, entry.published_at) == ("Jane Roe", "https://b.example/1", datetime(2024, 1, 15, 10))


def test_upsert_keeps_what_is_not_given(spark):
    from coverwell.operators import ledger

    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    got = ledger.upsert(target, spark.createDataFrame([(1, None), (3, "c")], "k long, v string"), "k").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_thread_board_names_and_lists_threads(spark):
    head = ["Harbour ferry timetable changed", "New harbour ferry timetable: what changes", "harbour ferry fares", "Lone story - told once", "Lone again"]
    rows = [
        (1, "home", "a", "negative", 2, head[0], 0), (2, "home", None, "positive", 5, head[1], 8), (3, "other", "a", "neutral", None, head[2], 8),
        (4, "other", "b", "neutral", 9, head[3], None), (5, "other", "c", "negative", 9, head[4], 40), (6, "home", "a", "negative", 1, None, 2),
    ]
    stories = spark.createDataFrame(rows, "id long, brand string, category string, sentiment string, importance int, headline string, idx int")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "id long, thread long")
    got = {x.thread: x for x in narratives.thread_board(stories, found, 9, most_ids=2).collect()}
    assert set(got) == {1, 4}
    a, b = got[1], got[4]
    # three share "harbour ferry", two the longer phrase: one fewer is near enough, and the longer one wins
    assert (a.name, a.brand, a.category, a.headline) == ("home · harbour ferry timetable", "home", "a", head[1])
    assert (a.total, a.negative, a.neutral, a.positive, a.series, a.ids, a.ids_total) == (3, 1, 1, 1, [1, 0, 0, 0, 0, 0, 0, 0, 2], [2, 1], 3)
    assert a.rising and a.rising_score == 4.0
    # nothing shared: the clause of the leading story; stories off the axis are in no day
    assert (b.name, b.category, sum(b.series), b.rising, b.rising_score) == ("Lone story", "b", 0, False, None)
    assert narratives.thread_board(stories.limit(0), found, 9).count() == 0


def test_meeting_leaves_out_no_similar_pair_and_few_others(spark):
    """Sets over four sizes of slices, with near copies and subsets: all similar pairs meet, and nearly none else does."""
    import random

    from coverwell.operators import dedupe, meeting

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(40_000)]
    sets = [set(rng.sample(words, n)) for n in [1, 2, 3, 10, 40, 60, 200, 900] * 20]
    sets += [set(rng.sample(sorted(s), max(1, int(len(s) * f)))) | set(rng.sample(words, len(s) // 10)) for s in sets[:80] for f in (0.5, 0.6, 0.9)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, toks array<string>")
    keyed = df.select("id", F.lit(0).alias("key"), meeting.hashed(F.col("toks")).alias("words"))
    for least in (0.4, 0.5, 0.55):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12}
        got = {(r.a, r.b) for r in dedupe.similar_pairs(df, df, least, F.col("a") < F.col("b")).collect()}
        assert got == want
        met = meeting.meeting(keyed, keyed, least, F.col("a") < F.col("b")).count()
        assert met < len(sets) ** 2 // 10  # half of len(sets) ** 2 are there


def test_few_rows_meet_batches_with_the_same_results(spark, monkeypatch):
    """A side of few rows is compared whole, without moving a word of the other; both ways give the same rows."""
    import random

    from coverwell.operators import dedupe

    rng = random.Random(3)
    names = [f"word{i}" for i in range(60)]

    def rows(n, start):
        made = [(start + i, rng.sample(names, rng.randrange(12))) for i in range(n)]
        df = spark.createDataFrame([(i, t, t[::2], [f"{x} {y}" for x, y in zip(t, t[1:])]) for i, t in made], "id long, toks array<string>, strong array<string>, pairs array<string>")
        return df.withColumns({"block": F.lit("x"), "pos": -F.col("id")})

    new, pool = rows(70, 0), rows(90, 20)
    ways = [
        lambda: dedupe.gated_candidates(new, pool, most=None), lambda: dedupe.gated_candidates(pool, new, most=None, earlier=True),
        lambda: dedupe.crossrun_match(new, pool, 0.3),
    ]
    some = [sorted(map(tuple, f().collect())) for f in ways]
    assert all("MapInArrow" in f()._jdf.queryExecution().executedPlan().toString() for f in ways)
    monkeypatch.setattr(dedupe, "few", lambda rows, columns: None)
    assert some == [sorted(map(tuple, f().collect())) for f in ways]
    assert all(len(s) > 20 for s in some)


def test_values_bound_once_and_outputs_that_are_not_compared(spark):
    from coverwell.functions.wires import decode_entities
    from coverwell.operators import filters, narratives

    row = spark.createDataFrame([("&amp;lt;b&amp;amp;",), (None,)], "t string")
    decoded = row.select(decode_entities(F.col("t")).alias("d"))
    assert [r.d for r in decoded.collect()] == ["<b&", None]
    assert decoded._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # one for each pass

    subs = spark.createDataFrame([(1, ["x", "y"]), (1, ["x"]), (2, None), (2, ["x"]), (None, ["y"])], "subscriber long, topics array<string>")
    items = spark.createDataFrame([(10, "x"), (10, "x"), (11, "y"), (12, "z")], "id long, category string")
    got = filters.subscriber_items(subs, items)
    assert sorted(map(str, got.collect())) == sorted(f"Row(subscriber={s}, id={i})" for s, i in [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (None, 11)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("\n")[0]  # nothing is made distinct after the pairs are made
    twice = filters.subscriber_items(subs, items.unionByName(spark.createDataFrame([(10, "y")], items.schema)))
    assert twice.count() == twice.distinct().count() == 7

    texts = spark.createDataFrame([(i, f"red fox{i} a b c {i} x y" + (" a b" if i % 2 else "")) for i in range(9)] + [(99, None)], "id long, text string")
    assert [tuple(r) for r in narratives.best_phrases(texts, most=4).collect()] == [("a b c", 9), ("a b", 9), ("b c", 9), ("x y", 9)]
    assert narratives.best_phrases(texts, most=5).collect()[4].n_docs == 4


def test_similar_pairs_move_their_words_little(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    sets = []
    for _ in range(700):
        sets.append(r.sample(words, 100) if len(sets) < 5 or r.random() < 0.7 else r.sample(sets[-r.randrange(1, 5)], 80) + r.sample(words, 20))
    rows = spark.createDataFrame([(i, list(dict.fromkeys(s)), "ab"[i % 2]) for i, s in enumerate(sets)], "id long, toks array<string>, block string")
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    want = {(a, b) for b in range(700) for a in range(b) if a % 2 == b % 2 and like(a, b) >= 0.5}
    got, moved = shuffled(spark, lambda: {(x.a, x.b) for x in dedupe.similar_pairs(rows, rows, 0.5, F.col("a") < F.col("b"), "block").collect()})
    assert got == want and len(want) > 30
    assert moved < 2.5 * 8 * sum(map(len, sets))


def test_thread_links_of_long_texts_equal_all_pairs(spark):
    r = random.Random(10)
    words = ["".join(r.choices("bcdfghjk", k=6)) for _ in range(2000)]
    texts = []
    for i in range(300):
        size = 900 if i % 40 == 3 else r.choice([8, 60, 150])
        texts.append(r.sample(words, size) if i < 5 or r.random() < 0.7 else r.sample(t := texts[-r.randrange(1, 5)], len(t) * 9 // 10) + r.sample(words, 6))
    rows = [(i, ["home", "rival_a", "other"][i % 3], f"cat{i % 2}", " ".join(t)) for i, t in enumerate(texts)]
    want = set()
    for b, brand_b, cat_b, _ in rows:
        found = []
        for a, brand_a, cat_a, _ in rows[:b]:
            p, q = set(texts[a]), set(texts[b])
            n, j = len(p & q), len(p & q) / len(p | q)
            need = 2 + (cat_a != cat_b) + 2 * ("other" not in (brand_a, brand_b) and brand_a != brand_b)
            found.append((max(j if cat_a == cat_b and brand_a == brand_b and j >= 0.22 else 0, 0.2 + 0.02 * n if n >= need else 0), a))
        want |= {(a, b) for s, a in found if s and s == max(found)[0]}
    stories = spark.createDataFrame(rows, "id long, brand string, category string, text string")
    assert {(x.a, x.b) for x in narratives.thread_links(stories, block=50).collect()} == want
