"""The contracts against plain loops: provider batches, patches, spans, overlaps and pages."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverwell.operators import contracts, dedupe, ingest, paging
from coverwell.sources.staging import staged

T0 = datetime(2024, 1, 1)


def asked(seen, fail=(), skip=(), never=()):
    def answer(items, ask):
        seen.append([x["id"] for x in items])
        if any(x["id"] in fail for x in items):
            raise ValueError("no answer")
        return [{"i": i, "ok": True} for i, x in enumerate(items) if x["id"] not in never and (x["id"] not in skip or ask)] + [None, {"i": "x"}, {"i": 99}]

    return answer


def through(ids, answer, batch=25):
    """The operator's own loop over one task's rows, as it runs in a worker."""
    import pandas as pd

    class Rows:
        columns, dtypes = ["id"], [("id", "bigint")]

        def mapInPandas(self, f, schema):
            return pd.concat(list(f(iter([pd.DataFrame({"id": ids[:7]}), pd.DataFrame({"id": ids[7:]})]))))

    got = contracts.classify(Rows(), answer, "ok boolean", batch)
    return dict(zip(got["id"], got["resolved"]))


def test_provider_batches():
    seen = []
    assert all(through(list(range(60)), asked(seen)).values()) and [len(s) for s in seen] == [25, 25, 10]
    seen = []
    got = through(list(range(25)), asked(seen, fail={13}))
    assert [i for i, ok in got.items() if not ok] == [13] and [13] in seen
    seen = []
    got = through(list(range(25)), asked(seen, skip={3, 4}, never={9}))
    assert [i for i, ok in got.items() if not ok] == [9] and seen == [list(range(25)), [3, 4, 9], [9]]
    seen = []
    got = through(list(range(8)), asked(seen, never=set(range(8))))
    assert not any(got.values()) and seen[0] == list(range(8)) and [0, 1, 2, 3] in seen and max(map(len, seen[1:])) == 4


def test_provider_over_partitions(spark):
    rows = spark.range(300).repartition(3)
    got = contracts.classify(rows, lambda items, ask: [{"i": i, "ok": x["id"] % 2 == 0} for i, x in enumerate(items)], "ok boolean")
    assert {r.id: (r.ok, r.resolved) for r in got.collect()} == {i: (i % 2 == 0, True) for i in range(300)}
    assert contracts.classify(spark.range(0), lambda items, ask: [], "ok boolean").collect() == []


def test_patches_tell_cleared_from_not_given(spark):
    target = spark.createDataFrame([(1, "a", "x", True, T0), (2, "b", None, None, None), (3, "c", "z", False, None)], "k long, name string, s string, team_share boolean, team_share_at timestamp_ntz")
    rows = [(1, 1, "n1", True, False), (1, 2, None, True, False), (1, 3, "late", False, False), (2, 1, "  q ", True, True), (9, 1, "new", True, True)]
    log = spark.createDataFrame(rows, "k long, seq long, v string, has boolean, pin boolean").withColumn("_at", F.lit(T0).cast("timestamp_ntz"))
    log = log.select("k", "seq", "_at", contracts.given(contracts.text_or_null(F.col("v")), F.col("has")).alias("name"), contracts.given(F.when(F.col("pin"), True), F.col("seq") == 1).alias("team_share"))
    got = {r.k: tuple(r)[1:] for r in contracts.patched(target, contracts.pin_patch(log, "_at").drop("_at"), "k", "seq").collect()}
    assert got == {1: (None, "x", None, None), 2: ("q", None, True, T0), 3: ("c", "z", False, None)}


def test_normal_forms(spark):
    df = spark.createDataFrame([("+20 (10) 1234-567", [" a", "", "b "]), ("12", [" "]), (None, None)], "p string, l array<string>")
    got = df.select(contracts.phone_or_null(F.col("p")), contracts.list_or_null(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("20101234567", ["a", "b"]), (None, None), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_a_sweep(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), lo := r.randrange(1000), lo + r.choice([0, 3, 10, 60, 100])) for _ in range(60)] + [("a", 5, None), ("b", 9, 2), ("a", 100, 300), ("a", 300, 400)]
    got = contracts.merge_spans(spark.createDataFrame(rows, "k string, lo long, hi long"), "k", 50).collect()
    want = []
    for k in "ab":
        for lo, hi in sorted((a, b) for key, a, b in rows if key == k and b is not None and a <= b):
            if want and want[-1][0] == k and lo <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(hi, want[-1][2]))
            else:
                want.append((k, lo, hi))
    assert sorted(map(tuple, got)) == sorted(want)


def test_coverage_is_a_floor_with_a_gap_or_an_undated_row(spark):
    now = datetime(2024, 1, 31)
    h = lambda n: now - timedelta(hours=n)
    pages = [("whole", h(0), h(10), False), ("whole", h(10), h(30), True), ("gap", h(0), h(9), False), ("gap", h(11), h(800), False), ("far", h(0), h(721), False), ("none", h(5), h(900), False)]
    log = [(k, f"{k}{i}", h(i)) for k in ("whole", "gap", "far", "none") for i in range(0, 30, 10)] + [("far", "far0", h(0)), ("undated", "u", None)]
    got = contracts.window_coverage(
        spark.createDataFrame([*pages, ("undated", h(0), h(900), True)], "k string, newest timestamp_ntz, oldest timestamp_ntz, ended boolean"),
        spark.createDataFrame(log, "k string, id string, created_at timestamp_ntz"), "k", now, {"day": (24, 10), "month": (720, 3)},
    )
    assert {(r.k, r.window): (r.n, r.complete, r.state) for r in got.collect()} == {
        ("whole", "day"): (3, True, "ok"), ("whole", "month"): (3, True, "crit"), ("gap", "day"): (3, False, "unknown"), ("gap", "month"): (3, False, "crit"),
        ("far", "day"): (3, True, "ok"), ("far", "month"): (3, True, "crit"), ("none", "day"): (3, False, "unknown"), ("none", "month"): (3, False, "crit"),
        ("undated", "day"): (0, False, "unknown"), ("undated", "month"): (0, False, "unknown"),
    }


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, a := T0 + timedelta(minutes=r.randrange(6000)), a + timedelta(minutes=r.choice([0, 1, 30, 60, 600]))) for i in range(200)]
    rows += [(1000, T0, None), (1001, None, T0), (1002, T0, T0 + timedelta(hours=1)), (1003, T0 + timedelta(hours=1), T0 + timedelta(hours=2))]
    got = {x.id: x.overlaps for x in contracts.overlaps(spark.createDataFrame(rows, "id long, started_at timestamp_ntz, ended_at timestamp_ntz")).collect()}
    real = [(i, a, b or datetime(9999, 1, 1)) for i, a, b in rows if a and (b is None or b > a)]
    assert got == {i: sum(a2 < b and b2 > a for j, a2, b2 in real if j != i) for i, a, b in real}


def test_pages(spark):
    rows = spark.createDataFrame([(i, i * 7 % 10) for i in range(95)], "id long, v long").repartition(4)
    pages = staged(paging.paged(rows, [F.col("v").desc(), F.col("id").asc()], 20, staged))
    want = sorted(((i, i * 7 % 10) for i in range(95)), key=lambda x: (-x[1], x[0]))
    assert [(x.id, x.page) for x in pages.orderBy("place").collect()] == [(i, n // 20 + 1) for n, (i, _) in enumerate(want)]
    index = paging.page_index(pages, ["id"]).orderBy("page").collect()
    assert [(x.n, x.first.id, x["last"].id) for x in index] == [(len(c), c[0][0], c[-1][0]) for c in (want[k : k + 20] for k in range(0, 95, 20))]
    assert [(x.pages, x.label) for x in paging.counter(pages, 20).orderBy("page").collect()][-1] == (5, "81–95 of 95")
    by_id = paging.paged(rows, [F.col("id").asc()], 20, staged)
    two = paging.page_index(by_id, ["id"]).where("page = 2").first()
    assert sorted(x.id for x in paging.page_of(rows, "id", two.first.id, two["last"].id).collect()) == list(range(20, 40))
    assert paging.paged(rows.limit(0), [F.col("id").asc()], 20, staged).collect() == []


def test_copies_meet_others_once(spark):
    words = lambda s: s.split()
    base = [words("alpha beta gamma delta"), words("alpha beta gamma other"), words("one two three four"), []]
    rows = [(i, base[i % 4] if i % 8 < 4 else list(reversed(base[i % 4])), "x" if i % 3 else None) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, toks array<string>, block string")
    for blocked in (True, False):
        got = {x.id: x.leader for x in dedupe.leader_clusters(df, 0.55, blocked, staged).collect()}
        lead = {}
        for i, toks, block in rows:
            near = (j for j in sorted(set(lead.values())) if toks and (not blocked or rows[j][2] == block) and (s := set(rows[j][1])) and len(s & set(toks)) / len(s | set(toks)) >= 0.55)
            lead[i] = next(near, i)
        assert got == lead
    pool = df.select(F.col("id").alias("id"), "toks", F.lit("x").alias("block"), (100 - F.col("id")).alias("pos"))
    new = spark.createDataFrame([(1, words("delta gamma beta alpha"), "x"), (2, [], "x"), (3, words("delta gamma beta alpha"), "y")], "id long, toks array<string>, block string")
    assert {x.id: x.match for x in dedupe.crossrun_match(new, pool).collect()} == {1: 61, 2: None, 3: None}
    hashed = lambda d: d.withColumn("summary_hash", F.lit(None).cast("string"))
    assert {x.id: x.into_id for x in ingest.crossrun_summary(hashed(new), hashed(pool)).collect()} == {1: 61, 2: None, 3: 61}
