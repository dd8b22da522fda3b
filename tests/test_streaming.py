"""Streams with state: restarts, repeated batches, forgotten state, late and undated rows."""

import random
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coverwell.operators import health, ledger
from coverwell.streaming import state, stream
from coverwell.streaming.keyed import KeyedTable

T0 = datetime(2024, 1, 1)


def files(where):
    return {p: p.stat().st_mtime_ns for p in Path(where).rglob("*.parquet")}


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], "k long, v string", buckets=16)
    assert table.read().count() == 0
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), 0)
    before = files(tmp_path / "data")
    table.upsert(spark.createDataFrame([(7, "b")], "k long, v string"), 1)
    new = set(files(tmp_path / "data")) - set(before)
    assert len(new) == 1 and all(files(tmp_path / "data")[p] == t for p, t in before.items())
    assert {r.k: r.v for r in table.read().collect()} == {k: "b" if k == 7 else "a" for k in range(200)}
    table.upsert(spark.createDataFrame([(7, "b"), (None, "n")], "k long, v string"), 1)  # the batch again, grown by a null key
    table.upsert(spark.createDataFrame([(None, "m")], "k long, v string"), 2)
    got = [(r.k, r.v) for r in table.read().collect()]
    assert sorted(got, key=str) == sorted([*((k, "b" if k == 7 else "a") for k in range(200)), (None, "m")], key=str)
    table.upsert(spark.createDataFrame([], "k long, v string"), 3)
    assert table.read().count() == 201


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], "k long, n long", buckets=4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    rows = spark.range(10).select((F.col("id") % 5).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    for batch in (0, 1, 1, 1):
        table.merge(rows, batch, add)
    assert {r.k: r.n for r in table.read().collect()} == dict.fromkeys(range(5), 4)


def test_merge_by_key_over_batches_and_restarts(spark, tmp_path):
    rows = [(r % 7, r, f"t{r}") for r in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, i // 20) for i, r in enumerate(rows)], "k long, id long, t string, slice int")
    got = []
    state.replay(df, "slice", str(tmp_path), lambda s: got.append(stream.merge_by_key(s.select("k", "id", "t"), "k", "id", str(tmp_path), 4)))
    want = {k: (k, f"t{k}", sum(r[0] == k for r in rows)) for k in range(7)}
    assert {x.k: (x.id, x.t, x.n) for x in got[-1].collect()} == want


def runs(seed, n=160, span=20):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hours = i * span * 24 / n
        job = r.choice(["a", "a", "a", "b", "c", None])
        rows.append((job, T0 + timedelta(hours=hours, microseconds=i), job == "b" or r.random() < 0.25, f"e{i}", min(3, int(hours // 120))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_failure_streaks_equal_the_batch_in_any_order_within_the_delay(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(j, at, ok and j != "c", e, min(3, k + (r.random() < 0.15 and at.hour > 12 and at.day % 5 == 0))) for j, at, ok, e, k in runs(seed)]
    df = spark.createDataFrame(rows, "job string, started_at timestamp_ntz, ok boolean, error string, slice int")
    tables = []
    state.replay(df, "slice", str(tmp_path), lambda s: tables.append(state.failure_streaks(s, str(tmp_path), "120 hours", 4)))
    got = {x.job: (x.streak, x.last_ok, x.last_error) for x in tables[-1].read().collect()}
    for x in health.failure_streaks(df.where("job IS NOT NULL")).collect():
        since = [(at, e) for j, at, ok, e, _ in rows if j == x.job and not ok and (x.last_ok is None or at > x.last_ok)]
        assert got[x.job] == (x.streak, x.last_ok, max(since)[1] if since else None)
    assert None in got


def test_settled_failures_leave_the_state(spark, tmp_path):
    rows = [("a", T0 + timedelta(days=d, minutes=m), False, "e" * 400, d) for d in range(4) for m in range(50)]
    df = spark.createDataFrame(rows, "job string, started_at timestamp_ntz, ok boolean, error string, slice int")
    tables = []
    state.replay(df, "slice", str(tmp_path), lambda s: tables.append(state.failure_streaks(s, str(tmp_path), "1 hour", 4)))
    (row,) = tables[-1].read().collect()
    assert (row.streak, row.last_ok, len(row.last_error)) == (200, None, 300)
    held = spark.read.format("statestore").option("stateVarName", "streak").load(f"{tmp_path}/checkpoint-streaks")
    n, settled = held.select(F.size("value.fails"), "value.settled").first()
    assert n + settled == 200 and n <= 100  # the last two slices are not yet behind the watermark of the last run


def test_throttle_equals_the_batch_and_forgets(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None, f"once{i}"]), T0 + timedelta(hours=i * 2.4), i // 25) for i in range(100)]
    rows += [(1000 + i, "x", None, i) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, title string, at timestamp_ntz, slice int")
    sent = []
    state.replay(df, "slice", str(tmp_path), lambda s: sent.append(state.throttled(s.drop("slice"), str(tmp_path), 22)))
    want = ledger.throttled(df.drop("slice"), 22)
    assert sorted(x.id for x in sent[-1].collect()) == sorted(x.id for x in want.collect())
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint-alerts").count()
    titles = len({t for _, t, at, _ in rows if at})
    recent = len({t for _, t, at, _ in rows if at and at > T0 + timedelta(hours=99 * 2.4 - 24)})
    assert held <= recent + 1 < titles


def test_throttle_keeps_a_bucket_not_a_row_a_title(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"t{i % 1500}", T0 + timedelta(hours=i * 0.01), i // 1500) for i in range(4500)]
    df = spark.createDataFrame(rows, "id long, title string, at timestamp_ntz, slice int")
    sent = []
    state.replay(df, "slice", str(tmp_path), lambda s: sent.append(state.throttled(s.drop("slice"), str(tmp_path), 22)))
    assert sorted(x.id for x in sent[-1].collect()) == sorted(x.id for x in ledger.throttled(df.drop("slice"), 22).collect())
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint-alerts")
    assert held.count() <= 1024 < held.agg(F.sum(F.size("value.titles"))).first()[0]


def test_split_late_loses_nothing(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else T0 + timedelta(hours=i), min(4, i // 40 + (2 if i % 7 == 0 else 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, slice int")
    got = []
    state.replay(df, "slice", str(tmp_path), lambda s: got.append(state.split_late(s, str(tmp_path), "at", 48)))
    found = {x.id: x.branch for x in got[-1].collect()}
    assert len(found) == got[-1].count() == 200
    for i, at, k in rows:
        mark = max((a for _, a, s in rows if a and s < k), default=None)
        assert found[i] == ("undated" if at is None else "late" if mark and at <= mark - timedelta(hours=48) else "kept")


def test_empty_and_undated_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None, 0)], "id long, title string, at timestamp_ntz, slice int")
    sent = []
    state.replay(df, "slice", str(tmp_path / "a"), lambda s: sent.append(state.throttled(s.drop("slice"), str(tmp_path / "a"), 22)))
    assert [x.id for x in sent[0].collect()] == [1]
    none = spark.createDataFrame([("j", None, False, "e", 0)], "job string, started_at timestamp_ntz, ok boolean, error string, slice int")
    tables = []
    state.replay(none, "slice", str(tmp_path / "b"), lambda s: tables.append(state.failure_streaks(s, str(tmp_path / uuid.uuid4().hex))))
    assert tables[0].read().collect() == []
