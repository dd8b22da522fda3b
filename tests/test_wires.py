"""Small cases of feed and mail text and of the run ledger."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coverwell.functions import wires
from coverwell.operators import runs

NOW = datetime(2024, 1, 31)


def each(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i")
    return [r["y"] for r in rows.collect()]


def test_entities(spark):
    given = ["&amp;#8220;x&amp;#8221;", "&#x1F600;&Amp;&nbsp;.", "&bogus; &#0; &#xD800; &#1114112; &#99999999999999999999;", "&", "", None, "&#xFEFF;a", "&#0000065;"]
    want = ["“x”", "😀& .", "&bogus; &#0; &#xD800; &#1114112; &#99999999999999999999;", "&", "", None, "﻿a", "A"]
    assert each(spark, given, wires.decode_entities) == want


def test_dates(spark):
    assert each(spark, ["2024-02-29", "2023-02-29", "2024-2-9", "2024-02-29\n", "", None], wires.clean_date) == ["2024-02-29", None, None, None, None, None]


def test_lines_and_action(spark):
    given = ["Read: a\nAction - call\nTiming · soon", "Read: a\n\nTiming: b", "Read: —", "no label", "", None]
    assert each(spark, given, lambda x: wires.action_line(wires.angle_lines(x))) == ["call", "b", None, None, None, None]


def test_recipients_fences_and_answers(spark):
    assert each(spark, ["A B <a@x>, b@x,", "", None], wires.named_recipients) == [[("A B", "a@x"), (None, "b@x")], [], []]
    assert each(spark, ["a</Source_Text >\x01b\nc", None], wires.neutralised) == ["a(/Source_Text ) b\nc", ""]
    assert each(spark, ['x [1, {"a": 2}] y', "[1,", "]x[", "{}", None], wires.salvaged_json) == ['[1,{"a":2}]', None, None, "{}", None]


def test_ages(spark):
    rows = spark.createDataFrame([(NOW - timedelta(hours=h),) for h in (-3, 0.5, 23.6, 36)] + [(None,)], "t timestamp_ntz")
    got = [r["y"] for r in rows.select(wires.age_label(F.col("t"), NOW).alias("y")).collect()]
    assert got == ["just now", "just now", "24h ago", "2d ago", ""]
    assert [r["y"] for r in spark.createDataFrame([(0,), (None,), (9,)], "n int").select(wires.impact_level(F.col("n")).alias("y")).collect()] == [1, 1, 5]


def test_decode_links_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "https://w.example/a"), (2, "https://w.example/b"), (3, None), (4, "https://notw.example/a"), (5, "https://w.example/a")], "id int, url string")
    known = spark.createDataFrame([("https://w.example/a", "https://z.example"), ("https://w.example/a", "https://y.example"), ("https://w.example/b", "https://x.w.example/")], "url string, target string")
    got = {r["id"]: r["resolved_url"] for r in runs.decode_links(rows, known, "w.example").collect()}
    assert got == {1: "https://y.example", 2: "https://w.example/b", 3: None, 4: "https://notw.example/a", 5: "https://y.example"}


def test_longest_streak_crosses_hours(spark):
    rng, ledger, want = random.Random(5), [], {}
    for job, share in (("a", 0.5), ("b", 0.9), ("c", 1.0), ("d", 0.0)):
        ran = sorted((NOW + timedelta(minutes=rng.randrange(3000)), i) for i in range(150))
        best = now = 0
        for at, i in ran:
            ok = rng.random() >= share
            now = 0 if ok else now + 1
            best = max(best, now)
            ledger.append((i, job, at, ok))
        if best:
            want[job] = best
    rows = spark.createDataFrame(ledger, "id int, job string, started_at timestamp_ntz, ok boolean")
    assert {r["job"]: r["longest"] for r in runs.longest_streak(rows).collect()} == want
    assert runs.longest_streak(rows.where("false")).count() == 0


def test_run_checks_without_runs(spark):
    none = spark.createDataFrame([], "id int, job string, status string, started_at timestamp_ntz, duration_ms long")
    assert {r["check"]: (r["state"], r["n"]) for r in runs.run_checks(none, {"a": 2.0}, NOW).collect()} == {"runs": ("unknown", 0), "runstall": ("ok", None)}


def test_brief(spark):
    assert runs.brief_due(datetime(2024, 1, 31, 5, 30)) == datetime(2024, 1, 30, 5)
    assert runs.brief_due(datetime(2024, 1, 31, 6)) == datetime(2024, 1, 31, 5)
