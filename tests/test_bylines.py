"""Credits that pages name, and the rule that each passes or fails."""

from pyspark.sql import functions as F

from coverwell.operators import bylines


def test_rules_in_order(spark):
    cases = {
        "By Rana Mamdouh": "ok", "a@b.c": "email", "Staff Writer": "desk-word", "Search here now": "ui-junk", 'x" data-astro': "markup", "one-two-three": "slug",
        "Mona Friday": "dateline-word", "x y " * 30: "too-long", "Outlet": "outlet-name", "R2 D2": "not-name-shaped", "Gate | 12": "no-person-segment", "": "empty",
        "Axis Marco": "in-headline", "Bob Subject": "story-subject", "Byron Smith": "ok", "Jean-Pierre Abdel-Rahman": "ok",
    }
    rows = spark.createDataFrame([(c, w) for c, w in cases.items()] + [(None, "empty")], "raw string, want string")
    verdict = bylines.judge(F.col("raw"), F.lit("The Outlet"), F.lit("Axis Marco speaks"), F.lit("Then Bob Subject, CEO of it, said. by Rana Mamdouh"))
    for r in rows.select("raw", "want", verdict.alias("v")).collect():
        assert (r["raw"], r["v"]["reason"], r["v"]["ok"]) == (r["raw"], r["want"], r["want"] == "ok")


def test_pages(spark):
    pages = [
        ('<script type="application/ld+json">{"@graph":[{"author":[{"name":"Ann Bee"},"Cee Dee"]},{"x":1}]}</script>', "json-ld"),
        ('<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"author":"Ann Bee"}]</script>', "json-ld"),
        ('<meta property="article:author" content="https://x.y"><meta content="Ann Bee" name="author">', "meta"), ('<p class="byline">By Ann Bee</p>', "byline"),
        ("<p>targets users: Axis CEO Ann Bee , Thursday 6 Aug 2026</p>", "dateline"), ("<p>Ann Bee , 6 \u0625\u0628\u0631\u064a\u0644 2026</p>", "dateline"), ("<p>Ann Bee went home on Thursday</p>", None), ("", None), (None, None),
    ]
    t = bylines.trace(F.col("html"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, html string, want string").select("want", t.alias("t"), bylines.byline(t).alias("name")).collect()
    for r in rows:
        assert (r["name"], r["t"][0]["source"] if r["t"] else None) == ("Ann Bee" if r["want"] else None, r["want"])
