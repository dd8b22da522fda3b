"""Source divergence against a plain count, with shards, blocks and hand-overs made small."""

import random
import re
from collections import Counter, defaultdict

import pytest

from coverwell.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, TERM int, at string"


def low(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, least, smooth=5, top=50):
    rows = [(lang or "", source or "", TERM.findall(low(text or ""))) for text, lang, source in rows]
    found = df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        names = sorted({r[1] for r in rows if r[0] == lang})
        total = {s: sum(counts[lang, s][t] for t in kept) for s in [*names, None]}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + smooth) // (total[s] + smooth * len(kept)) for t in kept} for s in [*names, None]}
        for s in names:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            over = [(p[s][t] - p[None][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", far, None), ("term", over, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out), found


def corpus(seed, n=400, sources=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeKé漢ß") for _ in range(r.randint(1, 4))) for _ in range(120)]
    out = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary) + r.choice([" ", ", ", "  ", "\n", "7", "'", "-"]) for _ in range(r.randint(0, 60)))
        out.append((text, r.choice(["en", "en", "fr", None]), r.choice(["s0"] * 5 + [f"s{k}" for k in range(sources)] + [None])))
    return out + [(None, "en", "none"), ("", "xx", "a"), (None, "xx", "b"), ("lonely words", "yy", "a"), ("Word " * 5000, "en", "long")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], DOCS).repartition(parts)


@pytest.mark.parametrize("shard_terms", [divergence.SHARD_TERMS, 40])
def test_equals_the_plain_count(spark, shard_terms):
    rows = corpus(1)
    got = divergence.divergence(frame(spark, rows), min_docs=12, top=7, shard_terms=shard_terms).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 12, top=7)[0]


def test_more_sources_than_a_block(spark):
    rows = corpus(2, n=900, sources=150)
    got = divergence.divergence(frame(spark, rows), min_docs=20).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 20)[0]


def test_document_frequencies_are_exact(spark):
    rows = corpus(3)
    got = {(x.lang, x.term): x.n_docs for x in divergence.document_frequencies(frame(spark, rows), 5).collect()}
    df = brute(rows, 5)[1][0]
    assert got == {(lang, t): n for lang, c in df.items() for t, n in c.items() if n >= 5}


def test_shards_are_bounded(spark):
    terms = [("big", f"t{k}") for k in range(1000)] + [(f"l{k}", f"w{j}") for k in range(30) for j in range(6)]
    got = divergence._shards(spark.createDataFrame(terms, "lang string, term string"), 100).collect()
    sizes = Counter(x.shard for x in got)
    assert len(got) == len(terms) and max(sizes.values()) <= 200 and len(sizes) <= 14


def test_shares_past_64_bits(spark):
    got = spark.range(1).select(divergence._share("7000000000000L", "9000000000000L", "3L", 5)).first()[0]
    assert got == 1 + 10**9 * 7000000000005 // 9000000000015


def test_empty_and_without_terms(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []
    got = divergence.divergence(frame(spark, [("a b", "en", "x"), (None, "en", "y"), ("c", None, None)])).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    frame(spark, corpus(4, n=700), 1).drop("TERM", "at").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLES['op13_source_divergence']})").fetchall()
    got = queries.QUERIES["op13_source_divergence"](spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want) == brute(corpus(4, n=700), 30)[0]
