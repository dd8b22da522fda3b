"""The text operators against brute force, on random texts and on the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coverwell.llm import decontaminate, html_extract, line_dedup, mixing, near_dup, perspectives, quality, repeats, secrets, token_counts
from coverwell.llm.components import components
from coverwell.llm.html_blocks import blocks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def texts(seed, n=120):
    """Random texts with exact and near copies, shared passages and lines, repeats, and every awkward case."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß漢K") for _ in range(r.randint(1, 5))) for _ in range(300)]
    passage = " ".join(r.choices(vocabulary, k=70))
    out = []
    for _ in range(n):
        t = " ".join(r.choices(vocabulary, k=r.randint(1, 160))).replace(" a", "\n", 1)
        if r.random() < 0.3:
            t += "\nThe common LINE \n" + t[:20]
        if r.random() < 0.2:
            t = t + " " + passage + " " + r.choice(vocabulary)
        out.append(t)
    for _ in range(n // 3):
        ws = r.choice(out).split(" ")
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        out.append(" ".join(ws))
    return out + [None, "", " \n\t", "one", "one", "two words", "\n\n", "x " * 400, "Ab ab aB " * 90, "a\x0bb\x0cc\rd", "é" * 3000, "\U0001f600 \U0001f600 z"]


@pytest.fixture(scope="module", params=[1, 2])
def docs(spark, request):
    r = random.Random(request.param)
    rows = [(i * 3 + 1, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "", None, "c"]), len(t or "")) for i, t in enumerate(texts(request.param))]
    return rows, spark.createDataFrame(rows, DOCS)


def components_of(n, links):
    lead = list(range(n))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, n):
    ws = WORDS.findall(low(text))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    rows, df = docs
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    lead = components_of(len(rows), links)
    got = {x.doc_id: x for x in near_dup.near_duplicates(df, n, 80).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, *_) in enumerate(rows):
        assert (got[doc_id].n_shingles, got[doc_id].component_id, got[doc_id].kept) == (len(sets[i]), rows[lead[i]][0], lead[i] == i)


def test_near_duplicates_keep_recall_in_large_nodes(spark, monkeypatch):
    for similarity in (0.3, 0.5, 0.8, 0.9, 1.0):
        trees, depth = near_dup.forest(similarity)
        assert (1 - similarity**depth) ** trees <= near_dup.MISS
    monkeypatch.setattr(near_dup, "LEAF", 8)
    passage, rows = " ".join(f"c{i}" for i in range(150)), []
    for doc in range(400):  # pairs at 180 of 224 words; any two documents share 150
        shared = " ".join(f"p{doc // 2}_{i}" for i in range(30))
        rows.append((doc, f"{passage} {shared} " + " ".join(f"d{doc}_{i}" for i in range(22))))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {doc: doc // 2 * 2 for doc in range(400)}


def test_near_duplicates_in_crowded_nodes(spark, monkeypatch):
    """Hundreds of texts that share most words, with small nodes, so that every way through the tree is taken."""
    for name, value in {"LEAF": 8, "DEPTH": 4, "CROWD": 2000, "TREES": 12}.items():
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(r.randint(0, 5)):
            ws[r.randrange(40)] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(ws)))
    sets = [shingle_set(t, 2) for _, t in rows]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    lead = components_of(150, links)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: lead[i] for i in range(150)}


def test_word_arrays():
    import pyarrow as pa
    import xxhash

    from coverwell.llm import word_arrays

    some = [t or "" for t in texts(9, 30)]
    for part in (pa.array(some), pa.array(["", *some]).slice(1), pa.array([""]), pa.array([], pa.string())):
        for text, got in zip(part.to_pylist(), word_arrays.word_hashes(part), strict=True):
            assert got.tolist() == [xxhash.xxh3_64_intdigest(w) for w in WORDS.findall(text)]
            assert word_arrays.word_spans(text).tolist() == [list(m.span()) for m in WORDS.finditer(text)]
    cut = list(word_arrays.slices(pa.array(some), 500))
    assert [t for part in cut for t in part.to_pylist()] == some and len(cut) > 5


def test_minimisers():
    import numpy as np

    r = np.random.default_rng(3)
    for n, span in ((200, 36), (60, 6), (40, 36), (39, 36), (3, 1), (50, 1)):
        h = r.integers(0, 5, n).astype(np.uint64)
        grams = [tuple(h[i : i + repeats.K]) for i in range(n - repeats.K + 1)]
        at = set(repeats.minimisers(h, span).tolist())
        assert all(at & set(range(i, i + span)) for i in range(len(grams) - span + 1))  # one in every span
        picked = {grams[i] for i in at}
        assert all(i in at for i in range(len(grams)) if span == 1) and len(picked) <= len(set(grams))


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    lead = components_of(301, links)
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    named = {i for a, b in links if a != b for i in (a, b)}
    assert got == {i: lead[i] for i in named}


def test_line_dedup(docs):
    rows, df = docs
    split = {d: (t or "").split("\n") for d, t, *_ in rows}
    key = lambda line: low(line).strip(" \t\n\x0b\f\r")
    holders = defaultdict(set)
    for d, lines in split.items():
        for line in lines:
            holders[key(line)].add(d)
    gone = {k for k, v in holders.items() if k and len(v) >= 10}
    assert gone
    got = {x.doc_id: x for x in line_dedup.line_dedup(df, min_docs=10).collect()}
    first = {}
    for d, lines in split.items():
        keep = [line for line in lines if key(line) not in gone]
        assert (got[d].kept, got[d].n_lines, got[d].n_dropped) == ("\n".join(keep), len(lines), len(lines) - len(keep))
    once = {x.doc_id: x.kept for x in line_dedup.line_dedup(df, min_docs=10, keep_first=True).collect()}
    for d in sorted(split):
        keep = []
        for at, line in enumerate(split[d]):
            if key(line) not in gone or first.setdefault(key(line), (d, at)) == (d, at):
                keep.append(line)
        assert once[d] == "\n".join(keep)


def test_line_bitmaps_are_compressed(spark):
    rows = [(i, "\n".join(["same" if j % 100 == 0 else f"{i} {j}" for j in range(1000)])) for i in range(12)]
    got = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(x.drops) == 10 for x in got)


def test_mix(docs):
    rows, df = docs
    sizes = {d: len(WORDS.findall(t or "")) for d, t, *_ in rows}
    by = defaultdict(int)
    for d, _, _, s, _ in rows:
        by[s] += sizes[d]
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = 1.5 * sum(by.values()) - sum(2 * by[s] for s in capped)
        parts = sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * rest > 2 * by[s] * parts}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * by[s] if s in capped else weight[s] * rest / parts for s in order}
    got = mixing.mix(df).collect()
    again = {x.doc_id: x.taken for x in mixing.mix(df).collect()}
    taken, most = defaultdict(int), defaultdict(int)
    for x in got:
        assert (x.size, x.source_size) == (sizes[x.doc_id], by[x.source]) and x.taken <= 2 * x.size and again[x.doc_id] == x.taken
        assert x.target == pytest.approx(target[x.source])
        taken[x.source] += x.taken
        most[x.source] = max(most[x.source], x.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    with_texts = mixing.mix(df, texts=True).collect()
    assert {x.doc_id: x.taken for x in with_texts} == {d: t for d, t in again.items() if t}


def test_secrets(spark):
    token = "AKIA" + "Z9" * 8
    rows = [
        (1, f'password = "{"a1b2" * 4}" and {token} é\U0001f600 token:{"x" * 12}'), (2, f"password: secret: {'k' * 14}"), (3, "0123456789abcdef" * 2 + " 0123456789abcde"),
        (4, None), (5, ""), (6, "API_KEY='" + "q" * 40 + "' apikey=short passwd:" + "z" * 12), (7, "-----BEGIN RSA PRIVATE KEY-----"), (8, "Key=" + "a" * 20),
        (9, "AKIAAKIA" + "B" * 12), (10, "ghp_" + "a" * 36 + " xoxb-1234567890-x sk_live_" + "1" * 16), (1, "again, the same id " + "f" * 16), (None, "dead" * 8),
    ]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = defaultdict(list)
    for x in got:
        by_id[x.doc_id].append([(s.kind, s.start, s.end) for s in x.spans])
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = []
        for order, rule in enumerate(secrets.RULES):
            want += [(m.start(), order, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
        assert [(k, s, e) for s, _, e, k in sorted(want)] in by_id[doc_id]


def test_trigram_queries():
    names = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert names["hex"] == [] and names["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in names["assign"][0]


def benchmark_truth(rows, items):
    ws = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    wins = defaultdict(set)
    for i, t in items:
        w = ws(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in rows:
        w, hit, found = ws(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate(docs, spark, limit):
    rows, df = docs
    r = random.Random(7)
    items = [(i, " ".join((rows[r.randrange(100)][1] or "").split()[5 : 5 + r.randint(3, 40)])) for i in range(25)] + [(90, None), (91, "..."), (92, "one"), (93, "x x"), (94, "x " * 30)]
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit).collect()
    want = benchmark_truth([(d, t) for d, t, *_ in rows], items)
    assert len(got) == len(rows) and any(x.n_hit for x in got)
    for x in got:
        assert (x.n_words, x.n_hit, x.item_ids, x.contaminated) == (*want[x.doc_id], want[x.doc_id][1] > 0)


def test_winnowing_never_misses_a_window(spark):
    r = random.Random(1)
    shared = [f"s{i}" for i in range(10)]
    rows = [(i, " ".join([f"a{r.randrange(99)}" for _ in range(r.randint(0, 30))] + shared + [f"b{r.randrange(99)}" for _ in range(r.randint(0, 30))])) for i in range(60)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(shared))], "item_id long, text string"))
    assert got.where("contaminated and n_hit = 10").count() == 60


def test_quality_statistics(docs):
    rows, df = docs
    got = {x.doc_id: x for x in quality.quality(df).collect()}
    for d, t, *_ in rows:
        t = t or ""
        ws = WORDS.findall(t)
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        again = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        x = got[d]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(ws) < 10 or 100 * len(again) > 20 * len(ws))
        assert not (x.base_failed and x.kept)


def test_quality_rejects_outliers_and_keeps_clean_texts(spark):
    r = random.Random(2)
    clean = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 400))), "en", "s") for i in range(150)]
    junk = [(1000 + i, " ".join("#$%" + r.choice("ab") + "|*" for _ in range(50 + i)) + f" {i}", "en", "s") for i in range(15)]
    got = quality.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"))
    assert {x.doc_id for x in got.where("kept").collect()} == set(range(150))


def test_small_groups_lean_on_their_language_alone(spark):
    r = random.Random(5)
    text = lambda low, high: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(low, high))) for _ in range(60))
    clean = [(i, text(2, 9), "en", f"s{i % 5}") for i in range(400)]
    # 20 rows of a language whose words are long are clean; the same words in a small source of the first language are not
    far = [(1000 + i, text(90, 110), "xx", "s0") for i in range(20)]
    odd = [(2000 + i, text(90, 110), "en", "s9") for i in range(3)]
    junk = [(3000, " ".join("#$%a|*" + str(i) for i in range(60)), "yy", "s0")]  # the only text of its language
    got = quality.quality(spark.createDataFrame(clean + far + odd + junk, "doc_id long, text string, lang string, source string")).collect()
    assert {x.doc_id for x in got if x.kept} == {d for d, *_ in clean + far}
    assert all(x.d2 is not None for x in got)


def test_nothing_jumps_with_the_size_of_a_group(spark):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80))
    probe = " ".join("".join(r.choice("abcdefgh") for _ in range(14)) for _ in range(80))
    base = [(i, text(), "en", f"s{i % 4}") for i in range(400)]
    small_ = [(1000 + i, text(), "en", "t") for i in range(64)]
    far = []
    for n in (30, 36, 37, 38, 49, 50, 51, 64):
        rows = [*base, *small_[:n], (5000, probe, "en", "t")]
        got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        far.append(got.where("doc_id = 5000").first().d2)
    assert all(abs(a - b) < 0.15 * max(a, b) for a, b in zip(far, far[1:]))


def test_estimate_equals_an_independent_search(spark):
    """The least determinant that 200 random starts find in numpy, on data where a fifth of the rows is far away and skewed."""
    import numpy as np

    r = np.random.default_rng(7)
    h_of = lambda y: int(np.ceil(0.75 * len(y)))
    clouds = {
        1: np.vstack([r.standard_normal((400, 4)) * [0.5, 1, 2, 1], r.standard_normal((60, 4)) + 12]),
        2: np.vstack([r.standard_normal((500, 4)) @ r.standard_normal((4, 4)), r.standard_normal((120, 4)) * 0.1 + [0, 9, -9, 0]]) * 3,
        3: r.standard_normal((7, 4)),
    }
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in clouds.items() for v in x], "g int, x0 double, x1 double, x2 double, x3 double")
    got = {e.g: e for e in quality.concentrate(rows, ["g"], 0.75, 20, "test").collect()}
    ridge = np.diag(np.array(quality.RIDGE) ** 2)
    for g, y in clouds.items():
        best = None
        for _ in range(200):
            some = y[r.choice(len(y), 5, replace=False)]
            mean, cov = some.mean(0), np.cov(some.T, bias=True) + ridge
            for _ in range(30):
                d2 = np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
                near = y[np.argsort(d2)[: h_of(y)]]
                mean, cov = near.mean(0), np.cov(near.T, bias=True) * quality.consistency(0.75) + ridge
            if best is None or np.linalg.det(cov) < best[0]:
                best = np.linalg.det(cov), mean, cov
        mine = np.array([[got[g][f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)]) + ridge
        assert np.linalg.det(mine) <= best[0] * 1.02
        if g < 3:
            assert np.allclose([got[g][f"a{i}"] for i in range(4)], best[1], atol=0.05 * np.sqrt(np.diag(best[2])).max())
            assert np.allclose(mine, best[2], rtol=0.1, atol=0.05 * np.abs(best[2]).max())


def test_distance_equals_the_inverse_covariance(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.standard_normal((500, 4)) @ r.standard_normal((4, 4)) + 3
    rows = spark.createDataFrame([(1, *map(float, v)) for v in x], "one int, x0 double, x1 double, x2 double, x3 double")
    est = quality.moments(rows, ["one"])
    got = np.array([v.d for v in rows.join(est, "one").select(*quality.DIMS, quality.distance().alias("d")).collect()])
    cov = np.cov(x.T, bias=True) + np.diag(np.array(quality.RIDGE) ** 2)
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0))
    assert np.allclose(sorted(got), sorted(want))


def test_repeats(docs):
    rows, df = docs
    words = {d: [(m[0], m.start(), m.end()) for m in WORDS.finditer(t or "")] for d, t, *_ in rows}
    holders = defaultdict(set)
    for d, ws in words.items():
        for i in range(len(ws) - 49):
            holders[tuple(w[0] for w in ws[i : i + 50])].add(d)
    want = set()
    for d, ws in words.items():
        run = []
        for i in range(len(ws) - 49):
            h = holders[tuple(w[0] for w in ws[i : i + 50])]
            if len(h) > 1:
                if run and i - run[-1][0] > 50:
                    want.add((d, run[0][0], run[-1][0] + 50 - run[0][0], ws[run[0][0]][1], ws[run[-1][0] + 49][2], min(x[1] for x in run)))
                    run = []
                run.append((i, min(h)))
        if run:
            want.add((d, run[0][0], run[-1][0] + 50 - run[0][0], ws[run[0][0]][1], ws[run[-1][0] + 49][2], min(x[1] for x in run)))
    assert want
    assert {tuple(x) for x in repeats.repeated_passages(df).collect()} == want


@pytest.mark.parametrize("batch, parts", [(7, 40), (64, 3)])
def test_repeats_in_hot_runs(spark, batch, parts):
    """A passage of many documents and many copies of one text, over small batches and partitions, so that runs cross every edge."""
    r = random.Random(batch)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, copy = [[word() for _ in range(n)] for n in (80, 70)]
    rows = []
    for i in range(60):
        cut = r.randint(0, 15)
        rows.append((100 + i, " ".join([word() for _ in range(r.randint(0, 60))] + passage[cut : 80 - r.randint(0, 14)] + [word() for _ in range(r.randint(0, 60))])))
    rows += [(500 + i, " ".join(copy)) for i in range(60)] + [(None, " ".join(passage[:60])), (7, " ".join(copy[:55])), (7, " ".join(copy[:55]))]
    words = [(d, t.split(" ")) for d, t in rows]
    holders = defaultdict(set)
    for (d, ws), (_, t) in zip(words, rows, strict=True):
        for i in range(len(ws) - 49):
            holders[tuple(ws[i : i + 50])].add((d is None, d or 0, t))
    want = set()
    for d, ws in words:
        held = [(i, holders[tuple(ws[i : i + 50])]) for i in range(len(ws) - 49)]
        hit = [(i, h) for i, h in held if len(h) > 1]
        if hit:
            want.add((d, hit[0][0], hit[-1][0] + 50 - hit[0][0], min(min(h)[1] for _, h in hit)))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, (str(parts), str(batch), "false"), strict=True):
        spark.conf.set(k, v)
    try:
        got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {(x.doc_id, x.first_word, x.n_words, x.first_doc_id) for x in got} == want


def test_perspectives_join_and_mask(spark):
    rows = [(1, i, ["ann", "bob", None, "system"][i % 4], f"text {i} <|end|> é") for i in range(150)] + [(1, 7, "bob", None), (2, None, "ann", "x"), (None, 0, "bob", "y"), (3, 0, "system", "only")]
    got = perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=16).collect()
    assert {(x.conv_id, x.speaker) for x in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "bob")}
    for speaker in ("ann", "bob", "unknown"):
        parts = sorted((x for x in got if x.conv_id == 1 and x.speaker == speaker), key=lambda x: x.part)
        assert sum(x.n_turns for x in parts) == 151
        whole = "".join(x.text for x in parts)
        masked = []
        for x in parts:
            assert whole[x.offset : x.offset + x.n_chars] == x.text
            masked += [x.text[m.start : m.end] for m in x.masks]
        said = re.findall(r"<\|assistant\|>\n(.*?<\|end\|>\n)", whole, re.S)
        assert masked == said and whole.count("<|end|>") == 151
        mine = sum((r[2] or "unknown") == speaker for r in rows if r[0] == 1)
        assert len(said) == mine


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    encoder = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate([*texts(5, 40), "a<|endoftext|>b it's 123  x́ \x1c!", "word " * 3000]))
    got = {x.doc_id: x for x in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        n = len(encoder.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)


def test_html_blocks():
    page = "<head><title>no</title></head><nav><a href='/x'>Home</a></nav><p>a &amp; b<br>c<p>d <b>e</b>\n f</p><script>'</p>'</script><ul><li>x<li>y</ul><!-- z -->tail"
    got = blocks(page)
    assert [b.text for b in got] == ["Home", "a & b c", "d e f", "x", "y", "tail"]
    assert got[0].links == 1 and got[3].path.endswith("ul/li")
    assert blocks(None) == blocks("") == [] and [b.text for b in blocks("a < b")] == ["a < b"]


def test_labeller_on_held_out_pages():
    labeller = html_extract.Labeller(html_extract.trained())
    maker, right, n = html_extract.PageMaker(12345), 0, 0
    for _ in range(100):
        html, labels = maker.page()
        page = [b for b in blocks(html) if html_extract.MARK.search(b.text)]
        want = [labels[int(html_extract.MARK.search(b.text)[1])] for b in page]
        page = [b._replace(text=html_extract.MARK.sub("", b.text) or ".") for b in page]
        got = labeller.keep([page])[0]
        right, n = right + sum(g == w for g, w in zip(got, want, strict=True)), n + len(page)
    assert right / n > 0.99


def test_labeller_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in html_extract.fresh(0).items()}
    x, lengths, d = r.standard_normal((5, 3, html_extract.E)), np.array([5, 3, 1]), r.standard_normal((5, 3, html_extract.H))
    del lengths
    loss = lambda w: float((html_extract.lstm(x, w, p["Uf"], p["cf"])[0] * d).sum())
    _, saved = html_extract.lstm(x, p["Wf"], p["Uf"], p["cf"])
    _, dw, _, _ = html_extract.lstm_back(x, p["Wf"], p["Uf"], saved, d)
    for i, j in ((0, 0), (3, 20), (7, 40), (11, 60)):
        step = np.zeros_like(p["Wf"])
        step[i, j] = 1e-2
        assert (loss(p["Wf"] + step) - loss(p["Wf"] - step)) / 2e-2 == pytest.approx(dw[i, j], rel=0.05, abs=1e-2)


def test_html_features_take_all_words_and_names():
    text = " ".join(f"w{i}" for i in range(500))
    assert sorted(html_extract.word_buckets(text)) == sorted(html_extract._word_bucket[f"w{i}"] for i in range(500))
    (block,) = blocks("<div class='flex flex-col items-center justify-between gap px py sidebar'>x</div>")
    assert block.path == "/div.flex.flex.col.items.center.justify.between.gap.px.py.sidebar"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>no</title><meta charset=utf-8><body><p>a<p>b", ["a", "b"]),
        ("<head><title>no</title><style>p {}</style><p>a</p>b", ["a", "b"]),
        ("<head><title>no</title></head><p>a", ["a"]),
        ("<p>a <svg-icon name=x></svg-icon>b</p><button-group><p>c</p></button-group><template-x>d</template-x>", ["a b", "c", "d"]),
        ("<p>a <svg class='x>y' width=1 />b <math/>c</p><p>d <svg><path d='' /><text>no</text></svg>e", ["a b c", "d e"]),
        ("<header><p>a</header><button>no</button\n><p>b", ["a", "b"]),
    ],
)
def test_hidden_elements_end_where_they_should(page, want):
    got = blocks(page)
    assert [b.text for b in got] == want
    assert not any("head/" in f"{b.path}/" for b in got)


def test_html_extraction(spark):
    rows = [(1, "u", "<nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Head</h1><p>One &lt;two&gt;\n three.</p><p>Four five six.</p></article><footer>(c) x</footer>"), (2, None, None), (None, "v", "")]
    got = {x.page_id: x for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head\n\nOne <two> three.\n\nFour five six." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[None].n_chars == 0


CLASHING = ["_th", "n_lines", "kept", "size", "copies", "target", "spans", "n_words", "item_ids", "component_id", "d2", "n_tokens", "h", "drops"]


def awkward(spark):
    rows = [(1, "some words here\nand more", "en", "a", 1), (1, "some words here\nand more", "en", "a", 1), (1, "another text", None, None, None), (None, "some words here\nand more", None, "a", 2),
            (None, None, None, None, None), (2, None, "en", "b", 0)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    df = awkward(spark)
    df = df.where("false") if empty else df
    n = 0 if empty else 6
    items = spark.createDataFrame([(1, "some words here and more")], "item_id long, text string")
    assert len(near_dup.near_duplicates(df).collect()) == n
    assert len(line_dedup.line_dedup(df, min_docs=2).collect()) == n
    assert len(mixing.mix(df).collect()) == n
    mixing.mix(df, texts=True).collect()
    assert len(secrets.find_secrets(df).collect()) == n
    found = decontaminate.decontaminate(df, items).collect()
    assert len(found) == n and sum(x.contaminated for x in found) == (0 if empty else 3)
    assert len(decontaminate.decontaminate(df, items.where("false")).collect()) == n
    assert len(quality.quality(df).collect()) == n
    assert repeats.repeated_passages(df).collect() == []
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert len(token_counts.token_counts(df, path).collect()) == n


def test_rows_with_one_id_are_one_component(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (9, a), (None, b), (3, "other text alone")]
    got = {(x.doc_id, x.component_id, x.kept) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5, True), (9, 5, False), (None, 5, False), (3, 3, True)}


def test_kept_digest_is_of_utf8(spark):
    got = spark.createDataFrame([("é",)], "t string").select(F.sha2(F.encode("t", "UTF-8"), 256)).first()[0]
    assert got == hashlib.sha256("é".encode()).hexdigest()


def test_places_around_candidates():
    import numpy as np

    r = random.Random(8)
    for _ in range(200):
        span, n = r.randint(1, 9), r.randint(0, 40)
        pos = np.array(sorted(r.choices(range(50), k=r.randint(0, 12))), np.int64)
        assert repeats.around(pos, span, n).tolist() == sorted({p - k for p in pos.tolist() for k in range(span) if 0 <= p - k < n})
    many = np.arange(1_000_000)
    assert len(repeats.around(many, 36, 1_000_000)) == 1_000_000  # a million candidates in a text: a few MB


def test_a_text_of_many_secrets(spark):
    """100,000 matches in one text, some too short, cost no more than their number."""
    n = 100_000
    text = " ".join(f"{i:016x}" if i % 3 else "ab" for i in range(n)) + " AKIA" + "A" * 16
    got = secrets.find_secrets(spark.createDataFrame([(1, text), (2, "ab " * 300 + "0123456789abcdef")], "doc_id long, text string")).collect()
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    spans = {x.doc_id: x.spans for x in got}
    assert [(s.start, s.end) for s in spans[1] if s.kind == "hex"] == want and [s.kind for s in spans[1]][-1] == "access"
    assert [(s.start, s.end, s.kind) for s in spans[2]] == [(900, 916, "hex")]


def test_labelling_keeps_no_gates_and_takes_long_pages():
    import numpy as np

    r = np.random.default_rng(3)
    e, h = html_extract.E, html_extract.H
    w, u, c = (r.standard_normal(n).astype(np.float32) * 0.1 for n in ((e, 4 * h), (h, 4 * h), (4 * h,)))
    x = r.standard_normal((2 * html_extract.STEPS + 5, 1, e)).astype(np.float32)
    states, saved = html_extract.lstm(x, w, u, c, keep=False)
    whole, kept = html_extract.lstm(x, w, u, c)
    assert saved == [] and len(kept) == len(x) and np.array_equal(states, whole)
    at, state, cell = 0, np.zeros((1, h), np.float32), np.zeros((1, h), np.float32)
    for at in range(len(x)):  # step by step, without blocks of steps
        z = x[at] @ w + c + state @ u
        i, f, o = (1 / (1 + np.exp(-z[:, k * h : (k + 1) * h])) for k in range(3))
        cell = f * cell + i * np.tanh(z[:, 3 * h :])
        state = o * np.tanh(cell)
        assert np.allclose(state, states[at], atol=1e-4)
