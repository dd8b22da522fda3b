"""Conversation repair against a search over all edits, on random and awkward conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from coverwell.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, SEG int, n string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines): the least by cost, then letters, of all edits, found by Dijkstra over (row, state)."""
    n = len(rows)
    step = lambda state, sign: {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}.get((sign, state))
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        if i == n and state in (0, 3):
            # an insertion may still tie with nothing here, as every edit costs
            return cost, audit, lines
        seen.add((i, state))
        for role in ("user", "assistant"):
            if (s := step(state, role[0])) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", i, s, (*lines, f"{role}:")))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.TRUNCATED else 0
                if (s := step(state, role[:1])) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, s, (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if (s := step(state, to[0])) is not None:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, s, (*lines, f"{to}:{text}")))


def brute(turns, damaged=True):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv]
        show = lambda v: " " if v is None else str(v)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        elif d == 2:
            text = re.sub("[.!?]", "", text)
        elif d == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, n = set(), [], [0, 0, 0]
        for _, role, text in rows:
            cut = text.strip(WHITE)
            fault = repair.BLANK if not cut else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if cut[-1] not in ".!?" else 0
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                n[fault - 1] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = cheapest(judged)
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spoken(seed, convs=60, most=14):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = r.choice([0, 3, -2])
        for k in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.5 else ("user", "assistant")[k % 2]
            text = r.choice(["Yes.", "No!", "Cut off", " \t", None, "", f"Said {k}.", f"Said {k}?\n ", "é漢.", "many words. " * 30])
            rows.append((c * 3, turn, role, text))
            turn = r.choice([turn, turn + 1, turn + 1, turn + 1, turn + 4, None]) if turn is not None else r.choice([None, 5])
    return rows + [r.choice(rows) for _ in range(20)] + [(None, None, None, None), (None, 2, "user", "Hm."), (None, None, "user", "Hm.")]


def told(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {x.conv_id: tuple(x[n] for n in names) for x in df.collect()}


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(parts)


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize("chunk", [256, 3])
def test_equals_the_search(spark, monkeypatch, chunk, damaged):
    monkeypatch.setattr(repair, "CHUNK", chunk)  # workers are forked with the module as it is, so chunks are checked below too
    rows = spoken(7)
    df = table(spark, rows)
    got = told(repair.repair(repair.damage(df) if damaged else repair.plain_turns(df)))
    assert got == brute(rows, damaged)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [1, 2, 5, 400])
def test_layers_and_chains_equal_the_search(seed, chunk, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    r = random.Random(seed)
    for _ in range(40):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), f"t{k}", r.choice([0, 0, 0, 1, 2, 3])) for k in range(r.randint(0, 16))]
        cost, audit, lines = cheapest(rows)
        signs = [(role[:1], fault) for role, _, fault in rows]
        assert repair.trace(signs, repair.cost_layers(signs, 0b1001), 0) == (cost, audit)
        assert tuple(repair.repaired([(a, b) for a, b, _ in rows], audit, 0)) == lines
        best = {0: (0, None)}
        for at in range(0, len(rows), chunk):
            part = repair.Chunk()
            for k, (role, text, fault) in enumerate(rows[at : at + chunk]):
                part.add(k, role, text, fault)
            now = {}
            for x in part.between():
                if x["entry"] in best:
                    c, chain = best[x["entry"]]
                    found, held = (c + x["cost"], (chain, x["audit"], x["entry"], at)), now.get(x["leave"])
                    if held is None or found[0] < held[0] or (found[0] == held[0] and repair._older(found[1], held[1])):
                        now[x["leave"]] = found
            best = now
        def spelt(chain):
            return spelt(chain[0]) + chain[1] if chain else ""

        assert min((c, spelt(chain)) for s, (c, chain) in best.items() if s in (0, 3)) == (cost, audit)


def test_long_and_repeated_turns(spark):
    r = random.Random(3)
    one = [(1, k, r.choice(["user", "assistant", "system"]), r.choice([f"Line {k}.", "Again.", f"cut {k}", ""])) for k in range(3000)]
    same = [(2, 5, "user", "Again and again.")] * 1500 + [(2, 6, "assistant", "So.")]
    rows = one + same + [(3, 0, "user", "Hi."), (3, 1, "assistant", "Ho.")]
    got = told(repair.repair(repair.plain_turns(table(spark, rows, 5))))
    assert got == brute(rows, False)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = told(repair.repair(repair.damage(table(spark, [(gone, 0, "user", "Hi."), (gone, 0, "user", "Hi.")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(repair.damage(table(spark, []))).collect() == []


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in spoken(11) if r[0] is not None]
    table(spark, rows, 1).drop("SEG", "n").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"
    want = con.execute(f"SELECT {names.replace(' ', ', ')} FROM ({queries.ORACLES['op12_conversation_repair']})").fetchall()
    assert told(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))) == {w[0]: w[1:] for w in want} == brute(rows)
