"""Conversation structure repair by layers of cost.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``. Four states say
what was read last: nothing, s, u, a. For each turn, from the last to the first, a whole
number holds a bitset of states for every remaining cost: digit c (four bits) has the states
from which the end is reached at exactly the cost c. An edit is a shift: deletion by two
digits, a change of role by one, an insertion by five within the turn. The first digit that
holds the entry state is the cost, and following the bits from there, least letter first,
spells the least audit. Costs of the four states never differ by more than 12 where it
matters (two insertions reach any later state, and having read nothing saves at most one
deletion), so 16 digits above the least one hold every optimum.

Turns are sorted by one range-partitioned sort and streamed. A conversation that lies within
a partition and has at most ``CHUNK`` rows is settled there. One that is longer, or that a
partition cuts, leaves a small row for each chunk: for every entry and exit state the cost and
the least audit between them (two audits of the same rows and cost are never prefixes of each
other, so the least whole is made of least parts). These rows are chained, the chosen audits
go back to the chunks' texts, and the digest of the repaired text is taken as a stream, so no
task holds the text of a long conversation.

Edge cases. Null role or text is one space (so a null text is blank); a null in the damage
key is one space there. Turns sort by turn, null first, then role and text; rows that repeat
are adjacent, and all but the first are duplicates. Null ids are one conversation. An empty
role has no initial. A conversation whose rows were all dropped gives zeros, an empty audit
and the digest of an empty text. Empty tables give empty results; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import WHITE, ship_package, staged

#: Rows and characters of a chunk, at most.
CHUNK, CHARS = 256, 1 << 20
#: Masks of one state over 24 digits; the digits kept.
_S, _U, _A, _DIGITS = int("2" * 24, 16), int("4" * 24, 16), int("8" * 24, 16), (1 << 64) - 1
_FINAL = 0b1001
LEGAL = {"su", "ua", "au"}
#: Faults, in the order in which they count.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _before(sign: str, layers: int) -> int:
    """The states from which reading ``sign`` leads into ``layers``, in every digit."""
    if sign == "u":
        x = layers & _U
        return x >> 2 | x >> 1 | x << 1
    return (layers & (_A if sign == "a" else _S)) >> 1 if sign in ("a", "s") else 0


def _after(sign: str, states: int) -> int:
    return {"u": 4 if states & 0b1011 else 0, "a": 8 if states & 4 else 0, "s": 2 if states & 1 else 0}.get(sign, 0)


def _closed(layers: int, base: int) -> tuple[int, int]:
    """``layers`` with up to two insertions before them, the digits from the least one on."""
    for _ in range(2):
        layers |= (_before("u", layers) | _before("a", layers)) << 20
    if layers:
        low = ((layers & -layers).bit_length() - 1) // 4
        layers, base = layers >> 4 * low & _DIGITS, base + low
    return layers, base


def cost_layers(rows: list[tuple[str, int]], target: int) -> list[tuple[int, int]]:
    """For each place before, between and after ``rows`` (initial, fault): (digits, cost of the lowest digit)."""
    out = [_closed(target, 0)]
    for sign, fault in reversed(rows):
        layers, base = out[-1]
        now = layers << 8
        if fault not in (BLANK, DUPLICATE):
            more = 20 if fault == TRUNCATED else 0
            now |= _before(sign, layers) << more | (_before("u", layers) | _before("a", layers)) << more + 4
        out.append(_closed(now, base))
    return out[::-1]


def trace(rows: list[tuple[str, int]], layers: list[tuple[int, int]], entry: int) -> tuple[int, str] | None:
    """(cost, least audit) from the state ``entry`` to the target of ``layers``; None where it can't be reached."""

    def at(i: int, cost: int) -> int:
        digits, base = layers[i]
        return digits >> 4 * (cost - base) & 15 if base <= cost < base + 16 else 0

    states, (_, base) = 1 << entry, layers[0]
    left = next((c for c in range(base, base + 16) if at(0, c) & states), None)
    if left is None:
        return None
    cost, i, out = left, 0, []
    while i < len(rows) or left:
        inserted = (_after("u", states) | _after("a", states)) & at(i, left - 5)
        if i == len(rows):
            letter, states, left = "I", inserted, left - 5
        else:
            sign, fault = rows[i]
            more = 5 if fault == TRUNCATED else 0
            may = fault not in (BLANK, DUPLICATE)
            if now := states & at(i + 1, left - 2):
                letter, states, left, i = "D", now, left - 2, i + 1
            elif inserted:
                letter, states, left = "I", inserted, left - 5
            elif may and (now := _after(sign, states) & at(i + 1, left - more)):
                letter, states, left, i = "K", now, left - more, i + 1
            else:
                letter, states, left, i = "R", (_after("u", states) | _after("a", states)) & at(i + 1, left - more - 1), left - more - 1, i + 1
        out.append(letter)
    return cost, "".join(out)


def repaired(lines: list[tuple[str, str]], audit: str, entry: int) -> list[str]:
    """The ``role:text`` lines that ``audit`` makes of ``lines`` (role, text), read from the state ``entry``."""
    out, state, rest = [], entry, iter(lines)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        out.append(f"{role}:{text}")
    return out


class Chunk:
    """Rows of one conversation that follow each other, and what is counted of them."""

    def __init__(self):
        self.signs: list[tuple[str, int]] = []
        self.lines: list[tuple[str, str]] = []
        self.chars = 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.ends: dict = dict.fromkeys(("first", "last", "low", "high", "first_turn", "last_turn"))

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        sign, c, e = role[:1], self.counts, self.ends
        if not self.signs:
            e["first"], e["first_turn"] = sign, turn
        elif e["last"] + sign not in LEGAL:
            c["illegal"] += 1
        if turn is not None:
            c["turns"] += not self.signs or e["last_turn"] != turn
            e["low"], e["high"] = turn if e["low"] is None else e["low"], turn
        e["last"], e["last_turn"] = sign, turn
        if fault:
            c[("blank", "duplicate", "truncated")[fault - 1]] += 1
        self.signs.append((sign, fault))
        self.lines.append((role, "") if fault in (BLANK, DUPLICATE) else (role, text))  # those go in any case
        self.chars += len(self.lines[-1][1])

    def full(self) -> bool:
        return len(self.signs) >= CHUNK or self.chars >= CHARS

    def between(self) -> list[dict]:
        """For each entry and exit state the cost and the least audit."""
        out = []
        for leave in range(4):
            layers = cost_layers(self.signs, 1 << leave)
            for entry in range(4):
                if got := trace(self.signs, layers, entry):
                    out.append({"entry": entry, "leave": leave, "cost": got[0], "audit": got[1]})
        return out


def follow(a: dict, b: dict) -> dict:
    """What is counted of two chunks in a row."""
    if a["first"] is None or b["first"] is None:
        return b if a["first"] is None else a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
    return out | {
        "first": a["first"], "first_turn": a["first_turn"], "last": b["last"], "last_turn": b["last_turn"],
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
    }


def _summary(s: dict, cost: int, audit: str) -> dict:
    gaps = 0 if s["high"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"gaps": gaps, "cost": cost, "audit": audit} | {k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}


_COUNTED = "blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, first_turn long, last_turn long"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_BETWEEN = "array<struct<entry:int,leave:int,cost:long,audit:string>>"


def _out(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)


def _types(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    flat = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    nested = {
        "between": pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
        "lines": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
    }
    fields = [f.strip().split(" ") for f in ddl.split(", ")]
    return [n for n, _ in fields], [nested.get(n) or flat[k] for n, k in fields]


class Sink:
    """Gathers rows and gives them out in batches of bounded size."""

    def __init__(self, ddl: str):
        self.names, self.kinds = _types(ddl)
        self.rows: list[dict] = []
        self.chars = 0

    def put(self, row: dict, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars + len(row.get("audit") or "")
        if len(self.rows) >= 1000 or self.chars >= 4 * CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _out(self.rows, self.names, self.kinds)
        self.rows, self.chars = [], 0


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _cutter(id_type: str):
    """The first pass over sorted rows: whole short conversations are settled, others leave their chunks."""
    ddl = f"conv_id {id_type}, seg long, done boolean, {_COUNTED}, gaps long, cost long, audit string, repaired_sha256 string, between {_BETWEEN}, lines array<struct<role:string,text:string>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, seg = Sink(ddl.replace(f"conv_id {id_type}", "conv_id long") if id_type == "bigint" else ddl), TaskContext.get().partitionId() << 33
        conv, chunk, alone, edge = None, None, True, True

        def close(last: bool):
            """Gives out the chunk; ``last``: the conversation may go on in the next partition."""
            nonlocal seg, alone
            row = {"conv_id": conv, "seg": seg, "done": alone and not edge and not last}
            seg += 1
            if row["done"]:
                cost, audit = trace(chunk.signs, cost_layers(chunk.signs, _FINAL), 0)
                text = "\n".join(repaired(chunk.lines, audit, 0))
                row |= _summary(chunk.counts | chunk.ends, cost, audit) | {"repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
                yield from sink.put(row)
            else:
                row |= chunk.counts | chunk.ends | {"between": chunk.between(), "lines": [{"role": r, "text": t} for r, t in chunk.lines]}
                yield from sink.put(row, 16 * len(chunk.signs) + chunk.chars)

        for id_, turn, role, text, n, first, blank, short in _rows(batches, "conv_id", "turn", "role", "text", "n", "first", "blank", "short"):
            if chunk is None:
                conv, chunk = id_, Chunk()
            elif id_ != conv:
                yield from close(False)
                conv, chunk, alone, edge = id_, Chunk(), True, False
            for copy in range(n):
                if chunk.full():
                    alone = False
                    yield from close(False)
                    chunk = Chunk()
                chunk.add(turn, role, text, BLANK if blank else DUPLICATE if copy or not first else TRUNCATED if short else 0)
        if chunk is not None:
            yield from close(True)
        yield from sink.rest()

    return cut, ddl


def _older(a: tuple, b: tuple) -> bool:
    """Whether the chain ``a`` spells the lesser audit; chains are (before, audit, entry, seg) and of one length."""
    pairs = []
    while a is not b and a is not None:
        pairs.append((a[1], b[1]))
        a, b = a[0], b[0]
    return [x for x, _ in reversed(pairs)] and "".join(x for x, _ in reversed(pairs)) < "".join(y for _, y in reversed(pairs))


def _chooser(id_type: str):
    """The second pass over the chunks of each conversation in order: which audit each of them takes."""
    kind = "long" if id_type == "bigint" else id_type
    ddl = f"conv_id {id_type}, seg long, entry int, part string, last boolean, {_RESULT}"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(ddl.replace(f"conv_id {id_type}", f"conv_id {kind}"))
        names = [f.split(" ")[0] for f in _COUNTED.split(", ")]
        conv, counted, best, begun = None, {}, {}, False

        def close():
            ends = [best[s] for s in (0, 3) if s in best]
            cost = min(c for c, _ in ends)
            chains = [chain for c, chain in ends if c == cost]
            chain = chains[1] if len(chains) > 1 and _older(chains[1], chains[0]) else chains[0]
            links = []
            while chain is not None:
                links.append(chain)
                chain = chain[0]
            links.reverse()
            result = _summary(counted, cost, "".join(x[1] for x in links))
            for k, (_, audit, entry, seg) in enumerate(links):
                row = {"conv_id": conv, "seg": seg, "entry": entry, "part": audit, "last": k == len(links) - 1}
                yield from sink.put(row | (result if row["last"] else {}), len(audit))

        for id_, seg, between, *values in _rows(batches, "conv_id", "seg", "between", *names):
            if not begun or id_ != conv:
                if begun:
                    yield from close()
                conv, counted, best, begun = id_, dict.fromkeys(names), {0: (0, None)}, True
            counted = follow(counted, dict(zip(names, values)))
            now: dict[int, tuple[int, tuple]] = {}
            for x in between:
                if x["entry"] in best:
                    cost, chain = best[x["entry"]]
                    found = (cost + x["cost"], (chain, x["audit"], x["entry"], seg))
                    held = now.get(x["leave"])
                    if held is None or found[0] < held[0] or (found[0] == held[0] and _older(found[1], held[1])):
                        now[x["leave"]] = found
            best = now
        if begun:
            yield from close()
        yield from sink.rest()

    return choose, ddl


def _hasher(id_type: str):
    """The third pass over the chosen chunks in order: the digest of the repaired text."""
    kind = "long" if id_type == "bigint" else id_type
    ddl = f"conv_id {id_type}, {_RESULT}, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(ddl.replace(f"conv_id {id_type}", f"conv_id {kind}"))
        names = [f.split(" ")[0] for f in _RESULT.split(", ")]
        sha, empty = hashlib.sha256(), True
        small_ = (b for batch in batches for b in (batch.slice(i, 16) for i in range(0, len(batch), 16)))
        for id_, entry, part, lines, last, *values in _rows(small_, "conv_id", "entry", "part", "lines", "last", *names):
            for line in repaired([(x["role"], x["text"]) for x in lines], part, entry):
                sha.update((line if empty else f"\n{line}").encode())
                empty = False
            if last:
                yield from sink.put({"conv_id": id_, "repaired_sha256": sha.hexdigest()} | dict(zip(names, values)))
                sha, empty = hashlib.sha256(), True
        yield from sink.rest()

    return digest, ddl


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as the drill leaves them, by crc32 of ``conv_id:turn`` modulo 20; n = 0 for a dropped one."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.withColumn("_d", fault).select(
        "conv_id", F.when(F.col("_d") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("_d") == 0, "").when(F.col("_d") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_d").isin(0, 1), "").when(F.col("_d") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def plain_turns(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` as they are, in the form that ``repair`` takes."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select("conv_id", "turn", role, text, F.lit(1).cast("long").alias("n"))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``rows``
    (conv_id, turn, role, text, n), a row of n = 0 only saying that its conversation exists."""
    ship_package(rows.sparkSession)
    id_type = dict(rows.dtypes)["conv_id"]
    # equal rows become one with a count, so a turn that repeats without end is one row
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    alike = staged(alike.withColumn("_said", F.sha2(F.encode("text", "UTF-8"), 256)), "turns")
    real = alike.where("n > 0")
    said = real.groupBy("conv_id", "role", "_said").agg(F.min(F.struct("turn")).alias("_t"))  # a struct's null is its least
    first = said.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_said").alias("_s"), F.col("_t.turn").alias("_first"))
    same = (F.col("role") == F.col("_r")) & (F.col("_said") == F.col("_s"))
    same &= F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_first"))
    told = alike.join(first, same, "left")
    last = F.right(_trimmed(F.col("text")), F.lit(1))
    told = told.select(
        "conv_id", "turn", "role", "text", "n", F.col("_r").isNotNull().alias("first"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("short"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    cut, ddl = _cutter(id_type)
    found = staged(told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, ddl), "chunks")
    result = ["conv_id", *[f.split(" ")[0] for f in _RESULT.split(", ")], "repaired_sha256"]

    by_place = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "seg")  # noqa: E731  a row for each chunk
    open_ = found.where("not done")
    choose, ddl = _chooser(id_type)
    chosen = by_place(open_.select("conv_id", "seg", "between", *[f.split(" ")[0] for f in _COUNTED.split(", ")])).mapInArrow(choose, ddl)
    digest, ddl = _hasher(id_type)
    joined = chosen.join(open_.select("seg", "lines"), "seg")
    return found.where("done").select(*result).unionByName(by_place(joined).mapInArrow(digest, ddl).select(*result))
