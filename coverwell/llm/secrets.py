"""Secret scans with a trigram inverted index.

Each rule is a regular expression. From it a Boolean query on trigrams is derived: clauses
that must all hold, each a choice of alternatives, each a set of trigrams that a match must
contain. The index has, for every trigram that some query asks for, the ids of the documents
whose lower-cased text holds it, cut into segments of bounded length by id. Postings are
intersected per segment, and the rule runs only over its candidates. A rule without mandatory
trigrams (``hex``) scans every text.

Edge cases. A null text counts as an empty one. Matches are leftmost and do not overlap
within a kind; kinds may overlap each other. Places count code points from 0, ends exclusive.
Rows that repeat in id and text are scanned alike. Ids may be null; empty tables give empty
results; other columns stay, but for those named as a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import let, row_key, unclashed


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(f"{either_case(w)}" for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED
#: What a text must contain, by one fast test, before a rule without trigrams extracts matches.
QUICK = {"hex": r"[0-9a-f]{16}"}
#: Matches to a block.
STEP = 256

Query = list[list[frozenset[str]]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Clauses of a conjunction; each lists alternatives, sets of lower-case trigrams. Empty: any text may match."""
    clauses: Query = []

    def flush(strings: set[str]) -> None:
        found = [trigrams(s) for s in sorted(strings)]
        if all(found):  # an alternative that asks for more than another adds nothing
            clauses.append([a for a in dict.fromkeys(found) if not any(b < a for b in found)])

    def exact(item) -> set[str] | None:
        """All strings that the item stands for, lower-cased, if they are few."""
        op, arg = item
        if op is rc.LITERAL:
            return {chr(arg).lower()}
        if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            got = {chr(a).lower() for _, a in arg}
            return got if len(got) <= 5 else None
        if op is rc.MAX_REPEAT and arg[1] == 1 and (inner := run(arg[2])) is not None:
            return inner | {""} if arg[0] == 0 else inner
        if op is rc.SUBPATTERN:
            return run(arg[3])
        if op is rc.BRANCH:
            parts = [run(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        return None

    def run(items) -> set[str] | None:
        strings = {""}
        for item in items:
            if (got := exact(item)) is None or len(got) * len(strings) > most:
                return None
            strings = {a + b for a, b in product(strings, got)}
        return strings

    strings = {""}
    for item in rp.parse(pattern):
        got = exact(item)
        if got is None or len(got) * len(strings) > most:
            flush(strings)
            strings = got if got is not None else {""}
        else:
            strings = {a + b for a, b in product(strings, got)}
    flush(strings)
    return clauses


def posting_lists(keyed: DataFrame, grams: list[str], segments: int) -> DataFrame:
    """(gram, segment, ids): the index, for the trigrams asked for. ``keyed`` has _id, a hash of the row, and text."""
    low = F.lower("text")  # lower-casing beyond ASCII only adds candidates
    held = let(low, lambda t: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(t, g)))
    rows = keyed.select("_id", F.explode(held).alias("gram"))
    return rows.groupBy("gram", F.pmod("_id", F.lit(segments)).alias("segment")).agg(F.collect_set("_id").alias("ids"))


def _all(lists: str) -> Column:
    return F.expr(f"aggregate(slice({lists}, 2, size({lists})), {lists}[0], (a, b) -> array_intersect(a, b))")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(_id, kinds): the rules whose trigram query each document answers, by intersecting postings per segment."""
    asked = [
        (kind, i, len(query), j, len(alt), g)
        for kind, query in queries.items()
        for i, clause in enumerate(query)
        for j, alt in enumerate(clause)
        for g in sorted(alt)
    ]
    spark = index.sparkSession
    table = spark.createDataFrame(asked, "kind string, clause int, n_clauses int, alt int, n_grams int, gram string")
    by_alt = (
        index.join(F.broadcast(table), "gram")
        .groupBy("kind", "clause", "n_clauses", "alt", "n_grams", "segment")
        .agg(F.collect_list("ids").alias("lists"))
        .where(F.size("lists") == F.col("n_grams"))
        .withColumn("ids", _all("lists"))
    )
    by_clause = by_alt.groupBy("kind", "clause", "n_clauses", "segment").agg(
        F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")
    )
    by_rule = (
        by_clause.groupBy("kind", "n_clauses", "segment")
        .agg(F.collect_list("ids").alias("lists"))
        .where(F.size("lists") == F.col("n_clauses"))
        .withColumn("ids", _all("lists"))
    )
    return by_rule.select("kind", F.explode("ids").alias("_id")).groupBy("_id").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(rule: Rule, order: int, text: Column) -> Column:
    """The rule's spans in a text: array of (start, ord, end, kind)."""
    pattern = F.lit(rule.pattern)
    upto = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{rule.pattern})"), F.lit(0))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sized = F.transform(
        F.arrays_zip(upto.alias("u"), whole.alias("w"), part.alias("p")),
        lambda m: F.struct(F.length(m["u"]).alias("u"), F.length(m["w"]).alias("w"), F.length(m["p"]).alias("p")),
    )
    return let(sized, lambda found: _placed(rule, order, found))


def _placed(rule: Rule, order: int, found: Column) -> Column:
    """Spans of matches (u: length up to and with the match, w: of the match, p: of the part that counts), linear in their number.

    Spans are appended within blocks of ``STEP`` matches, each from the length of the blocks before it, and the blocks are joined.
    """
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def block(matches: Column, at: Column) -> Column:
        span = lambda acc, m: F.struct(
            (acc["at"] + m["u"] - m["w"]).alias("start"), F.lit(order).alias("ord"), (acc["at"] + m["u"]).alias("end"), F.lit(rule.kind).alias("kind")
        )
        step = lambda acc, m: F.struct(
            (acc["at"] + m["u"]).alias("at"), F.when(m["p"] >= rule.least, F.array_append(acc["out"], span(acc, m))).otherwise(acc["out"]).alias("out")
        )
        return F.aggregate(matches, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def joined(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, m: n + m["u"]))
        before = lambda sums, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda n, x: n + x)
        return let(lengths, lambda sums: F.flatten(F.transform(blocks, lambda b, k: block(b, before(sums, k)))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda k: F.slice(found, k * STEP + 1, F.lit(STEP)))
    return F.when(F.size(found) == 0, none).when(F.size(found) <= STEP, block(found, F.lit(0))).otherwise(let(cut, joined))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ids_a_segment: int = 4096) -> DataFrame:
    """The rows of ``docs`` with spans, an array of (start, ord, end, kind) by start and then in the order of ``rules``."""
    docs = unclashed(docs, "spans", "kinds", "_id", "_th")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
    keyed = row_key(docs).withColumn("_id", F.xxhash64("doc_id", "_th"))
    keyed = keyed.withColumn("text", F.coalesce("text", F.lit("")))
    joined = keyed
    if grams:
        segments = max(16, docs.count() // ids_a_segment)
        index = posting_lists(keyed.select("_id", "text"), grams, segments)
        joined = keyed.join(candidates(index, queries).hint("shuffle_hash"), "_id", "left")
    else:
        joined = keyed.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        if rule.kind in queries:
            test = F.array_contains("kinds", rule.kind)
        else:
            test = F.col("text").rlike(QUICK.get(rule.kind, rule.pattern))
        found.append(F.when(test, rule_spans(rule, order, F.col("text"))).otherwise(none))
    out = [F.col(c) for c in docs.columns if c != "text"]
    return joined.select(*out, F.sort_array(F.concat(*found)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
