"""Source divergence audit by a two-pass vocabulary automaton.

The first pass takes exact document frequencies; a language keeps the terms found in at least
``min_docs`` of its documents. The second builds an Aho-Corasick automaton of the kept terms,
each between two delimiters, and recounts their occurrences in the texts, delimiters made
equal. Counts are summed in the workers before they are shuffled; what leaves them is a sparse
table of postings (lang, source, term, n > 0), from which shares, distances between sources
and ranks follow in whole numbers.

A share is ``p = 1 + floor(SCALE * (n + smooth) / (N + smooth * V))`` with N the group's kept
occurrences and V the language's kept terms. The distance of two sources is the sum of
``|p - q|`` over all V terms. A term that neither has adds ``|z - z'|``, z being a source's
share at n = 0, so only postings are visited: ``V * |z - z'|`` plus, for the terms of either,
what they differ from that. Sources are taken in blocks of ``BLOCK``, so the postings of a
term are compared in tiles of bounded size, and only sums leave a task.

A language's vocabulary is split by hash into shards of about ``shard_terms`` terms; small
languages share one. Each shard is one broadcast of that bounded size and one scan of the
texts of its languages, so no worker holds a vocabulary that grows with the corpus.

Edge cases. Null text, lang or source is ''. A text with no term counts as a document of its
language only. A group without terms has the same share for every term. A language without
kept terms (V = 0) has distances of 0 and no terms; one with a single source has no pairs.
Rows that repeat are documents of their own; ids are not read. Ties in value go by the item's
UTF-8. Empty tables give empty results. Terms and texts of any length are taken whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.llm.common import join_small, ship_package, small, staged

SCALE, BLOCK = 1_000_000_000, 64
#: Terms of a shard; entries that a worker counts before it hands them on; rows of a tile compared at once.
SHARD_TERMS, HELD, ROWS = 200_000, 300_000, 512
#: ASCII letters in lower case, other ASCII to a space, bytes of other characters as they are.
_PLAIN = bytes(b | 0x20 if chr(b).isalpha() else 0x20 for b in range(128)) + bytes(range(128, 256))


def plain(text: str) -> bytes:
    """The terms of ``text`` with spaces between them."""
    return text.encode("utf-8").translate(_PLAIN)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def document_frequencies(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """(lang, term, n_docs): the terms that at least ``min_docs`` documents of the language hold."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])
        held: dict[str, Counter] = {}

        def out():
            for lang, terms in held.items():
                if terms:
                    yield _batch([(lang, t.decode("utf-8"), n) for t, n in terms.items()], schema)
            held.clear()

        for batch in batches:
            for lang, text in zip(*batch.columns):
                held.setdefault(lang.as_py(), Counter()).update(set(plain(text.as_py()).split()))
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    counted = _named(docs).select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _shards(vocabulary: DataFrame, most: int) -> DataFrame:
    """``vocabulary`` with the ``shard`` of each term: of its own language, or one that small languages share."""
    v = vocabulary.groupBy("lang").agg(F.count("*").alias("_v"))
    little = F.col("_v") <= most // 8
    total = v.where(little).agg(F.sum("_v")).first()[0] or 0
    bins = max(1, -(-total // most))
    own = F.concat(F.lit("="), "lang", F.lit("="), F.pmod(F.xxhash64("term"), F.ceil(F.col("_v") / most)).cast("string"))
    shared = F.concat(F.lit("*"), F.pmod(F.xxhash64("lang"), F.lit(bins)).cast("string"))
    return vocabulary.join(v, "lang").select("lang", "term", F.when(little, shared).otherwise(own).alias("shard"))


def _automaton(terms: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(f" {term} ", i)
    made.make_automaton()
    return made


_worker: dict = {}


def _scan(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(lang, source, term, n) of one shard: ``terms`` by language, their number bounded."""
    shared, key = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
        if key not in _worker:  # a worker holds one shard at a time
            _worker.clear()
            _worker[key] = {lang: _automaton(found) for lang, found in shared.value.items()}
        automata, known = _worker[key], shared.value
        held: dict[tuple[str, str], Counter] = {}

        def out():
            for (lang, source), counts in held.items():
                if counts:
                    yield _batch([(lang, source, known[lang][i], n) for i, n in counts.items()], schema)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                if automaton := automata.get(lang := lang.as_py()):
                    padded = f" {plain(text.as_py()).decode('utf-8')} "
                    held.setdefault((lang, source.as_py()), Counter()).update(map(itemgetter(1), automaton.iter(padded)))
                    if sum(map(len, held.values())) > HELD:
                        yield from out()
        yield from out()

    return docs.mapInArrow(count, "lang string, source string, term string, n long")


def postings(docs: DataFrame, vocabulary: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, term, n): how often each source of a language uses each of its kept terms, where it does."""
    ship_package(docs.sparkSession)
    rows = _named(docs)
    sharded = staged(_shards(vocabulary, shard_terms), "shards")
    found = None
    for shard in sorted(r["shard"] for r in sharded.select("shard").distinct().collect()):  # a row for each 200,000 terms or so
        terms: dict[str, list[str]] = {}
        for r in sharded.where(F.col("shard") == shard).select("lang", "term").toLocalIterator():
            terms.setdefault(r["lang"], []).append(r["term"])
        here = rows.where(F.col("lang").isin(*terms)) if len(terms) <= 100 else rows
        part = staged(_scan(here, terms).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    return found


def _share(n, total, terms, smooth: int):
    """``1 + floor(SCALE * (n + smooth) / (total + smooth * terms))`` in decimals, as the product may pass 64 bits."""
    wide = "decimal(19,0)"
    return F.expr(f"1L + CAST(({n} + {smooth}L) AS {wide}) * {SCALE}BD div CAST({total} + {smooth}L * {terms} AS {wide})")


def groups(docs: DataFrame, vocabulary: DataFrame, found: DataFrame, smooth: int = 5) -> DataFrame:
    """(lang, source, at, total, lang_total, terms, zero): every group that occurs; ``at`` numbers the sources of a language,
    ``zero`` is the share of a term that the group lacks (null where the language keeps none)."""
    every = _named(docs).select("lang", "source").distinct()
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    all_ = every.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "terms"])
    by_lang = W.partitionBy("lang")  # a row for each source
    made = all_.withColumns({
        "at": F.row_number().over(by_lang.orderBy("source")) - 1,
        "lang_total": F.sum("total").over(by_lang),
    })
    return made.withColumn("zero", F.when(F.col("terms") > 0, _share("0L", "total", "terms", smooth)))


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of ``|p - q| - |z - z'|`` for the pairs of sources of each tile."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int64())])
    sums: dict[tuple, np.ndarray] = {}
    apart: dict[tuple, np.ndarray] = {}

    def out():
        for (lang, i, j), s in sums.items():
            a, b = np.nonzero(s)
            place = lambda k: np.where(k < BLOCK, i * BLOCK + k, j * BLOCK + k - BLOCK).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(place(a)), pa.array(place(b)), pa.array(s[a, b])], schema=schema)
        sums.clear()
        apart.clear()

    for batch in batches:
        of: dict[tuple, list[int]] = {}
        for r, tile in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lang", "i", "j")])):
            of.setdefault(tile, []).append(r)
        for tile, rows in of.items():
            z = np.array(batch.column("zeros")[rows[0]].as_py(), np.int64)
            m = len(z)
            if tile not in sums:
                sums[tile], apart[tile] = np.zeros((m, m), np.int64), np.abs(z[:, None] - z[None, :])
            total = sums[tile]
            for at in range(0, len(rows), ROWS):
                some = batch.take(pa.array(rows[at : at + ROWS]))
                entries = some.column("found")
                row = np.repeat(np.arange(len(some)), np.diff(entries.offsets.to_numpy()))
                p = np.tile(z, (len(some), 1))
                p[row, entries.flatten().field("k").to_numpy()] = entries.flatten().field("p").to_numpy()
                for k in range(m):
                    # within one block each pair once, across two blocks only from the first to the second
                    first = k + 1 if tile[1] == tile[2] else (BLOCK if k < BLOCK else m)
                    if first < m:
                        total[k, first:] += (np.abs(p[:, first:] - p[:, k : k + 1]) - apart[tile][k, first:]).sum(0)
        if len(sums) > 256:
            yield from out()
    yield from out()


def pair_distances(found: DataFrame, of: DataFrame, smooth: int = 5) -> DataFrame:
    """(lang, a, b, value): the distance of each two sources of a language, a and b their numbers, a < b."""
    known_small = small(of)
    blocks = of.where("terms > 0").groupBy("lang", F.floor(F.col("at") / BLOCK).cast("int").alias("block"))
    blocks = staged(blocks.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "zero"))), lambda x: x["zero"]).alias("zeros")), "blocks")
    first, second = (blocks.select("lang", F.col("block").alias(k), F.col("zeros").alias(f"_{k}")) for k in "ij")
    tiles = first.join(second, "lang").where("i <= j")
    tiles = tiles.select("lang", "i", "j", F.when(F.col("i") == F.col("j"), F.col("_i")).otherwise(F.concat("_i", "_j")).alias("zeros"))
    rows = join_small(found, of.select("lang", "source", "at", "total", "terms"), ["lang", "source"], "inner", known_small)
    rows = rows.select("lang", "term", "at", F.floor(F.col("at") / BLOCK).cast("int").alias("block"), _share("n", "total", "terms", smooth).alias("p"))
    own = (F.col("block") == F.col("i")) | (F.col("block") == F.col("j"))
    dealt = join_small(rows, tiles.select("lang", "i", "j"), "lang", "inner", known_small).where(own)
    k = (F.col("at") % BLOCK + F.when(F.col("block") == F.col("i"), 0).otherwise(BLOCK)).cast("int")
    # at most 2 * BLOCK entries to a group
    dealt = dealt.groupBy("lang", "i", "j", "term").agg(F.collect_list(F.struct(k.alias("k"), "p")).alias("found")).drop("term")
    sums = join_small(dealt, tiles, ["lang", "i", "j"], "inner", known_small).mapInArrow(_tile_sums, "lang string, a int, b int, part long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    a, b = (of.select("lang", F.col("at").alias(x), F.col("zero").alias(f"_{x}"), F.col("terms").alias(f"_terms{x}")) for x in "ab")
    base = a.join(b, "lang").where("a < b")
    far = F.coalesce(F.col("_termsa") * F.abs(F.col("_a") - F.col("_b")), F.lit(0).cast("long"))
    return base.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", (far + F.coalesce("part", F.lit(0))).cast("long").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows give a group's distance to each other source of its language, ``term``
    rows the ``top`` terms whose share in the group most exceeds their share in the language."""
    vocabulary = staged(document_frequencies(docs, min_docs), "vocabulary")
    found = postings(docs, vocabulary, shard_terms)
    of = staged(groups(docs, vocabulary, found, smooth), "groups")
    known_small = small(of)
    far = staged(pair_distances(found, of, smooth), "pairs")
    both = far.select("lang", F.col("a").alias("at"), F.col("b").alias("_other"), "value").unionByName(
        far.select("lang", F.col("b").alias("at"), F.col("a").alias("_other"), "value")
    )
    name = of.select("lang", "at", "source")
    pairs = join_small(both, name, ["lang", "at"], "inner", known_small)
    pairs = join_small(pairs, name.select("lang", F.col("at").alias("_other"), F.col("source").alias("item")), ["lang", "_other"], "inner", known_small)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    counted = found.withColumn("_all", F.sum("n").over(W.partitionBy("lang", "term")))  # a row for each source that has the term
    counted = join_small(counted, of.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"], "inner", known_small)
    over = _share("n", "total", "terms", smooth) - _share("_all", "lang_total", "terms", smooth)
    terms = counted.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])
