"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words, and of every ``span`` consecutive k-grams the one
with the least hash is kept (the last of equals). A shared run of ``k + span - 1`` words has
the same k-grams on both sides, hence keeps the same one: with k = 5 and span = 6 no shared
window of ten words is missed. Document fingerprints are joined with the benchmark's; a hit
is then extended left and right to the windows around it, which are compared word by word.

Items of fewer than ten words are one window of their own length, found by exact k-grams of
that length (at most nine such lengths exist).

Edge cases. Null or empty texts have no words; items without words have no windows and match
nothing. Rows that repeat in id and text get the same result, each in its own row; items that
repeat are counted once by id. Null document ids are allowed, null item ids are left out of
the lists. An empty benchmark or document table gives uncontaminated or no rows. Extra
columns stay; those named as a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import ascii_lower, let, row_key, same_row, small, staged, unclashed

PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
SPAN = WINDOW - K + 1


def item_words(text: Column) -> Column:
    """Lower-cased words of digits, a-z and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PUNCTUATION), "")


def kgrams(hashes: Column, k: int) -> Column:
    """The hash of every run of ``k`` words, in order."""
    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))
    return F.when(F.size(hashes) < k, F.array().cast("array<bigint>")).otherwise(grams)


def fingerprints(hashes: Column, k: int = K, span: int = SPAN) -> Column:
    """The distinct k-gram hashes that are the least of some ``span`` in a row."""
    least = lambda gs: F.transform(
        F.sequence(F.lit(1), F.size(gs) - (span - 1)), lambda i: F.array_min(F.slice(gs, i, span))
    )
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) < k + span - 1, none).otherwise(F.array_distinct(let(kgrams(hashes, k), least)))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(len, win, fp, set_id, items): distinct windows as word lists, their fingerprint, and the items that hold them."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("ws") - n + 1)
    windows = items.select("item_id", n.alias("len"), "ws", F.explode(starts).alias("i")).select(
        "item_id", "len", F.slice("ws", F.col("i"), F.col("len")).alias("win")
    )
    held = windows.groupBy("len", "win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    fp = F.when(F.col("len") == WINDOW, F.get(fingerprints(word_hashes(F.col("win"))), F.lit(0))).otherwise(
        F.xxhash64(word_hashes(F.col("win")))
    )
    return held.select("len", "win", fp.alias("fp"), F.xxhash64("items").alias("set_id"), "items")


def _hits(docs: DataFrame, windows: DataFrame, short_lengths: list[int], known_small: bool) -> DataFrame:
    """(doc_id, _th, i, len, set_id): every place of a document where a window occurs."""
    rows = row_key(docs).select("doc_id", "_th", "text")
    lengths = [WINDOW, *short_lengths]

    def marks(hashes: Column) -> Column:
        by_len = lambda n, fps: F.transform(fps, lambda g: F.struct(F.lit(n).alias("len"), g.alias("fp")))
        short = [by_len(n, F.array_distinct(kgrams(hashes, n))) for n in short_lengths]
        long_ = by_len(WINDOW, fingerprints(hashes))
        return F.concat(long_, *short) if short else long_

    def starts(hashes: Column) -> Column:
        """First words of the windows that hold a matched fingerprint, (len, i)."""

        def at(n: int) -> Column:
            k, back = (K, SPAN - 1) if n == WINDOW else (n, 0)
            mine = F.try_element_at(F.col("fps_by_len"), F.lit(n))

            def places(gs: Column) -> Column:
                found = F.filter(F.sequence(F.lit(1), F.size(gs)), lambda i: F.array_contains(mine, F.get(gs, i - 1)))
                return F.flatten(
                    F.transform(found, lambda i: F.sequence(F.greatest(i - back, F.lit(1)), F.least(i, F.size(hashes) - n + 1)))
                )

            got = F.array_distinct(let(kgrams(hashes, k), places))
            enough = (F.size(hashes) >= n) & mine.isNotNull()
            none = F.array().cast("array<struct<len:int,i:int>>")
            return F.when(enough, F.transform(got, lambda i: F.struct(F.lit(n).alias("len"), i.alias("i")))).otherwise(none)

        return F.concat(*[at(n) for n in lengths])

    cut = let(item_words(F.col("text")), lambda ws: let(word_hashes(ws), marks))
    seeds = rows.select("doc_id", "_th", F.explode(cut).alias("m")).select("doc_id", "_th", "m.len", "m.fp")
    wanted = windows.select("len", "fp").distinct()
    seeds = seeds.join(F.broadcast(wanted) if known_small else wanted, ["len", "fp"], "left_semi")
    by_len = seeds.groupBy("doc_id", "_th", "len").agg(F.collect_set("fp").alias("fps"))
    found = by_len.groupBy("doc_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("len", "fps"))).alias("fps_by_len"))
    found = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("_th", "_rh")
    back = rows.join(
        found.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_th"] == F.col("_rh"))
    )  # the texts of documents that hold a seed
    around = let(
        item_words(F.col("text")),
        lambda ws: F.transform(
            let(word_hashes(ws), starts), lambda w: F.struct(w["len"].alias("len"), w["i"].alias("i"), F.slice(ws, w["i"], w["len"]).alias("win"))
        ),
    )
    near = back.select("doc_id", "_th", F.explode(around).alias("w")).select("doc_id", "_th", "w.len", "w.i", "w.win")
    exact = windows.select("len", "win", "set_id")
    return near.join(F.broadcast(exact) if known_small else exact, ["len", "win"]).select("doc_id", "_th", "i", "len", "set_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """All rows of ``docs`` with n_words, n_hit, n_items, item_ids and contaminated.

    A word is hit if it lies in any occurrence of a benchmark window; item_ids are the items
    with occurring windows, sorted as strings.
    """
    docs = unclashed(docs, "n_words", "n_hit", "n_items", "item_ids", "contaminated", "_th", "_id", "_rh")
    windows = staged(benchmark_windows(benchmark), "windows")
    short_lengths = sorted(r[0] for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect())  # at most nine
    known_small = small(windows, broadcast_rows)
    hits = staged(_hits(docs, windows, short_lengths, known_small), "hits")
    # words covered: runs of starts, so that no place is counted twice
    spans = hits.groupBy("doc_id", "_th", "i").agg(F.max("len").alias("len"))
    covered = spans.groupBy("doc_id", "_th").agg(F.sort_array(F.collect_list(F.struct("i", "len"))).alias("s"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["i"] + x["len"] - F.greatest(acc["end"], x["i"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], x["i"] + x["len"]).alias("end"),
    )
    covered = covered.select(
        "doc_id", "_th", F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].alias("n_hit")
    )
    sets = windows.groupBy("set_id").agg(F.first("items").alias("items"))
    members = hits.select("doc_id", "_th", "set_id").distinct().join(F.broadcast(sets) if known_small else sets, "set_id")
    ids = (
        members.select("doc_id", "_th", F.explode("items").alias("item"))
        .select("doc_id", "_th", F.col("item").cast("string").alias("item"))
        .groupBy("doc_id", "_th")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    found = covered.join(ids, same_row(covered, ids), "left").select(
        covered["doc_id"].alias("_id"), covered["_th"].alias("_rh"), "n_hit", "item_ids"
    )
    rows = row_key(docs).withColumn("n_words", F.size(item_words(F.col("text"))).cast("long"))
    joined = rows.join(found.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_th"] == F.col("_rh")), "left")
    ids_col = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        *[rows[c] for c in docs.columns], "n_words", n_hit.alias("n_hit"), F.size(ids_col).cast("long").alias("n_items"),
        ids_col.alias("item_ids"), (n_hit > 0).alias("contaminated"),
    )
