"""Mixing sources to target weights by hash thresholds.

Every document gets a 64-bit hash. Tokens are summed by source and hash bucket; running
sums along a source's buckets place its budget in one boundary bucket, and only that bucket
is split again, by the next bits, until a single hash is left. What a source may take is then
one threshold, so the mix is a filter: nothing is sorted, and a larger budget keeps every
document that a smaller one took.

Edge cases. Null texts have size 0. A null source is a source of its own, after all others.
Sources without words have target 0. Null ids are allowed; rows that agree in id and text
share a hash and are taken together. Empty tables give empty results. Extra
columns stay with texts; those named as a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.llm.common import join_small, n_words, row_key, small, staged, unclashed

WEIGHTS = (5, 2, 1)
LEVELS = (12, 12, 12, 14, 14)  # bits of the hash that each pass reads, 64 in all


def source_weights(totals: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds weight: the given ones in turn over the sources by code point, null last.

    The rank of a source is its place in its range partition plus the sizes of those before,
    so no task sees all sources.
    """
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last()
    )
    placed = staged(
        ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sources"
    )
    sizes = placed.groupBy("_part").count()  # one row per partition
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    return (
        placed.join(F.broadcast(before.select("_part", "_before")), "_part")
        .withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long"))
        .drop("_at", "_part", "_before")
    )


def fill(sources: DataFrame, percent: int = 150, most: int = 2) -> DataFrame:
    """Adds target: shares by weight of ``percent`` % of all words, none above ``most`` times its source.

    What a capped source cannot take goes to the others by weight, until none is above.
    Each round brings back three sums, however many sources there are.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, parts = percent * (total or 0), weight or 0  # in hundredths, so that it stays a whole number
    rest = left
    over = F.lit(False)
    while parts:
        over = F.col("weight").cast("decimal(38,0)") * rest > F.lit(100 * most).cast("decimal(20,0)") * F.col("source_size") * parts
        capped, freed = sources.where(over).agg(F.sum("source_size"), F.sum("weight")).first()
        now_rest, now_parts = left - 100 * most * (capped or 0), (weight or 0) - (freed or 0)
        if (now_rest, now_parts) == (rest, parts):
            break
        rest, parts = now_rest, now_parts
    share = F.col("weight") * F.lit(rest).cast("double") / F.lit(100.0 * parts if parts else 1.0)
    return sources.withColumn(
        "target", F.when(over | F.lit(not parts), (most * F.col("source_size")).cast("double")).otherwise(share)
    )


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: copies that every document has, and the hash below which one has one more.

    ``limit`` is exclusive. Of the two thresholds around the boundary hash the nearer to the
    budget is taken, the lower one on a tie.
    """
    plan = sources.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    open_ = plan.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    known_small = small(plan)
    rows, used = sized.where(F.col("size") > 0).select("skey", "size", "h"), 0
    for k, bits in enumerate(LEVELS):
        used += bits
        shift = 64 - used
        joined = join_small(rows, open_.select("skey", "prefix"), "skey", "inner", known_small)
        if k:
            joined = joined.where(F.shiftrightunsigned("h", shift + bits) == F.col("prefix"))
        rows = joined.select("skey", "size", "h")
        bucket = F.shiftrightunsigned("h", shift) if shift else F.col("h")
        sums = rows.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        along = W.partitionBy("skey").orderBy(F.expr("shiftrightunsigned(bucket, 1)"), F.expr("bucket & 1"))
        run = sums.join(open_, "skey").withColumn("upto", F.col("below") + F.sum("n").over(along))
        edge = run.where(F.col("upto") > F.col("budget")).groupBy("skey").agg(
            F.min_by(F.struct("bucket", "n", "upto", "budget"), "upto").alias("e")
        )
        open_ = staged(
            edge.select(
                "skey", F.col("e.budget").alias("budget"), F.col("e.bucket").alias("prefix"),
                (F.col("e.upto") - F.col("e.n")).alias("below"), F.col("e.upto").alias("upto"),
            ),
            "boundary",
        )
    near = open_.select(
        "skey", F.col("prefix").alias("edge"), (F.col("upto") - F.col("budget") < F.col("budget") - F.col("below")).alias("with_edge")
    )
    return plan.join(near, "skey", "left")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with skey (its source, null apart from the empty one), size in words, and h, the hash."""
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    return row_key(docs).withColumns(
        {"skey": key, "size": n_words(F.col("text")), "h": F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))}
    )


def _with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    flip = F.lit(-(1 << 63))  # unsigned order
    h, edge = F.col("h").bitwiseXOR(flip), F.col("edge").bitwiseXOR(flip)
    more = F.when(F.col("edge").isNull(), F.lit(False)).otherwise((h < edge) | ((h == edge) & F.col("with_edge")))
    joined = join_small(sized, plan.withColumnRenamed("copies", "_full"), "skey", "left", small(plan))
    copies = F.when(F.col("size") > 0, F.col("_full") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2, seed: int = 11, texts: bool = False) -> DataFrame:
    """How often each document is in the mix: copies, and taken, the words that makes.

    Returns doc_id, source, size, source_size, target, copies and taken for every row; with
    ``texts``, all columns of ``docs`` and these, for the rows that the mix takes.
    """
    found = ["size", "source_size", "target", "copies", "taken"]
    docs = unclashed(docs, *found, "skey", "h", "edge", "with_edge", "_full", "_th")
    sized = staged(_sized(docs, seed).select("doc_id", "source", "skey", "size", "h"), "sized")
    totals = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    sources = staged(fill(source_weights(totals, weights), percent, most), "targets")
    plan = staged(thresholds(sized, sources).select("skey", "source_size", "target", "copies", "edge", "with_edge"), "plan")
    if texts:  # the thresholds alone decide, so the texts are filtered where they are read
        return _with_copies(_sized(docs, seed), plan).where("copies > 0").select(*docs.columns, *found)
    return _with_copies(sized, plan).select("doc_id", "source", *found)
