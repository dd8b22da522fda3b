"""Line dedup: range-partitioned line hashes, sorted by document and position within.

``line_bitmaps`` hashes every line key, range-partitions the hashes with a salt by document
so that a line found everywhere spans many partitions, sorts each key's rows by document and
position, and streams over them to count documents and find the first occurrence. What it
returns is not text but one compressed bitmap per document: 64 lines to a long, and only the
longs in which a line goes. ``apply_bitmaps`` turns them into kept texts.

Edge cases. A null or empty text is one empty line, which has no key and stays. Lines that
are blank after stripping have an empty key and stay unless ``min_key`` is 0. Rows with the
same id and the same text are one document; the same id with other text is another one.
Null ids are allowed. Empty tables give empty results. Extra columns stay; those named as a
result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.llm.common import WHITE, ascii_lower, join_small, row_key, small, staged, unclashed

SALTS = 1024


def line_keys(docs: DataFrame, min_key: int = 1) -> DataFrame:
    """(doc_id, _th, pos, h1, h2): 96 bits of hash for the key of every line that has one."""
    rows = row_key(docs).select("doc_id", "_th", F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", "_th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "_th", "pos", F.btrim("line", F.lit(WHITE)).alias("key"))
    keyed = keyed.where(F.length("key") >= min_key)
    return keyed.select("doc_id", "_th", "pos", ascii_lower(F.col("key")).alias("key")).select(
        "doc_id", "_th", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )


def key_counts(keys: DataFrame, salts: int = SALTS) -> DataFrame:
    """(h1, h2, n_docs, first): documents that hold each key and its first place, in a stream over sorted rows."""
    salted = keys.withColumn("salt", F.pmod(F.hash("doc_id", "_th"), F.lit(salts)))
    by = ["h1", "h2", "salt"]
    before = W.partitionBy(*by).orderBy("doc_id", "_th", "pos")
    place = F.struct("doc_id", "_th")
    ranged = salted.repartitionByRange(*by)
    opened = ranged.withColumn("opens", (~place.eqNullSafe(F.lag(place).over(before))).cast("long"))
    return opened.where("opens = 1").groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "_th", "pos")).alias("first")
    )


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_key: int = 1) -> DataFrame:
    """(doc_id, _th, drops): for documents that lose lines, longs of 64 lines each as (word, bits), a set bit for a line that goes.

    A key found in ``min_docs`` documents or more loses its lines; with ``keep_first`` the
    first one in the order of document and position stays.
    """
    keys = staged(line_keys(docs, min_key), "lines")
    # from a table, so that Spark may split the rows of a line found everywhere
    common = staged(key_counts(keys).where(F.col("n_docs") >= min_docs), "common")
    gone = join_small(keys, common, ["h1", "h2"], "inner", small(common))
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "_th", "pos").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, pos & 63)")
    packed = (
        gone.select("doc_id", "_th", F.shiftright("pos", 6).alias("word"), bit.alias("bit"))
        .groupBy("doc_id", "_th", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    return packed.groupBy("doc_id", "_th").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and kept, the text that stays."""
    docs = unclashed(docs, "n_lines", "n_dropped", "kept", "drops", "_dense", "_th", "_id", "_bh")
    rows = row_key(docs)
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_bh"), "drops").hint("shuffle_hash")
    joined = rows.join(maps, rows["doc_id"].eqNullSafe(maps["_id"]) & (rows["_th"] == maps["_bh"]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    dense = F.transform(
        F.sequence(F.lit(0), F.expr("array_max(map_keys(drops))")),
        lambda w: F.coalesce(F.try_element_at(F.col("drops"), w), F.lit(0).cast("long")),
    )
    joined = joined.withColumn("_dense", F.when(F.col("drops").isNotNull(), dense))
    stays = F.expr(
        "transform(array(_dense), d -> array_join(filter(split(coalesce(text, ''), '\\n', -1), "
        "(l, i) -> (shiftright(coalesce(get(d, shiftright(i, 6)), 0L), i & 63) & 1L) = 0L), '\\n'))[0]"
    )
    counted = F.expr("cast(aggregate(_dense, 0, (n, b) -> n + bit_count(b)) as long)")
    return joined.select(
        *[rows[c] for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(counted, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_dense").isNull(), text).otherwise(stays).alias("kept"),
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_key: int = 1) -> DataFrame:
    """All rows of ``docs`` (doc_id, text and any others) with n_lines, n_dropped and kept."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, keep_first, min_key))
