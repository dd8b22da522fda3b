"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as the
assistant and the others as named users, with masks over what the assistant says. Speakers
in ``context_roles`` (the system prompt) take part in no rotation and are rendered as context.

Turns are placed by one range-partitioned sort: a turn's rank is its place in its partition
plus the sizes of those before, less the place where its conversation starts. So a dialogue
of any length spans many tasks; it is rendered in parts of ``part_turns`` turns, and places
in the whole rendering come from the sums of the parts before.

Edge cases. Turns sort by turn (null last), then role and text; rows that repeat are turns of
their own. A null role is the speaker ``unknown``, a null text an empty turn. A null
conversation id is one conversation. ``<|`` inside a text or a name is written ``< |``, so
that no text can open or close a turn. A conversation with no participant gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverwell.llm.common import staged

END = "<|end|>\n"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, rank from 0, role, text): the place of each turn in its conversation, found without a task per conversation."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "turns")
    before = placed.groupBy("_part").count().withColumn(  # one row per partition
        "_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_at", at).drop("_part", "_before")
    first = placed.groupBy("conv_id").agg(F.min("_at").alias("_first")).withColumnRenamed("conv_id", "_conv")
    found = placed.join(staged(first, "starts"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return found.select("conv_id", (F.col("_at") - F.col("_first")).alias("rank"), "role", "text")


def perspectives(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = 64) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, n_chars, offset, masks, n_masked): a row for each participant and part.

    ``masks`` are the half-open ranges of code points in ``text`` that the speaker says, end
    marker included, as an array of (start, end); ``offset`` is where the part starts in the
    whole rendering. Joining the parts of a speaker in order gives the whole dialogue.
    """
    rows = staged(ranked(turns), "ranked")
    speakers = rows.where(~F.col("role").isin(*context_roles)).select("conv_id", F.col("role").alias("speaker")).distinct()
    speakers = staged(speakers.withColumnRenamed("conv_id", "_conv"), "speakers")
    own = F.col("role") == F.col("speaker")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(F.col("role").isin(*context_roles), F.concat(F.lit("<|"), _plain(F.col("role")), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), _plain(F.col("role")), F.lit("|>\n")))
    )
    turned = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "speaker", F.floor(F.col("rank") / part_turns).alias("part"), "rank", own.alias("own"), head.alias("head"),
        F.concat(_plain(F.col("text")), F.lit(END)).alias("body"),
    )
    # at most part_turns turns to a group, however long the dialogue
    parts = turned.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "own", "head", "body"))).alias("t"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
        F.when(
            t["own"],
            F.array_append(
                acc["out"],
                F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")),
            ),
        ).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    said = parts.select(
        "conv_id", "speaker", "part", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("t", start, step).alias("m"),
    )
    so_far = W.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    chars = F.col("m.at").cast("long")
    return said.select(
        "conv_id", "speaker", "part", "n_turns", "text", chars.alias("n_chars"),
        F.coalesce(F.sum(chars).over(so_far), F.lit(0)).alias("offset"), F.col("m.out").alias("masks"),
        F.aggregate("m.out", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"]).alias("n_masked"),
    )
