"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import small, staged


def _least(pairs: DataFrame, known_small: bool) -> DataFrame:
    """Each pair (u, v) with m, the least of u and all its v. Minima combine on the map side.

    A table of at most as many minima as checked links is broadcast; otherwise both sides
    are shuffled, the minima from a table, so that Spark can split the rows of a large star.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = F.broadcast(least) if known_small else staged(least, "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the least id reachable.

    Links form stars in a number of rounds that grows with the logarithm of the longest
    path; only whether they all do comes back to the driver. Loops and repeats are allowed.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "links")
    known_small = small(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, known_small).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        starred = _least(staged(large, "large"), known_small)
        small_ = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        edges = staged(small_.where("u != v").distinct(), "small")
        centres = edges.select(F.col("v").alias("u")).distinct()
        below = edges.join(F.broadcast(centres) if known_small else centres, "u", "left_semi")
        if below.isEmpty():  # no centre hangs on another
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(centres.select(F.col("u").alias("id"), F.col("u").alias("component")))
