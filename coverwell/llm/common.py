"""Column helpers and staging shared by the text operators.

White space is the six ASCII characters of ``[\\x20\\x09-\\x0D]`` everywhere. Lower-casing
touches A-Z only, so text in other alphabets keeps its letters.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the session's, or one of our own where unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="coverwell-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once in a session, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_coverwell_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='coverwell-')}/coverwell.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._coverwell_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage, gives the optimiser true sizes, and outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/coverwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside further lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """The array of ``[^\\x20\\x09-\\x0D]+`` in order; empty for null or blank texts."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def unclashed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that an operator makes itself, in any case of letters."""
    taken = {n.lower() for n in names}
    return docs.select(*[c for c in docs.columns if c.lower() not in taken])


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``_th``, a hash of the text. ``(id, _th)`` tells rows apart even where ids repeat or are null."""
    return docs.withColumn("_th", F.xxhash64(F.col(text_col)))


def same_row(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> Column:
    return a[id_col].eqNullSafe(b[id_col]) & (a["_th"].eqNullSafe(b["_th"]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``gone`` (doc_id, _th)."""
    keys = gone.select(F.col("doc_id").alias("_gone_id"), F.col("_th").alias("_gone_th")).distinct().hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(keys["_gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["_gone_th"])
    return docs.join(keys, same, "left_anti")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on, how: str, known_small: bool) -> DataFrame:
    """Broadcasts ``right`` only where its size was checked; otherwise Spark shuffles both."""
    return left.join(F.broadcast(right) if known_small else right, on, how)
