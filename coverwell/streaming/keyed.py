"""A table by key that takes batches exactly once and rewrites only the buckets that a batch touches.

Rows lie in buckets by a hash of their key; a bucket's rows are a folder of the batch that wrote
them, ``data/v=<batch>/bucket=<bucket>``. A pointer, one small table a batch, says for each bucket
which batch wrote it last, and is written after the data: a reader takes the newest pointer, so
it sees a batch wholly or not at all. A batch that is repeated starts from the newest pointer
before it and writes the same folders again, so repeats change nothing. What a batch writes
grows with the buckets it touches, not with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``schema`` holds the ``key`` columns; choose ``buckets`` so that one bucket's rows fit a task."""

    def __init__(self, spark: SparkSession, where: str, key: list[str], schema, buckets: int = 64):
        self.spark, self.where, self.key, self.buckets = spark, where, key, buckets
        self.empty = spark.createDataFrame([], schema)

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, v long, at long").parquet(f"{self.where}/pointer")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The batch that wrote each bucket last, as of the newest pointer (before a batch): a row for each bucket."""
        all_ = self._pointers()
        if all_ is None:
            return {}
        seen = all_ if before is None else all_.where(F.col("at") < before)
        last = seen.agg(F.max("at")).first()[0]
        return {} if last is None else {r["bucket"]: r["v"] for r in all_.where(F.col("at") == last).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.empty
        paths = [f"{self.where}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.empty.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.versions())

    def merge(self, batch: DataFrame, batch_id: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Puts ``combine(old rows of the touched buckets, batch)`` in their place; both give the columns of the table."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        old = self.versions(batch_id)
        new = combine(self._read({b: v for b, v in old.items() if b in touched}), batch).select(*self.empty.columns, bucket.alias("bucket"))
        new.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.where}/data/v={batch_id}")
        rows = sorted((old | dict.fromkeys(touched, batch_id)).items())
        pointer = self.spark.createDataFrame(rows, "bucket int, v long").coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{self.where}/pointer/at={batch_id}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Rows of ``batch``, one for each key, take the place of those of the same key."""
        same = lambda old, new: [old[k].eqNullSafe(new[k]) for k in self.key]
        self.merge(batch, batch_id, lambda old, new: new.select(*old.columns).unionByName(old.join(new, same(old, new), "left_anti")))
