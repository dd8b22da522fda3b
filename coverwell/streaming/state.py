"""Streams with state by key: failure streaks, throttled alerts and markers, late and undated rows.

State is bounded: a streak remembers single failures only as long as a success may still come
in between, a throttle forgets a title when its gap has passed on the event clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from coverwell.streaming.keyed import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAKS = "job string, streak long, last_ok timestamp_ntz, last_error string"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state of any shape needs this state store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with(schema: StructType, name: str, kind: str) -> StructType:
    return StructType([*schema.fields, StructField(name, DataType.fromDDL(kind))])


def replay(rows: DataFrame, slice_: str, where: str, run: Callable[[DataFrame], None]) -> None:
    """Lets the rows of each value 0, 1, ... of ``slice_`` arrive together, and runs ``run`` on the stream after each arrival.

    Every run starts from the checkpoint that the one before it left, as after a restart.
    """
    spark = rows.sparkSession
    held, landing = f"{where}/held-{uuid.uuid4().hex}", f"{where}/landing"
    rows.withColumn("_slice", F.col(slice_)).write.partitionBy("_slice").parquet(held)
    kept = spark.read.schema(_with(rows.schema, "_slice", "int")).parquet(held)
    for (k,) in sorted(kept.select("_slice").distinct().collect()):
        kept.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(landing)
        run(spark.readStream.schema(rows.schema).parquet(landing))


def _through(stream: DataFrame, where: str, name: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes what has arrived as one batch after the other, and ends."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint-{name}")
    writer.trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def _run_summer():
    """A function of Arrow batches, made here so that it travels by value: workers need no package of ours."""

    def summed(batches):
        """Of each job in a partition: its last success, the failures after it, and the last error. Failures before a success count nowhere."""
        found: dict = {}
        for batch in batches:
            for job, at, ok, error in zip(*[batch.column(c).to_pylist() for c in ("job", "_us", "ok", "error")]):
                if at is None:
                    continue
                one = found.setdefault(job, [None, [], None, None, at])
                one[4] = max(one[4], at)
                if ok:
                    one[0] = at if one[0] is None else max(one[0], at)
                else:
                    one[1].append(at)
                    if one[2] is None or (at, error or "") > (one[2], one[3] or ""):
                        one[2], one[3] = at, error
        rows = [(j, ok, [f for f in fails if ok is None or f > ok], e_at, e, at) for j, (ok, fails, e_at, e, at) in found.items()]
        schema = pa.schema([("job", pa.string()), ("ok", pa.int64()), ("fails", pa.list_(pa.int64())), ("error_us", pa.int64()), ("error", pa.string()), ("us", pa.int64())])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return summed


def _streak_processor():
    from pyspark.sql.streaming import StatefulProcessor

    class Streak(StatefulProcessor):
        """Per job: last success, failures since it. Those behind the watermark are a number, as no success can come before them any more."""

        def init(self, handle) -> None:
            self.state = handle.getValueState("streak", "ok long, settled long, fails array<long>, error_us long, error string")

        def handleInputRows(self, key, rows, timerValues):
            ok, settled, fails, error_us, error = self.state.get() if self.state.exists() else (None, 0, [], None, None)
            fails = list(fails)
            for r in rows:
                if r["ok"] is not None and (ok is None or r["ok"] > ok):
                    ok, settled = r["ok"], 0
                fails += r["fails"]
                if r["error_us"] is not None and (error_us is None or (r["error_us"], r["error"] or "") > (error_us, error or "")):
                    error_us, error = r["error_us"], r["error"]
            fails = [f for f in fails if ok is None or f > ok]
            if ok is not None and error_us is not None and error_us <= ok:
                error_us, error = None, None
            behind = timerValues.getCurrentWatermarkInMs() * 1000
            left = [f for f in fails if f > behind]
            settled += len(fails) - len(left)
            self.state.update((ok, settled, left, error_us, error))
            yield Row(job=key[0], streak=settled + len(left), ok=ok, error=error)

        def close(self) -> None:
            pass

    return Streak()


def failure_streaks(stream: DataFrame, where: str, delay: str = "48 hours", buckets: int = 16) -> KeyedTable:
    """Failures of each job since its last success, kept current batch by batch; gives the table (job, streak, last_ok, last_error).

    ``stream`` has (job, started_at, ok, error). A failure never touches ``last_ok``, a success clears the error. Order
    within ``delay`` does not matter. Runs without a time are passed over; a job may be null. Runs are summed by job in each
    partition before they are shuffled, so a job with most of the runs sends a row a partition.
    """
    table = KeyedTable(stream.sparkSession, f"{where}/streaks", ["job"], STREAKS, buckets)
    runs = stream.select("job", F.unix_micros(F.col("started_at").cast("timestamp")).alias("_us"), "ok", F.left("error", F.lit(300)).alias("error"))
    summed = runs.mapInArrow(_run_summer(), "job string, ok long, fails array<long>, error_us long, error string, us long")
    summed = summed.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)

    def keep(batch: DataFrame, batch_id: int) -> None:
        last = F.timestamp_micros("ok").cast("timestamp_ntz")
        rows = batch.select("job", "streak", last.alias("last_ok"), F.col("error").alias("last_error")).persist()  # the state moves once
        table.upsert(rows, batch_id)
        rows.unpersist()

    with rocksdb(stream.sparkSession):
        told = summed.groupBy("job").transformWithState(_streak_processor(), "job string, streak long, ok long, error string", "update", "eventTime")
        _through(told, where, "streaks", keep, "update")
    return table


def _throttle_processor(gap_us: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Throttle(StatefulProcessor):
        """Per bucket of titles: when each last went out, until the event clock has passed the gap after that."""

        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "titles array<string>, us array<long>")

        def handleInputRows(self, key, rows, timerValues):
            held = self.last.get() if self.last.exists() else ([], [])
            behind = timerValues.getCurrentWatermarkInMs() * 1000
            before = dict(zip(*held))
            last = {title: us for title, us in before.items() if us + gap_us >= behind}
            alerts = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
            titles = [t if isinstance(t, str) else None for t in alerts["title"]]
            goes = []
            for title, us in zip(titles, alerts["us"].tolist()):
                goes.append(title not in last or us - last[title] >= gap_us)
                if goes[-1]:
                    last[title] = us
            yield pd.DataFrame({"id": alerts["id"], "title": pd.Series(titles, alerts.index, object), "us": alerts["us"]})[goes]
            if last != before:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                if last:
                    self.last.update((list(last), list(last.values())))
                    self.handle.registerTimer((max(last.values()) + gap_us) // 1000 + 1)
                else:
                    self.last.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()  # it is set for the last of the bucket's titles
            yield from ()

        def close(self) -> None:
            pass

    return Throttle()


def throttled(stream: DataFrame, where: str, hours: int, delay: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Alerts (id, title, at) that go out: none of the same title went out within ``hours`` before. Null titles are one title.

    Alerts of a batch are taken by time and id, batches as they arrive; those more than ``delay`` behind are late and held
    back. Alerts without a time always go out, by a branch of their own. The same guards what may happen once in a while, such as a
    daily send: its marker is the title. What went out of a batch is a folder of its own, so a repeated batch sends nothing twice.
    The state is kept by bucket of titles, as reading and writing it costs more than the alerts do; ``buckets`` must not change
    between restarts.
    """
    rows = stream.withColumns({"us": F.unix_micros(F.col("at").cast("timestamp")), "bucket": F.pmod(F.xxhash64("title"), F.lit(buckets))})
    timed = rows.where("at IS NOT NULL").select("id", "title", "us", "bucket", F.timestamp_micros("us").alias("_at")).withWatermark("_at", delay)
    with rocksdb(stream.sparkSession):
        kinds = dict(stream.dtypes)
        sent = timed.groupBy("bucket").transformWithStateInPandas(_throttle_processor(hours * 3_600_000_000), f"id {kinds['id']}, title string, us long", "append", "eventTime")
        sent = sent.select("id", "title", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"))
        every = sent.unionByName(stream.where("at IS NULL").select("id", "title", F.col("at").cast("timestamp_ntz").alias("at")))
        _through(every, where, "alerts", lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/alerts/batch={n}"))
    return stream.sparkSession.read.schema(every.schema).parquet(f"{where}/alerts").select("id", "title", "at")


def split_late(stream: DataFrame, where: str, at: str, hours: int) -> DataFrame:
    """All rows with ``branch``: ``kept``, ``late`` (dated ``hours`` or more before the newest row of earlier batches) or ``undated``.

    Nothing is lost: each batch is written once, parted by branch, with the newest time so far beside it; a repeated batch
    reads the mark of the batches before it and writes the same.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        mark = None
        if batch_id:
            marks = spark.read.schema("mark timestamp_ntz, batch long").parquet(f"{where}/marks")
            mark = marks.where(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        time = F.col(at).cast("timestamp_ntz")
        late = F.lit(False) if mark is None else time <= F.lit(mark).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
        branch = F.when(time.isNull(), "undated").when(late, "late").otherwise("kept")
        batch.withColumn("branch", branch).write.mode("overwrite").partitionBy("branch").parquet(f"{where}/rows/batch={batch_id}")
        seen = spark.read.schema(schema).parquet(f"{where}/rows/batch={batch_id}").agg(F.max(time).alias("mark"))
        seen.select(F.greatest("mark", F.lit(mark).cast("timestamp_ntz")).alias("mark")).write.mode("overwrite").parquet(f"{where}/marks/batch={batch_id}")

    _through(stream, where, "late", keep)
    return spark.read.schema(_with(schema, "branch", "string")).parquet(f"{where}/rows").select(*schema.names, "branch")
