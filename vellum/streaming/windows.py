"""Windows, sessions and stateful limits for streams; the same functions serve batch frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

#: How long a window waits for late rows.
LATENESS = "10 minutes"


def tumbling_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day") -> DataFrame:
    """Count and sum by key and window of fixed size, aligned to the epoch in the session's time zone."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, LATENESS) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "5 minutes") -> DataFrame:
    """Sessions of each key: rows no more than ``gap`` apart."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, LATENESS) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def usage(events: DataFrame, key: str, amount: str) -> DataFrame:
    """Running totals by key, for the update output mode; state is a row a key."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


LIMITS = "client long, event_id long, allowed boolean, scope string"
MINUTE, DAY = 60, 86_400


class FixedWindows(StatefulProcessor):
    """Counts of a client's passed calls by minute and by day: of each the windows that may still get calls, in a list.

    A client's lists are read and written once a trigger, whatever the number of calls. Windows whose end the watermark has passed
    go with the next trigger of their client, or by a timer at the end of its last window: no call of them can come any more.
    """

    def __init__(self, per_minute: int, per_day: int):
        self.limits = {"minute": (MINUTE, per_minute), "day": (DAY, per_day)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = {scope: handle.getListState(scope, "window long, n long") for scope in self.limits}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        client, known = key[0], self._read(timerValues)
        last = -1
        for ts, event_id in sorted((r.ts, r.event_id) for r in rows):
            second = int(ts.timestamp())
            full, places = None, []
            for scope, (size, most) in self.limits.items():
                n = known[scope].get(second // size, 0)
                places.append((known[scope], second // size, n))
                if n >= most and full is None:
                    full = scope
            if full is None:
                for counts, window, n in places:
                    counts[window] = n + 1
                last = max(last, (second // DAY + 1) * DAY)
            yield Row(client=client, event_id=event_id, allowed=full is None, scope=full)
        self._write(known)
        if last >= 0:
            self.handle.registerTimer(last * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._write(self._read(timerValues))
        yield from ()

    def _read(self, timerValues) -> dict[str, dict[int, int]]:
        """Of each scope the windows, with their counts, whose end the watermark hasn't passed."""
        watermark = timerValues.getCurrentWatermarkInMs()
        return {scope: {w: n for w, n in self.open[scope].get() if (w + 1) * size * 1000 > watermark} for scope, (size, _) in self.limits.items()}

    def _write(self, known: dict[str, dict[int, int]]) -> None:
        for scope, counts in known.items():
            if counts:
                self.open[scope].put(list(counts.items()))
            else:
                self.open[scope].clear()

    def close(self) -> None:
        pass


#: The state store that keeps timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limiter(calls: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """The fixed-window limiter over a stream (client, event_id, ts): client, event_id, allowed and the scope that denied.

    A call counts in the minute and the day of its own time, whenever it comes, as long as it is no later than the
    watermark. Within a trigger a client's calls are taken in order of time and id; only calls that pass are counted.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    return timed.groupBy("client").transformWithState(FixedWindows(per_minute, per_day), LIMITS, "Append", "EventTime")


#: Folders over which the keys of an upserted table are dealt.
UPSERT_BUCKETS = 64


def upsert_batches(target: str, key: str, version: str, buckets: int = UPSERT_BUCKETS):
    """A foreachBatch function: keeps the latest row of each key in a Parquet table, dealt by the hash of the key.

    A batch reads and replaces only the folders of its own keys, so the cost of a trigger follows the batch and not the
    table. A batch that comes again after a failure changes nothing.
    """
    from ..operators.dedupe import latest_wins

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # as many as there are folders, at most
        try:
            before = spark.read.schema(dealt.schema).parquet(target).where(F.col("bucket").isin(touched))
        except AnalysisException:  # nothing written yet
            before = dealt.limit(0)
        if touched:
            latest_wins(before.select(*dealt.columns), dealt, [key], version).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        dealt.unpersist()

    return apply


def nothing() -> None:
    """An arrival of no rows."""


#: Each writes rows to where a stream reads: they are worked off before the next are written.
Arrivals = Iterable[Callable[[], None]]


def in_turn(writer: DataStreamWriter, folder: str, arrivals: Arrivals) -> None:
    """Lets rows arrive and runs a stream over what is there, from its checkpoint below ``folder``, once for each arrival.

    What has arrived at once is worked off in one trigger, in however many files it lies.
    """
    for arrive in arrivals:
        arrive()
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, folder: str, arrivals: Arrivals = (nothing,)) -> DataFrame:
    """Runs a stream over what is there (or what arrives), in append mode, into a Parquet table below ``folder`` and reads it."""
    table = f"{folder}/table"
    in_turn(stream.writeStream.outputMode("append").format("parquet").option("path", table), folder, arrivals)
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def run_upserted(stream: DataFrame, folder: str, keys: list[str], arrivals: Arrivals = (nothing,)) -> DataFrame:
    """Runs an aggregate over what is there (or what arrives) in update mode: each trigger upserts the rows that it has changed, by ``keys``.

    State that the watermark has passed is dropped, and the table keeps what it last said.
    """
    spark, table = stream.sparkSession, f"{folder}/table"
    apply = upsert_batches(table, "upsert_key", "upsert_batch")

    def update(batch: DataFrame, number: int) -> None:
        apply(batch.withColumn("upsert_key", F.struct(*keys)).withColumn("upsert_batch", F.lit(number)), number)

    in_turn(stream.writeStream.outputMode("update").foreachBatch(update), folder, arrivals)
    try:
        return spark.read.parquet(table).select(*stream.columns)
    except AnalysisException:  # no row has come
        return spark.createDataFrame([], stream.schema)


def run_closed(events: DataFrame, operator, ts: str, key: str, folder: str, arrivals: Arrivals = (nothing,)) -> DataFrame:
    """Runs ``operator`` (a function of the stream) in append mode over what is there, and closes what is still open at the end.

    Append mode gives a window or session only when the watermark has passed it. After all rows a last one is sent, far
    ahead and without ``key``, that moves the watermark past all others; it never comes out itself.
    """
    spark, closing = events.sparkSession, f"{folder}/closing"
    spark.createDataFrame([], events.schema).write.parquet(closing)
    stream = operator(events.unionByName(spark.readStream.schema(events.schema).parquet(closing)))
    table = run_to_table(stream, folder, arrivals)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != ts]
    spark.range(1).select(F.lit(FAR_AHEAD).cast(events.schema[ts].dataType).alias(ts), *others).write.mode("append").parquet(closing)
    table = run_to_table(stream, folder)
    return table.where(F.col(key).isNotNull())


#: A time after all others.
FAR_AHEAD = "2262-01-01 00:00:00"

JOB = "queue long, job_id long, place long, status string, result string, error string"


def drain_jobs(jobs: DataFrame, handler, folder: str, arrivals: Arrivals = (nothing,)) -> DataFrame:
    """Works off a stream of jobs (queue, job_id, created_at, payload) and returns their outcomes (see JOB, and batch).

    Each trigger takes the jobs of a queue in order of creation and id, one after another in one task, different queues
    side by side. ``handler`` gets a payload and returns a text; what it raises is the job's error, and the next job goes
    on. ``place`` numbers the jobs of a queue over all triggers. Outcomes are written to the folder of their batch, which
    a replay replaces, and a job that an earlier batch has worked off isn't taken again, so each counts once.
    """
    spark, table = jobs.sparkSession, f"{folder}/outcomes"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for queue, job_id, place, payload in zip(rows["queue"], rows["job_id"], rows["place"], rows["payload"], strict=True):
                try:
                    out.append((queue, job_id, place, "done", str(handler(payload)), None))
                except Exception as e:  # noqa: BLE001 - whatever a job raises is its outcome
                    out.append((queue, job_id, place, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in JOB.split(", ")])

    def drain(batch: DataFrame, number: int) -> None:
        try:
            before = spark.read.schema(f"{JOB}, batch long").parquet(table).where(F.col("batch") != number)
        except AnalysisException:  # the first batch
            before = spark.createDataFrame([], f"{JOB}, batch long")
        worked = before.groupBy(F.col("queue").alias("w_queue")).agg(F.max("place").alias("last"))
        fresh = batch.dropDuplicates(["job_id"]).join(before.select("job_id"), "job_id", "left_anti")
        order = Window.partitionBy("queue").orderBy("created_at", "job_id")
        placed = fresh.withColumn("place", F.row_number().over(order)).join(worked, F.col("queue") == F.col("w_queue"), "left").withColumn("place", F.col("place") + F.coalesce("last", F.lit(0)))
        claimed = placed.select("queue", "job_id", "place", "payload").repartition("queue").sortWithinPartitions("queue", "place")
        claimed.mapInPandas(work, JOB).write.mode("overwrite").parquet(f"{table}/batch={number}")

    in_turn(jobs.writeStream.foreachBatch(drain), folder, arrivals)
    try:
        return spark.read.schema(f"{JOB}, batch long").parquet(table)
    except AnalysisException:  # no job has come
        return spark.createDataFrame([], f"{JOB}, batch long")


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """The jobs that failed, with what they raised."""
    return outcomes.where("status = 'failed'").select("queue", "job_id", "place", "error")
