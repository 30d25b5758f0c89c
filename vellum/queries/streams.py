"""Streaming operators, driven to completion over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import fixed_window_limits
from ..session import new_folder, table
from ..streaming.windows import dead_letters, drain_jobs, in_turn, limiter, run_closed, run_to_table, run_upserted, upsert_batches, usage
from ..streaming.windows import session_counts as sessions
from ..streaming.windows import tumbling_counts as tumbling
from .register import registry

QUERIES, ORACLES, query = registry()


#: Times at which rows of an event stream arrive, and seconds by which rows may arrive later than their time says.
TIMES, LATE = 5, 300


def event_stream(spark: SparkSession, sf_dir: str, late: int = LATE) -> tuple[DataFrame, list[Callable[[], None]]]:
    """The events table as a stream, and what makes its rows arrive, span by span; ``late`` seconds bound how late a row comes.

    The rows of a span arrive together, in as many files as they are written in, so that no later row is worked off before
    an earlier one but for ``late``.
    """
    events, path = table(spark, sf_dir, "events"), new_folder(spark, "event-files")
    seconds = F.unix_timestamp("ts")
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    span = max(1, -(-((last or 0) - (first or 0) + late + 1) // TIMES))
    came = seconds + (F.pmod(F.xxhash64("event_id"), F.lit(late)) if late else 0)
    arrivals = [lambda k=k: events.where(F.floor((came - F.lit(first)) / span) == k).write.mode("append").parquet(path) for k in range(TIMES)]
    events.limit(0).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path), arrivals


TUMBLING = "select strftime(ts, '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all"


@query(TUMBLING)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(TUMBLING)
def streamed_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tumbling_counts, over a stream of several files with late rows."""
    events, arrivals = event_stream(spark, sf_dir)
    out = run_upserted(tumbling(events, "ts", "event_type", "value"), new_folder(spark, "tumbling"), ["start", "event_type"], arrivals)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


SESSIONS = """
with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s
"""


@query(SESSIONS)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select event_type, count(*) as n, sum(floor(value * 100 + 0.5))::bigint as total from events group by event_type")
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over a stream of the table."""
    events, arrivals = event_stream(spark, sf_dir)
    totals = usage(events.withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long")), "event_type", "cents")
    return run_upserted(totals, new_folder(spark, "usage"), ["event_type"], arrivals)


@query("""
with a as (select event_id, user_id, ts, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 1 as in_minute from events),
b as (select *, count(*) filter (in_minute) over (partition by user_id, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) as day_n from a)
select user_id, count(*) as n_calls, count(*) filter (in_minute and day_n <= 5) as n_allowed from b group by user_id
""")
def limiter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter's closed form, summed by client."""
    out = fixed_window_limits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1, 5)
    return out.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if("allowed").alias("n_allowed"))


@query(SESSIONS)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As session_counts, over a stream of several files with late rows."""
    events, arrivals = event_stream(spark, sf_dir)
    out = run_closed(events, lambda e: sessions(e, "ts", "user_id", "6 hours"), "ts", "user_id", new_folder(spark, "sessions"), arrivals)
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""
with a as (select event_id, user_id, ts, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 1 as in_minute from events),
b as (select *, count(*) filter (in_minute) over (partition by user_id, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) as day_n from a)
select event_id, in_minute and day_n <= 5 as allowed from b
""")
def streamed_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful limiter over a stream of all events, in several files and in order."""
    events, arrivals = event_stream(spark, sf_dir, late=0)
    calls = events.select(F.col("user_id").cast("long").alias("client"), F.col("event_id").cast("long").alias("event_id"), "ts")
    return run_to_table(limiter(calls, 1, 5), new_folder(spark, "limits"), arrivals).select("event_id", "allowed")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by upserting the batches of a stream."""
    folder = new_folder(spark, "latest")
    events, arrivals = event_stream(spark, sf_dir)
    rows = events.withColumn("version", F.struct("ts", "event_id"))
    in_turn(rows.writeStream.foreachBatch(upsert_batches(f"{folder}/table", "user_id", "version")), folder, arrivals)
    return spark.read.parquet(f"{folder}/table").select("user_id", "event_id", "event_type")


def worked_off(payload: str) -> str:
    """The handler of streamed_jobs: an event's type in capitals; some types can't be handled."""
    kind, number = payload.split("/")
    if int(number) % 11 == 0:
        raise ValueError(f"{kind} can't be handled")
    return kind.upper()


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of their users, worked off from a stream of several files."""
    events, arrivals = event_stream(spark, sf_dir, late=0)
    jobs = events.select(F.col("user_id").cast("long").alias("queue"), F.col("event_id").cast("long").alias("job_id"), F.col("ts").alias("created_at"), F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("payload"))
    return drain_jobs(jobs, worked_off, new_folder(spark, "jobs"), arrivals)


@query("""
select user_id as queue, event_id as job_id, row_number() over (partition by user_id order by ts, event_id) as place, case when event_id % 11 = 0 then 'failed' else 'done' end as status,
    case when event_id % 11 <> 0 then upper(event_type) end as result from events
""")
def streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_outcomes(spark, sf_dir).select("queue", "job_id", "place", "status", "result")


@query("select user_id as queue, event_id as job_id, 'ValueError: ' || event_type || ' can''t be handled' as error from events where event_id % 11 = 0")
def streamed_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(job_outcomes(spark, sf_dir)).select("queue", "job_id", "error")
