"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import carry_forward, depth, fixed_window_limits, monotone, packed_chunks, sequence_gaps, within_budget
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""
with d as (select distinct l_orderkey, l_linenumber from lineitem), n as (select *, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) as after from d)
select l_orderkey, unnest(generate_series(l_linenumber + 1, after - 1)) as missing, l_linenumber as before, after from n where after > l_linenumber + 1
""")
def sequence_gaps_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
with t as (select conv_id, turn, role, sum((role = 'system')::int) over w as s0, sum((role = 'user')::int) over w as u0 from conversations window w as (partition by conv_id order by turn)),
a as (select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as "user" from t),
n as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as s from a),
b as (select *, last_value(case when role = 'assistant' then turn end ignore nulls) over (partition by conv_id, s order by turn) as reply from n)
select conv_id, turn, "user", case when "user" is not null then reply end as assistant, case when "user" is not null then 0 + (reply is not null)::int end as depth from b
""")
def carry_forward_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the user's turn that it belongs to and the last reply since then."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("at"))
    out = carry_forward(turns, "conv_id", "turn", "role", "at", ["user", "assistant"])
    return out.select("conv_id", "turn", "user", "assistant", depth(["user", "assistant"]).alias("depth"))


@query("""
with a as (select event_id, user_id, ts, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 1 as in_minute from events),
b as (select *, count(*) filter (in_minute) over (partition by user_id, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) as day_n from a),
c as (select *, in_minute and day_n <= 5 as allowed from b),
d as (select *, coalesce(count(*) filter (allowed) over (partition by user_id, date_trunc('minute', ts) order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as passed from c)
select event_id, allowed, case when not allowed then case when passed >= 1 then 'minute' else 'day' end end as scope,
    case when allowed then null when passed >= 1 then 60 - floor(epoch(ts))::bigint % 60 else 86400 - floor(epoch(ts))::bigint % 86400 end as retry_after from d
""")
def rate_limit_minute_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_window_limits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1, 5).select("event_id", "allowed", "scope", "retry_after")


@query("select event_id, user_id, max(value) over (partition by user_id order by event_id rows unbounded preceding) as value from events")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monotone(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")


@query("""
with b as (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations)
select conv_id, turn, length(substr(text, 1, (1500 - before)::bigint)) as n_chars, md5(substr(text, 1, (1500 - before)::bigint)) as digest from b where before < 1500
""")
def character_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return within_budget(turns, "conv_id", "turn", "text", 1500).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""
with recursive b as (select conv_id, turn, row_number() over (partition by conv_id order by turn, pos) as i, len, row_number() over (partition by conv_id order by turn desc, pos desc) as back from
    (select conv_id, turn, pos, length(trim(x)) as len from (select conv_id, turn, unnest(string_split(text, chr(10))) as x, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from conversations) where trim(x) <> '')),
f as (select conv_id, i, 0 as chunk, len + 2 as used, len as len, turn from b where i = 1
    union all select b.conv_id, b.i, case when f.used > 0 and f.used + b.len + 2 > 600 then f.chunk + 1 else f.chunk end, case when f.used > 0 and f.used + b.len + 2 > 600 then b.len + 2 else f.used + b.len + 2 end, b.len, b.turn from f join b on b.conv_id = f.conv_id and b.i = f.i + 1)
select conv_id, chunk::bigint as chunk, (sum(len) + 2 * (count(*) - 1))::bigint as n_chars, min(turn) as first_page, max(turn) as last_page from f group by conv_id, chunk
""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each conversation packed into chunks of 600 characters; a turn is a page."""
    chunks = packed_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600, "\n")
    return chunks.select("conv_id", "chunk", F.length("text").cast("long").alias("n_chars"), "first_page", "last_page")
