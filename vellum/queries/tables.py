"""Lookups, joins by key and time, duplicates, price statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import confirmed, delete_keys, keep_first, latest_wins, orphans
from ..functions.numbers import cents, two_letters
from ..functions.text import backoff_ms, control_url, transient_error
from ..operators.pricing import price_report, price_statistics, price_tails, relevance
from ..operators.temporal import append_versions, as_of_join, closed_intervals, equals_where_given, first_and_last, last_in_order, lookup, number_range, provisions_in_force, valid_at, with_existence
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()

DAY = "%Y-%m-%d"


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price samples: price in whole cents for one unit."""
    price = F.floor(100 * F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate", price.alias("price"), (F.col("l_quantity") >= 5).alias("relevant"))


SAMPLES = "s as (select l_partkey, l_returnflag, l_shipdate, floor(100 * l_extendedprice / l_quantity + 0.5)::bigint as price, l_quantity >= 5 as relevant from lineitem)"


@query(f"""
with {SAMPLES}, u as (select l_partkey, l_returnflag, count(*) filter (relevant) as n, count(*) filter (not relevant) as bad,
    quantile_cont(price, 0.5) filter (relevant) as p50, quantile_cont(price, 0.25) filter (relevant) as p25, quantile_cont(price, 0.75) filter (relevant) as p75,
    avg(price) filter (relevant) as mean, min(price) filter (relevant) as lo, max(price) filter (relevant) as hi, min(l_shipdate) filter (relevant) as d0, max(l_shipdate) filter (relevant) as d1
    from s group by all),
r as (select *, row_number() over (partition by l_partkey order by n desc, l_returnflag nulls last) as place, sum(n) over (partition by l_partkey) as all_n, sum(bad) over (partition by l_partkey) as all_bad from u)
select l_partkey, case when n > 0 then l_returnflag end as unit, n, floor(round(p50, 4) + 0.5)::bigint as median, floor(round(mean, 4) + 0.5)::bigint as mean, floor(round(p25, 4) + 0.5)::bigint as p25, floor(round(p75, 4) + 0.5)::bigint as p75,
    lo as min, hi as max, strftime(d0, '{DAY}') as first_date, strftime(d1, '{DAY}') as last_date, all_bad::bigint as discarded_relevance, (all_n - n)::bigint as discarded_unit
from r where place = 1
""")
def price_stats_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = price_statistics(samples(spark, sf_dir), "l_partkey", "l_returnflag", "price", "l_shipdate", "relevant")
    return out.withColumns({c: day(c) for c in ("first_date", "last_date")})


@query(f"""
with {SAMPLES}, j as (select s.*, p_brand from s join part on l_partkey = p_partkey),
o as (select l_partkey, p_brand, count(*) as n, quantile_cont(price, [0.05, 0.95]) as q from j group by all),
g as (select p_brand, count(*) as gn, quantile_cont(price, [0.05, 0.95]) as gq from j group by all)
select l_partkey, n, case when n >= 25 then 'item' when gn >= 25 then 'group' else 'all' end as level,
    floor(round((case when n >= 25 then q else gq end)[1], 4) + 0.5)::bigint as p5, floor(round((case when n >= 25 then q else gq end)[2], 4) + 0.5)::bigint as p95
from o join g using (p_brand)
""")
def price_tails_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return price_tails(samples(spark, sf_dir).join(part, "l_partkey"), "l_partkey", "p_brand", "price", 25)


@query("""
with t as (select p_partkey, (select count(distinct x) from unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) u(x) where x in ('part', 'small', 'large')) as hits from part)
select p_partkey, floor(hits / 3.0 * 100 + 0.5) / 100 as relevance_score, hits / 3.0 >= 0.5 as relevant, hits || ' of 3 terms' as reason from t
""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    out = relevance(part, "Large PART de small, tipo", F.concat_ws(" ", "p_name", "p_type"))
    return out.select("p_partkey", "relevance_score", "relevant", "reason")


@query("select vec_id + 600 as doc_id from embeddings where vec_id + 600 not in (select doc_id from documents)")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 600).alias("doc_id"))
    return orphans(ids, table(spark, sf_dir, "documents"), "doc_id", r"^\d+$")


@query("select d.doc_id, e.label, d.lang, d.source from embeddings e join documents d on d.doc_id = e.vec_id + 600")
def confirmed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 600).alias("doc_id"), "label", F.lit("stale").alias("lang"))
    return confirmed(hits, table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"])


@query("select vec_id, label from embeddings where vec_id not in (select doc_id from labels where toxic = 1)")
def deleted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return delete_keys(table(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, "vec_id")


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer, each valid until the customer's next order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return closed_intervals(orders, "o_custkey", "o_orderdate", "o_orderkey")


VERSIONS = "v as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_until from orders)"


@query(f"with {VERSIONS} select o_custkey, arg_max(o_orderkey, (o_orderdate, valid_until, o_orderkey)) as o_orderkey from v where o_orderdate <= timestamp '1996-06-01' and (valid_until is null or valid_until > timestamp '1996-06-01') group by o_custkey")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1996-06-01").cast("timestamp")
    return valid_at(order_versions(spark, sf_dir), "o_custkey", "o_orderdate", "valid_until", at, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"with {VERSIONS} select o_custkey, o_orderkey, o_totalprice from v where valid_until is null")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_versions(spark, sf_dir).where("valid_until is null").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""
with {VERSIONS}, f as (select event_id, user_id % 1500 as o_custkey, ts - interval 28 year as t from events)
select f.event_id, f.o_custkey, (select arg_max(v.o_orderkey, (v.o_orderdate, v.valid_until, v.o_orderkey)) from v where v.o_custkey = f.o_custkey and v.o_orderdate <= f.t and (v.valid_until is null or v.valid_until > f.t)) as o_orderkey from f
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event, taken 28 years back, with the order that was its customer's latest then."""
    facts = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 1500).alias("o_custkey"), (F.col("ts") - F.expr("interval 28 years")).alias("t"))
    return as_of_join(facts, order_versions(spark, sf_dir), "o_custkey", "t", "o_orderdate", "valid_until", ["o_orderkey"]).drop("t")


@query("""
with v as (select l_suppkey, l_shipdate as sent, l_shipdate + to_days(l_quantity::integer) as came, l_orderkey * 10 + l_linenumber as line from lineitem)
select f.l_orderkey, f.l_linenumber, (select arg_max(v.line, (v.sent, v.line)) from v where v.l_suppkey = f.l_suppkey and v.sent <= f.l_shipdate + to_days(f.l_linenumber::integer * 9) and v.came > f.l_shipdate + to_days(f.l_linenumber::integer * 9)) as line from lineitem f
""")
def overlapping_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line, some days after it was sent, with that of its supplier which was the last sent and still on its way then.

    A line is on its way for as many days as its quantity, so many of a supplier's overlap, and short ones lie within long ones.
    """
    lines = table(spark, sf_dir, "lineitem")
    days = lambda n: F.make_dt_interval(n.cast("int"))
    ways = lines.select("l_suppkey", F.col("l_shipdate").alias("sent"), (F.col("l_shipdate") + days(F.col("l_quantity"))).alias("came"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    facts = lines.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_shipdate") + days(F.col("l_linenumber") * 9)).alias("t"))
    return as_of_join(facts, ways, "l_suppkey", "t", "sent", "came", ["line"]).select("l_orderkey", "l_linenumber", "line")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last from orders group by o_custkey")
def first_and_last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_and_last(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"""
with {VERSIONS}, n as (select o_custkey, o_orderkey + 1000000 as o_orderkey, timestamp '2000-01-01' as o_orderdate, o_totalprice * 2 as o_totalprice, null::timestamp as valid_until from orders where o_orderkey % 10 = 0)
select v.o_custkey, v.o_orderkey, strftime(coalesce(valid_until, case when v.o_custkey in (select o_custkey from n) then timestamp '2000-01-01' end), '{DAY}') as valid_until from v
union all select o_custkey, o_orderkey, null from n
""")
def appended_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = order_versions(spark, sf_dir)
    new = versions.where("o_orderkey % 10 = 0").select("o_custkey", (F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit("2000-01-01").cast("timestamp").alias("o_orderdate"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(None).cast("timestamp").alias("valid_until"))
    return append_versions(versions, new, "o_custkey", "o_orderdate", "valid_until").select("o_custkey", "o_orderkey", day("valid_until").alias("valid_until"))


@query("""
with d as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem where l_linenumber between 2 and 6),
c as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber) as place, count(*) over (partition by l_orderkey) as n from d where r = 1)
select l_orderkey, l_linenumber, l_partkey, n > 3 as truncated from c where place <= 3
""")
def article_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 6 of every order, three at most."""
    tie = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return number_range(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 2, 6, tie, 3).select("l_orderkey", "l_linenumber", "l_partkey", "truncated")


@query("select doc_id, lang, quality from documents left join labels using (doc_id) where quality is null and lang = 'de'")
def absent_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level asked for as absent matches only where it is absent."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
    return lookup(docs, lang="de", quality=None)


@query("select doc_id, source from documents where lang = 'fr'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(equals_where_given(lang="fr", source=None)).select("doc_id", "source")


@query("select doc_id, lang, n_chars from (select *, row_number() over (partition by md5(text) order by doc_id) as r from documents) where r = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))
    return keep_first(docs, ["digest"], ["doc_id"]).drop("digest")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("version"), "event_type", "value")
    old, new = events.where("version.event_id % 2 = 0"), events.where("version.event_id % 2 = 1")
    return latest_wins(old, new, ["user_id"], "version").select("user_id", "version.event_id", "event_type", "value")


@query("""
select o_orderkey, o_orderstatus, count(l_orderkey) as n_lines, coalesce(sum(case when l_returnflag = 'R' then 1 else 0 end), 0)::bigint as n_returned
from orders left join lineitem on o_orderkey = l_orderkey where o_orderkey > 0 group by o_orderkey, o_orderstatus
""")
def parent_child_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number of their lines; orders without lines count none."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return joined.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("returned", F.lit(0)).alias("n_returned"))


@query(f"""
with {SAMPLES}, i as (select p_partkey from part where p_name like 'small%' order by p_partkey limit 1),
u as (select l_returnflag, count(*) filter (relevant) as n, quantile_cont(price, 0.5) filter (relevant) as p50, min(l_shipdate) filter (relevant) as d0 from s where l_partkey = (select p_partkey from i) and l_shipdate >= timestamp '1994-01-01' and l_shipdate <= timestamp '1999-12-31' group by l_returnflag)
select (select p_partkey from i) as l_partkey, l_returnflag as unit, n, floor(round(p50, 4) + 0.5)::bigint as median, strftime(d0, '{DAY}') as first_date from u where n > 0 order by n desc, l_returnflag limit 1
""")
def reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best catalogue match, and the statistics of its prices from the contract's signature to a given day."""
    best = table(spark, sf_dir, "part").where("p_name like 'small%'").orderBy("p_partkey").limit(1).select(F.col("p_partkey").alias("l_partkey"))
    during = (F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("l_shipdate") <= F.lit("1999-12-31").cast("timestamp"))
    found = samples(spark, sf_dir).where(during).join(F.broadcast(best), "l_partkey")
    out = price_statistics(found, "l_partkey", "l_returnflag", "price", "l_shipdate", "relevant").where("n > 0")
    return out.select("l_partkey", "unit", "n", "median", day("first_date").alias("first_date"))


@query(f"""
with {SAMPLES}, o as (select l_partkey, count(*) as n, quantile_cont(price, [0.05, 0.95]) as q from s group by all), w as (select quantile_cont(price, [0.05, 0.95]) as wq from s)
select l_partkey, n, 'all' as level, floor(round(wq[1], 4) + 0.5)::bigint as p5, floor(round(wq[2], 4) + 0.5)::bigint as p95 from o, w
""")
def price_tails_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item and no group has enough samples: all take the whole's."""
    return price_tails(samples(spark, sf_dir).withColumn("none", F.lit("x")), "l_partkey", "none", "price", 2**40)


@query(f"""
with s as (select l_partkey, l_returnflag, l_orderkey * 10 + l_linenumber as id, l_shipdate, floor(100 * l_extendedprice / l_quantity + 0.5)::bigint as price, l_quantity >= 5 as relevant from lineitem where l_suppkey % 7 <> 0),
u as (select l_partkey, l_returnflag, count(*) filter (relevant) as n, quantile_cont(price, 0.5) filter (relevant) as p50 from s group by all),
r as (select *, row_number() over (partition by l_partkey order by n desc, l_returnflag nulls last) as place from u),
t as (select l_partkey, id, price, row_number() over (partition by l_partkey order by l_shipdate desc, id) as place from s where relevant),
l as (select l_partkey, string_agg(id || ':' || price, ',' order by place) as samples from t where place <= 5 group by l_partkey)
select r.l_partkey, n, floor(round(p50, 4) + 0.5)::bigint as median, samples from r left join l using (l_partkey) where r.place = 1
""")
def price_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of materials with the first five samples; what a seventh of the suppliers sells stands for services."""
    rows = samples_with_ids(spark, sf_dir)
    out = price_report(rows, "kind", "l_partkey", "l_returnflag", "price", "l_shipdate", "relevant", "id", 5)
    return out.select("l_partkey", "n", "median", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["id"].cast("string"), x["price"].cast("string"))), ",").alias("samples"))


def samples_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(100 * F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("long")
    kind = F.when(F.col("l_suppkey") % 7 == 0, "S").otherwise("M")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate", price.alias("price"), (F.col("l_quantity") >= 5).alias("relevant"), kind.alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query(f"""
with {VERSIONS}, p as (select c_custkey as o_custkey, c_name, c_nationkey from customer), live as (select o_custkey, arg_max(o_orderkey, (o_orderdate, valid_until, o_orderkey)) as o_orderkey from v where valid_until is null group by o_custkey)
select p.o_custkey, c_name, o_orderkey, n_name from p join live using (o_custkey) left join nation on n_nationkey = c_nationkey and n_nationkey % 3 <> 0
""")
def provisions_versions_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as provisions, their open orders as versions, nations as norms, of which a third is missing."""
    provisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("norm"))
    norms = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("norm"), "n_name")
    versions = order_versions(spark, sf_dir).select("o_custkey", "o_orderdate", "valid_until", "o_orderkey")
    return provisions_in_force(provisions, versions, norms, "norm", "o_custkey", "o_orderdate", "valid_until").select("o_custkey", "c_name", "o_orderkey", "n_name")


@query("""
select l_orderkey, l_linenumber, o_orderstatus, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_returnflag = 'R' and l_quantity >= 25
""")
def items_of_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables along their keys: found items, their rulings, and whom these belong to."""
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 25").select("l_orderkey", "l_linenumber")
    rulings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return found.join(rulings, "l_orderkey").join(owners, "o_custkey").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as has_report from customer")
def analyses_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return with_existence(table(spark, sf_dir, "customer").select("c_custkey"), reports, "c_custkey", "has_report")


@query("select o_custkey, sum(case when o_orderpriority <> '5-LOW' then floor(o_totalprice * 100 + 0.5)::bigint end)::bigint as claimed from orders group by o_custkey")
def claimed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the values claimed, null where none is."""
    value = F.when(F.col("o_orderpriority") != "5-LOW", cents(F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(value).alias("claimed"))


@query("select source, count(*) as n_pages, sum(length(text))::bigint as n_chars, count(distinct lang) as n_langs from documents group by source")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.count_distinct("lang").alias("n_langs"))


@query("select * from (select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as moment from events order by ts desc, event_id desc limit 30)")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty, in ascending order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return last_in_order(rows, ["ts", "event_id"], 30).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""
with j as (select o_orderkey, '{"status":"' || o_orderstatus || '","customer":{"key":' || o_custkey || '}' || case when o_orderkey % 5 = 0 then '' else '}' end as payload from orders)
select o_orderkey, case when json_valid(payload) then payload ->> '$.status' end as status, case when json_valid(payload) then (payload ->> '$.customer.key')::bigint end as customer from j
""")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts; a broken text gives nulls."""
    orders = table(spark, sf_dir, "orders")
    closing = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("}")
    payload = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","customer":{"key":'), F.col("o_custkey").cast("string"), F.lit("}"), closing)
    parsed = F.try_parse_json(payload)
    return orders.select("o_orderkey", F.try_variant_get(parsed, "$.status", "string").alias("status"), F.try_variant_get(parsed, "$.customer.key", "long").alias("customer"))


@query("select o_orderkey, floor(o_totalprice * 100 + 0.5)::bigint as total_cents, case when length(trim(o_orderstatus || substr(o_orderpriority, 3, 1))) = 2 then upper(trim(o_orderstatus || substr(o_orderpriority, 3, 1))) end as code, o_orderkey % 600 in (429, 500, 502, 503, 504) or lower(o_orderpriority) like '%urgent%' as transient, (500 * 2 ** (o_orderkey % 4))::bigint as wait_ms from orders")
def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in cents, two-letter codes, which failures are worth another attempt, and how long to wait for it."""
    message = F.regexp_replace(F.lower("o_orderpriority"), "urgent", "Timeout")
    code = F.concat("o_orderstatus", F.substring("o_orderpriority", 3, 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("total_cents"), two_letters(code).alias("code"), transient_error(F.col("o_orderkey") % 600, message).alias("transient"), backoff_ms(F.col("o_orderkey") % 4).alias("wait_ms"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 'https://example.org' else 'https://example.org/app/editais/' || o_custkey || '/' || year(o_orderdate) || '/' || o_orderkey end as url from orders")
def purchase_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public addresses from control numbers, a quarter of which are none."""
    orders = table(spark, sf_dir, "orders")
    control = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("string")).otherwise(F.format_string("%d-1-%06d/%d", F.col("o_custkey"), F.col("o_orderkey"), F.year("o_orderdate")))
    return orders.select("o_orderkey", control_url(control, "https://example.org").alias("url"))
