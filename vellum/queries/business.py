"""Tax burden, verdicts, audits, invariants, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up, months_inclusive
from ..functions.text import audit_form, estimated_tokens, preview, slug
from ..operators.checks import allowed_steps, analysis_rules, applies_to, audit_citations, audited_confidence, calculation_rules, conversation_state, cost_rollup, grounded, grouped_names, missing_items, passages, report_rules, violations
from ..operators.fiscal import burden_by_year as by_year
from ..operators.fiscal import burden_differential as differential
from ..operators.fiscal import verdict
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contracts of one to seven years, 32 years later."""
    key = F.col("o_orderkey")
    start = F.to_date(F.col("o_orderdate") + F.expr("interval 32 years"))
    return table(spark, sf_dir, "orders").select(
        key.alias("contract"),
        start.alias("start"),
        F.add_months(start, (12 * (key % 7 + 1)).cast("int")).alias("end"),
        F.when(key % 11 != 0, 8.8).alias("ref_cbs"),
        F.when(key % 13 != 0, 18.0).alias("ref_ibs"),
        F.when(key % 3 == 0, 30.0).alias("reduction"),
        (key % 2 == 0).alias("government"),
        ((key % 5) * 5.0).alias("credits"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("value_cents"),
        (key % 30).cast("double").alias("pre"),
        (key % 17 == 0).alias("simplified"),
    )


BURDEN = """
c as (select o_orderkey as contract, (o_orderdate + interval 32 year)::date as s, o_orderkey % 7 + 1 as len, case when o_orderkey % 11 <> 0 then 8.8::double end as ref_cbs, case when o_orderkey % 13 <> 0 then 18.0::double end as ref_ibs,
    case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 30.0::double end as red, o_orderkey % 3 = 0 as has_red, o_orderkey % 2 = 0 as gov, (o_orderkey % 5) * 5.0::double as credits,
    floor(o_totalprice * 100 + 0.5)::bigint as cents, (o_orderkey % 30)::double as pre, o_orderkey % 17 = 0 as simple from orders),
d as (select *, (s + to_years(len::int))::date as e from c),
y as (select *, unnest(generate_series(greatest(year(s), 2026), year(e))) as year from d where year(e) >= greatest(year(s), 2026)),
r as (select *, case when year = 2026 then 0.9::double when year <= 2028 then greatest(ref_cbs - 0.1::double, 0) else ref_cbs end as cbs0,
    case when year <= 2028 then 0.1::double when year <= 2032 then ref_ibs * ((year - 2028) / 10.0::double) else ref_ibs end as ibs0,
    case when year >= 2027 and ref_cbs is null then 'reference rate of CBS is missing' when year >= 2029 and ref_ibs is null then 'reference rate of IBS is missing' end as problem from y),
q as (select *, case when problem is null then case when red is null or year = 2026 then cbs0 else cbs0 * (1 - red / 100) end end as cbs, case when problem is null then case when red is null or year = 2026 then ibs0 else ibs0 * (1 - red / 100) end end as ibs from r),
b as (select *, case when problem is null then floor(case when year = 2026 then 0 else (cbs + ibs) * (1 - credits / 100) end * 10000 + 0.5) / 10000 end as effective from q)
"""


@query(f"with {BURDEN} select contract, year::bigint as year, round(cbs, 6) as cbs, round(ibs, 6) as ibs, round(effective, 6) as effective, problem from b")
def burden_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_year(contracts(spark, sf_dir)).select("contract", F.col("year").cast("long").alias("year"), F.round("cbs", 6).alias("cbs"), F.round("ibs", 6).alias("ibs"), F.round("effective", 6).alias("effective"), "problem")


DIFFERENTIAL = f"""{BURDEN}, g as (select contract, count(effective) as n_years, count(*) - count(effective) as n_failed, avg(effective) as m from b group by contract),
j as (select d.*, coalesce(n_years, 0) as n_years, coalesce(n_failed, 0) as n_failed, m, floor(round(m - pre, 9) * 10000 + 0.5) / 10000 as diff from d left join g using (contract)),
k as (select *, floor(round(cents * diff / 100, 6) + 0.5)::bigint as annual, greatest((year(e) - year(greatest(s, date '2028-06-15'))) * 12 + month(e) - month(greatest(s, date '2028-06-15')) + 1, 0) as months from j)
"""


@query(f"""with {DIFFERENTIAL} select contract, n_years, n_failed, round(m, 6) as mean_effective, diff as difference, annual as annual_cents, months as months_left, floor(round(annual * months / 12.0::double, 6) + 0.5)::bigint as remaining_cents,
    concat_ws('; ', case when ref_cbs is null and year(e) >= 2027 then 'reference rate of CBS is missing' end, case when gov and not has_red and year(e) >= 2027 then 'no reduction for purchases of the state' end, case when simple then 'simplified regime' end) as alerts,
    case when year(e) < greatest(year(s), 2026) then 'no year to rate' when n_years = 0 then 'no year could be rated' end as failure from k""")
def burden_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differential(contracts(spark, sf_dir), F.lit("2028-06-15").cast("date"))


@query(f"""with {DIFFERENTIAL}, i as (select contract, contract % 29 = 0 as scope, contract % 31 = 0 as late, contract % 19 <> 0 as instructed, contract % 23 <> 0 as proven, annual as delta, diff as points, case when contract % 37 <> 0 then cents // 20 end as claim from k)
select contract, case when scope then 'improcedente' when late then 'improcedente' when not instructed or not proven or claim is null then 'diligencia' when delta < 0 then 'improcedente' when delta = 0 then 'improcedente' when abs(points) < 0.5 then 'improcedente' when claim <= delta then 'procedente' else 'parcialmente_procedente' end as verdict,
    coalesce(case when scope or late or not instructed or not proven or claim is null or delta < 0 or delta = 0 or abs(points) < 0.5 then 0 when claim <= delta then claim else delta end, 0) as value,
    case when scope then 'fora_de_escopo' when late then 'intempestivo' when not instructed or not proven or claim is null then 'comprovacao_insuficiente' when delta < 0 then 'carga_reduzida' when delta = 0 then 'sem_desequilibrio' when abs(points) < 0.5 then 'imaterial' when claim <= delta then 'pleito_integral' else 'pleito_excede_delta' end as reason from i""")
def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir)
    rated = differential(c, F.lit("2028-06-15").cast("date")).join(c.select("contract", "value_cents"), "contract")
    n = F.col("contract")
    claim = F.when(n % 37 != 0, F.floor(F.col("value_cents") / 20).cast("long"))
    v = verdict(n % 29 == 0, n % 31 == 0, n % 19 != 0, n % 23 != 0, F.col("annual_cents"), F.col("difference"), claim)
    return rated.select("contract", v.alias("v")).select("contract", "v.verdict", F.coalesce("v.value", F.lit(0)).alias("value"), "v.reason")


@query(r"""
with b as (select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as official from benchmark),
c as (select doc_id, doc_id % (select count(*) from b) as item_id, case when doc_id % 3 = 0 then '  ' || official || chr(10) else text end as quote from documents d left join b on b.item_id = d.doc_id % (select count(*) from b))
select doc_id, case when official is not null and trim(regexp_replace(quote, '\s+', ' ', 'g')) = official then 'APROVADA' else 'REJEITADA' end as status,
    case when official is null then 'reference not found' when trim(regexp_replace(quote, '\s+', ' ', 'g')) is distinct from official then 'text differs' end as reason, sha256(official) as official_sha256
from c left join b using (item_id)
""")
def audit_literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes ascribed to benchmark items: those of every third document are literal, up to white space, the others whole texts. ``audit_passages`` holds all documents against all items."""
    items = table(spark, sf_dir, "benchmark")
    official = items.select("item_id", F.col("text").alias("official"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % items.count()).alias("item_id"), "text")
    quoted = docs.join(items.select("item_id", audit_form("text").alias("exact")), "item_id", "left")
    quotes = quoted.select("doc_id", "item_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), "exact", F.lit("\n"))).otherwise(F.col("text")).alias("quote"))
    return audit_citations(quotes, official, "item_id", "quote", "official").select("doc_id", "status", "reason", "official_sha256")


@query(r"""
with b as (select item_id, trim(regexp_replace(regexp_replace(text, '[\x{FEFF}\x{200B}-\x{200D}]', '', 'g'), '\s+', ' ', 'g')) as official from benchmark),
d as (select doc_id, trim(regexp_replace(regexp_replace(text, '[\x{FEFF}\x{200B}-\x{200D}]', '', 'g'), '\s+', ' ', 'g')) as quote from documents)
select doc_id, item_id, case when quote = official then 'equal' else 'contained' end as relation, sha256(official) as official_sha256 from d join b on contains(quote, official) where item_id is not null and official <> ''
""")
def audit_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text equals a benchmark item or contains it, at any number of items."""
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", "text")


@query("""
with n as (select count(*) as n from benchmark), a as (select doc_id % n as item_id, doc_id % 3 <> 0 or 5 * (doc_id % n) >= 4 * n as bad, (doc_id % 12) / 10.0::double as c from documents, n)
select item_id, bool_or(bad) as retry, case when bool_or(bad) then least(least(greatest(max(c), 0), 1), 0.5) else least(greatest(max(c), 0), 1) end as confidence from a group by item_id
""")
def audit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").count()
    item = F.col("doc_id") % n
    audits = table(spark, sf_dir, "documents").select(
        item.alias("item_id"), F.when((F.col("doc_id") % 3 != 0) | (5 * item >= 4 * n), "REJEITADA").otherwise("APROVADA").alias("status"), ((F.col("doc_id") % 12) / 10).alias("confidence")
    )
    return audited_confidence(audits, "item_id", "confidence")


@query("""
select c_custkey, concat_ws(',', case when not coalesce(c_acctbal >= 0, false) then 'balance_not_negative' end, case when not coalesce(regexp_full_match(c_name, 'Customer#[0-9]{9}'), false) then 'name_form' end,
    case when not coalesce(c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), false) then 'known_segment' end) as violations from customer
""")
def invariant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"balance_not_negative": F.col("c_acctbal") >= 0, "name_form": F.col("c_name").rlike("^Customer#[0-9]{9}$"), "known_segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")}
    return violations(table(spark, sf_dir, "customer"), rules).select("c_custkey", F.array_join("violations", ",").alias("violations"))


VERDICTS = ["inconclusiva", "procedente", "parcialmente_procedente", "diligencia", "improcedente"]


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses: their lines are citations, points (from the fourth on), calculations and sections."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "REJEITADA").otherwise("APROVADA")
    severity = F.when(F.col("l_quantity") > 40, "bloqueante").otherwise("leve")
    roman = F.get(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII"))), F.col("l_linenumber") - 1)
    listed = lambda x: F.collect_list(x)
    section = F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").alias("at"), roman.alias("number"))))
    by = lines.groupBy("l_orderkey").agg(listed(F.struct(status.alias("status"))).alias("citations"), listed(F.when(F.col("l_linenumber") >= 4, F.struct(severity.alias("severity")))).alias("points"), listed(F.struct((F.col("l_tax") > 0.06).alias("success"))).alias("calculations"), section.alias("sections"))
    key = F.col("l_orderkey")
    return by.withColumn("verdict", F.get(F.array(*map(F.lit, VERDICTS)), (key % 5).cast("int"))).withColumn("confidence", key % 10 / 10)


@query(f"""
with b as (select l_orderkey, bool_or(l_returnflag = 'R') as rejected, count(*) filter (l_linenumber >= 4) as n_points, coalesce(bool_or(l_quantity > 40) filter (l_linenumber >= 4), false) as blocking, bool_or(l_tax > 0.06) as calculated,
    count(distinct l_linenumber) filter (l_linenumber <= 5) = 5 as ordered from lineitem group by l_orderkey),
v as (select *, {VERDICTS}[(l_orderkey % 5 + 1)::int] as verdict, (l_orderkey % 10) / 10.0 as confidence from b)
select l_orderkey, concat_ws(',', case when rejected and confidence > 0.5 then 'rejected_citation_lowers_confidence' end, case when verdict = 'inconclusiva' and not blocking then 'inconclusive_has_blocking_point' end,
    case when verdict in ('procedente', 'parcialmente_procedente') and not calculated then 'granted_has_calculation' end, case when verdict = 'diligencia' and n_points = 0 then 'diligence_has_point' end) as of_analysis,
    concat_ws(',', case when not ordered then 'sections_in_order' end, case when rejected then 'only_approved_citations' end) as of_report from v
""")
def analysis_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = violations(analyses(spark, sf_dir), analysis_rules()).withColumnRenamed("violations", "first")
    found = violations(found, report_rules())
    return found.select("l_orderkey", F.array_join("first", ",").alias("of_analysis"), F.array_join("violations", ",").alias("of_report"))


@query("""
select o_orderkey, concat_ws(',', case when o_orderstatus <> 'F' and o_orderkey % 3 = 0 then 'failed_has_error' end, case when o_orderstatus = 'F' and o_orderkey % 5 = 0 then 'succeeded_has_value' end, case when o_orderstatus = 'F' and o_orderkey % 7 = 0 then 'succeeded_has_steps' end) as violations from orders
""")
def calculation_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("success"), F.when(key % 3 != 0, "late").alias("error"), F.when(key % 5 != 0, F.col("o_totalprice")).alias("value"), F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("steps"))
    return violations(rows, calculation_rules()).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("""
select min('Acórdão ' || o_orderkey || '/' || year(o_orderdate) || '-Plenário') as label from orders where o_orderkey % 3 = 0 and o_custkey % 2 = 0 group by o_orderkey, year(o_orderdate)
""")
def grounded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings cited in answers, of which a third has been retrieved."""
    orders = table(spark, sf_dir, "orders")
    named = F.format_string("Acórdão %d/%d", F.col("o_orderkey"), F.year("o_orderdate"))
    answers = orders.where("o_custkey % 2 = 0").select(F.concat(F.lit("segundo o "), named, F.lit(", decide-se")).alias("said"))
    retrieved = orders.where("o_orderkey % 3 = 0").select(F.concat(named, F.lit("-Plenário")).alias("label"))
    return grounded(answers, retrieved, "said", "label").select("label")


PRICES = [("assistant", 0.075, 0.3), ("user", 1.25, 5.0)]


@query("""
with p as (select * from (values ('assistant', 0.075::double, 0.3::double), ('user', 1.25::double, 5.0::double)) t(model, i, o)),
c as (select role as model, ceil(length(text) / 4.0)::bigint as a, length(text) // 4 as b from conversations),
m as (select c.model, a, b, round(round((a * coalesce(i, 0) + b * coalesce(o, 0)) / 1e6, 6) * 1e6)::bigint as micro from c left join p using (model))
select model, count(*) as n_calls, sum(a)::bigint as tokens_in, sum(b)::bigint as tokens_out, sum(micro)::bigint as cost_micro from m group by rollup (model)
""")
def cost_rollup_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), estimated_tokens("text").alias("tokens_in"), estimated_tokens("text", up=False).alias("tokens_out"))
    return cost_rollup(calls, spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))


@query("""
with s as (select conv_id, bool_or(role = 'system') as doc, max(turn) >= 2 as draft, max(case when turn >= 4 then turn end) as analysis, max(turn) >= 6 as report, sum(length(text)) as n from conversations group by conv_id)
select conv_id, case when not doc then 'AGUARDANDO_DOCUMENTO' when not draft then 'DOCUMENTO_RECEBIDO' when analysis is null then 'PETICAO_EXTRAIDA' when not report then 'ANALISE_PRONTA' else 'PARECER_GERADO' end as state,
    concat_ws(', ', case when n - 2000 <= 0 then 'contract value' end) as missing from s
""")
def conversation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.bool_or(F.col("role") == "system").alias("doc"), (F.max("turn") >= 2).alias("draft"), F.max(F.when(F.col("turn") >= 4, F.col("turn"))).alias("analysis"), (F.max("turn") >= 6).alias("report"), F.sum(F.length("text")).alias("n")
    )
    summary = F.lit("x" * 60)
    return facts.select("conv_id", conversation_state(F.col("doc"), F.col("draft"), F.col("analysis"), F.col("report")).alias("state"), F.array_join(missing_items(F.col("n") - 2000, summary), ", ").alias("missing"))


@query("""
with n as (select n_name, case when n_nationkey % 5 = 0 then [] when n_nationkey % 2 = 0 then ['plan', 'write'] else ['plan'] end as phases from nation),
s as (select n_name, unnest(case when len(phases) = 0 then ['plan', 'write', 'verify'] else phases end) as phase from n)
select phase, string_agg(distinct n_name, ',' order by n_name) as names from s group by phase
""")
def skills_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as skills: those without phases belong to every phase."""
    phases = F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("plan"), F.lit("write"))).otherwise(F.array(F.lit("plan")))
    out = grouped_names(table(spark, sf_dir, "nation").select("n_name", phases.alias("phases")), "n_name", "phases", ["plan", "write", "verify"])
    return out.select("phase", F.array_join("names", ",").alias("names"))


@query("select doc_id, source from documents where len(string_split(source, '1')) = 1 or list_contains(string_split(source, '1'), 'src')")
def applies_to_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.when(F.size(F.split("source", "1")) == 1, F.array().cast("array<string>")).otherwise(F.split("source", "1"))
    return table(spark, sf_dir, "documents").withColumn("parts", parts).where(applies_to("parts", "src")).select("doc_id", "source")


@query(r"""
select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when length(p_name || ' ' || p_type || ' ' || p_brand) > 24 then substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 21) || '...' else p_name || ' ' || p_type || ' ' || p_brand end as preview,
    floor(p_retailprice * 100 + 0.5)::bigint as cents, (p_size % 24) + 1 as months from part
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    start = F.lit("2024-01-31").cast("date")
    return part.select(
        "p_partkey", slug("p_name").alias("slug"), preview(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 24).alias("preview"), half_up(F.col("p_retailprice") * 100).cast("long").alias("cents"),
        months_inclusive(start, F.add_months(start, F.col("p_size") % 24)).alias("months"),
    )
