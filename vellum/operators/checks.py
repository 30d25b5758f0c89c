"""Audits, invariants, roll-ups and small state rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import audit_form


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds violations: the names, in order, of the rules that a row breaks; a rule that is null for a row is broken."""
    return rows.withColumn("violations", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))))


def audit_citations(citations: DataFrame, official: DataFrame, ref: str, quote: str, text: str) -> DataFrame:
    """Compares quotes with the official text of their reference: status, reason and the hash of the official text.

    ``official`` has one row for each ref. Approved only if both texts are equal in their audit form.
    """
    own = official.select(F.col(ref).alias("_ref"), audit_form(text).alias("_official"))
    met = citations.join(own, F.col(ref) == F.col("_ref"), "left")
    reason = (
        F.when(F.col(ref).isNull(), "no reference")
        .when(F.col("_ref").isNull(), "reference not found")
        .when(F.coalesce(F.col("_official"), F.lit("")) == "", "official text is missing")
        .when(F.coalesce(audit_form(quote), F.lit("")) != F.col("_official"), "text differs")
    )
    return met.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "APROVADA").otherwise("REJEITADA")).withColumn("official_sha256", F.sha2("_official", 256)).drop("_ref", "_official")


#: Words of an item by which it is looked for in documents. Up to so many items are broadcast; more are joined by shuffling.
ANCHOR, BROADCAST_ITEMS = 8, 300_000


#: Up to so many prices are broadcast; more are joined by shuffling.
BROADCAST_PRICES = 100_000


def word_hashes(text: str) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def word_runs(words: str, n: int) -> str:
    """SQL for the hashes of every ``n`` consecutive word hashes. ``words`` is a column: an expression would be taken anew for each run."""
    args = ", ".join(f"{words}[i + {j}]" for j in range(n))
    return f"if(size({words}) < {n}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {n}), i -> xxhash64({n}, {args})))"


def passages(docs: DataFrame, items: DataFrame, doc: str, item: str, doc_text: str, item_text: str) -> DataFrame:
    """(doc, item, relation, official_sha256) of every pair where the document's text is ``equal`` to the item's or is longer and has it (``contained``), both in audit form.

    The first and last word of an item may be parts of longer words in a document, but those between are the same words
    there: the first ``ANCHOR`` of them (all, if there are fewer) are met by hash, and what meets is compared in full.
    Items of one or two words are compared with every document. Items without text or id are in none; repeated rows give
    a pair each.
    """
    own = items.select(F.col(item).alias("_item"), audit_form(item_text).alias("_official")).where("_item is not null and _official <> ''").withColumn("_w", word_hashes("_official"))
    whole = docs.select(F.col(doc).alias("_doc"), audit_form(doc_text).alias("_quote")).where("_quote <> ''")
    met = whole.join(own.where("size(_w) <= 2").select("_item", "_official"), F.contains("_quote", "_official"))
    own = own.where("size(_w) > 2").withColumn("_n", F.least(F.size("_w") - 2, F.lit(ANCHOR)))
    anchor = " ".join(f"when {n} then xxhash64({n}, {', '.join(f'_w[{j}]' for j in range(1, n + 1))})" for n in range(1, ANCHOR + 1))
    own = own.withColumn("_anchor", F.expr(f"case _n {anchor} end")).drop("_w")
    worded = whole.select("_doc", F.xxhash64("_quote").alias("_key"), word_hashes("_quote").alias("_w"))
    runs = [worded.select("_doc", "_key", F.lit(n).alias("_run"), F.explode(F.expr(word_runs("_w", n))).alias("_hash")) for n in sorted(r["_n"] for r in own.select("_n").distinct().collect())]
    anchors = own.select("_n", "_anchor").distinct()
    anchors = F.broadcast(anchors) if anchors.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS else anchors
    for run in runs:
        hit = run.join(anchors, (F.col("_hash") == F.col("_anchor")) & (F.col("_run") == F.col("_n"))).select(F.col("_doc").alias("_d"), F.col("_key").alias("_k"), "_n", "_anchor").distinct()
        text = hit.join(whole.withColumn("_key", F.xxhash64("_quote")), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).select("_doc", "_quote", "_n", "_anchor")
        met = met.unionByName(text.join(own, ["_n", "_anchor"]).where(F.contains("_quote", "_official")).select("_doc", "_quote", "_item", "_official"))
    relation = F.when(F.col("_quote") == F.col("_official"), "equal").otherwise("contained")
    return met.select(F.col("_doc").alias(doc), F.col("_item").alias(item), relation.alias("relation"), F.sha2("_official", 256).alias("official_sha256"))


def audited_confidence(audits: DataFrame, group: str, confidence: str) -> DataFrame:
    """Confidence of each group: 0.5 at most if any citation was rejected, within 0 and 1; retry if any was."""
    by = audits.groupBy(group).agg(F.bool_or(F.col("status") == "REJEITADA").alias("retry"), F.max(confidence).alias("_c"))
    bounded = F.least(F.greatest(F.col("_c"), F.lit(0.0)), F.lit(1.0))
    return by.select(group, "retry", F.when(F.col("retry"), F.least(bounded, F.lit(0.5))).otherwise(bounded).alias("confidence"))


def grounded(answers: DataFrame, retrieved: DataFrame, text: str, label: str) -> DataFrame:
    """Citations ``number/year`` of ``answers`` that were retrieved, once each, under the retrieved label."""
    key = lambda c: F.replace(F.regexp_extract(c, r"(\d[\d.]*/\d{4})", 1), F.lit("."), F.lit(""))
    wanted = answers.select(key(F.col(text)).alias("k")).where("k <> ''").distinct()
    return retrieved.select(key(F.col(label)).alias("k"), label).groupBy("k").agg(F.min(label).alias(label)).join(wanted, "k", "left_semi")


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model and in total (model null): unknown models cost nothing, each call rounded to six digits.

    ``calls``: model, tokens_in, tokens_out. ``prices``: model, price_in, price_out for a million tokens.
    """
    p = prices.select(F.col("model").alias("_m"), "price_in", "price_out")
    p = F.broadcast(p) if p.limit(BROADCAST_PRICES + 1).count() <= BROADCAST_PRICES else p
    # six digits as doubles have them: F.round(x, 6) would round the shortest decimal, which lifts halves that lie just below
    cost = F.round((F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6 * 1e6) / 1e6
    joined = calls.join(p, F.col("model") == F.col("_m"), "left").withColumn("micro", F.round(cost * 1e6).cast("long"))
    total = joined.rollup("model").agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("micro").alias("cost_micro"))
    return total


def conversation_state(has_document: Column, has_draft: Column, analysis: Column, has_report: Column) -> Column:
    """The state that four facts stand for, under fixed names; the first fact that is missing decides."""
    return (
        F.when(~has_document, "AGUARDANDO_DOCUMENTO")
        .when(~has_draft, "DOCUMENTO_RECEBIDO")
        .when(analysis.isNull(), "PETICAO_EXTRAIDA")
        .when(~has_report, "ANALISE_PRONTA")
        .otherwise("PARECER_GERADO")
    )


#: What may be done next in a state; in the others nothing.
STEPS = {"DOCUMENTO_RECEBIDO": ["extrair_peticao_do_documento"], "PETICAO_EXTRAIDA": ["extrair_peticao_do_documento", "analisar_reequilibrio"], "ANALISE_PRONTA": ["gerar_parecer"]}


def allowed_steps(state: Column) -> Column:
    """The steps that a state allows, in order; none for an unknown one."""
    known = F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(known[state], F.array().cast("array<string>"))


def analysis_rules() -> dict[str, Column]:
    """Rules of an analysis: citations and points (arrays of struct with status, severity), calculations (success), verdict, confidence."""
    some = lambda c, field, value: F.exists(c, lambda x: x[field] == value)
    verdict = F.col("verdict")
    return {
        "rejected_citation_lowers_confidence": ~some("citations", "status", "REJEITADA") | (F.col("confidence") <= 0.5),
        "inconclusive_has_blocking_point": (verdict != "inconclusiva") | some("points", "severity", "bloqueante"),
        "granted_has_calculation": ~verdict.isin("procedente", "parcialmente_procedente") | some("calculations", "success", True),
        "diligence_has_point": (verdict != "diligencia") | (F.size("points") >= 1),
    }


def report_rules() -> dict[str, Column]:
    """Rules of a report: its first five sections are I to V, in order, and all its citations are approved."""
    five = F.slice(F.transform("sections", lambda x: x["number"]), 1, 5)
    return {"sections_in_order": five == F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), "only_approved_citations": F.forall("citations", lambda x: x["status"] == "APROVADA")}


def calculation_rules() -> dict[str, Column]:
    """Rules of a calculation: a failed one names its error, a successful one has a value and at least one step."""
    ok = F.col("success")
    return {"failed_has_error": ok | (F.length("error") > 0), "succeeded_has_value": ~ok | F.col("value").isNotNull(), "succeeded_has_steps": ~ok | (F.size("steps") > 0)}


def missing_items(value_cents: Column, summary: Column) -> Column:
    """What a draft still needs before it can be analysed."""
    return F.array_compact(F.array(F.when(F.coalesce(value_cents, F.lit(0)) <= 0, "contract value"), F.when(F.length(F.trim(F.coalesce(summary, F.lit("")))) < 50, "description of at least 50 characters")))


def grouped_names(rows: DataFrame, name: str, phases: str, every: list[str]) -> DataFrame:
    """Sorted names by phase; a row without phases belongs to all of them."""
    spread = rows.select(name, F.explode(F.when(F.size(phases) == 0, F.array(*map(F.lit, every))).otherwise(F.col(phases))).alias("phase"))
    return spread.groupBy("phase").agg(F.sort_array(F.collect_set(name)).alias("names"))


def applies_to(column: str, member: str) -> Column:
    """Whether an array has the member, or is empty and so applies to all."""
    return F.array_contains(column, member) | (F.size(column) == 0)
