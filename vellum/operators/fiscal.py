"""Tax burden by year, burden differential of contracts, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, months_inclusive


def rates(year: Column, ref_cbs: Column, ref_ibs: Column) -> Column:
    """struct(cbs, ibs, compensated, problem) of a year; rates in percentage points, null where a reference is missing.

    Fixed values: 2026 pilot 0.9 and 0.1, compensated; 2027 and 2028 reference less 0.1 and 0.1; 2029 to 2032 the
    reference and 10 to 40 % of it; then both references.
    """
    share = F.when(year.between(2029, 2032), (year - 2028) / 10).when(year >= 2033, 1.0)
    cbs = F.when(year == 2026, 0.9).when(year.between(2027, 2028), F.greatest(ref_cbs - 0.1, F.lit(0.0))).when(year >= 2029, ref_cbs)
    ibs = F.when(year == 2026, 0.1).when(year.between(2027, 2028), 0.1).when(year >= 2029, ref_ibs * share)
    problem = (
        F.when(year.isNull() | (year < 2026), "no rates before 2026")
        .when((year >= 2027) & ref_cbs.isNull(), "reference rate of CBS is missing")
        .when((year >= 2029) & ref_ibs.isNull(), "reference rate of IBS is missing")
    )
    ok = problem.isNull()
    return F.struct(F.when(ok, cbs).alias("cbs"), F.when(ok, ibs).alias("ibs"), (year == 2026).alias("compensated"), problem.alias("problem"))


def reduced(rate: Column, year: Column, reduction: Column) -> Column:
    """A rate for purchases of the state: less ``reduction`` percent, not in 2026, not where it is null."""
    return F.when((year == 2026) | reduction.isNull(), rate).otherwise(rate * (1 - reduction / 100))


def burden_by_year(contracts: DataFrame) -> DataFrame:
    """A row for each contract and year from max(start, 2026) to end: cbs, ibs, gross, effective, problem.

    ``contracts``: contract, start, end (dates), ref_cbs, ref_ibs, reduction, government (boolean), credits (percent).
    """
    first, last = F.greatest(F.year("start"), F.lit(2026)), F.year("end")
    years = contracts.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("year"))
    rated = years.withColumn("r", rates(F.col("year"), F.col("ref_cbs"), F.col("ref_ibs")))
    cut = F.when(F.col("government"), F.col("reduction"))
    rated = rated.withColumn("cbs", reduced(F.col("r.cbs"), F.col("year"), cut)).withColumn("ibs", reduced(F.col("r.ibs"), F.col("year"), cut))
    rated = rated.withColumn("gross", F.col("cbs") + F.col("ibs"))
    effective = F.when(F.col("r.compensated"), 0.0).otherwise(F.col("gross") * (1 - F.coalesce("credits", F.lit(0.0)) / 100))
    return rated.select(*contracts.columns, "year", "cbs", "ibs", "gross", F.when(F.col("r.problem").isNull(), half_up(effective, 4)).alias("effective"), F.col("r.problem").alias("problem"))


def burden_differential(contracts: DataFrame, as_of: Column) -> DataFrame:
    """One row for each contract: years rated and failed, mean effective burden, difference in points, annual and remaining value in cents, alerts, failure.

    Adds to the columns of ``burden_by_year``: value_cents, pre (burden before, percentage points), simplified (boolean).
    The difference is the mean over years of effective (rounded) less pre, to four digits.
    """
    by = burden_by_year(contracts).groupBy("contract").agg(F.count("effective").alias("n_years"), F.count_if(F.col("effective").isNull()).alias("n_failed"), F.avg("effective").alias("mean_effective"))
    joined = contracts.join(by, "contract", "left").withColumn("n_years", F.coalesce("n_years", F.lit(0)).cast("long")).withColumn("n_failed", F.coalesce("n_failed", F.lit(0)).cast("long"))
    diff = half_up(F.round(F.col("mean_effective") - F.col("pre"), 9), 4)
    joined = joined.withColumn("difference", diff)
    annual = half_up(F.round(F.col("value_cents") * F.col("difference") / 100, 6)).cast("long")
    months = months_inclusive(F.greatest(F.col("start"), as_of), F.col("end"))
    joined = joined.withColumn("annual_cents", annual).withColumn("months_left", months)
    late = F.year("end") >= 2027
    alerts = F.array_compact(
        F.array(
            F.when(F.col("ref_cbs").isNull() & late, "reference rate of CBS is missing"),
            F.when(F.col("government") & F.col("reduction").isNull() & late, "no reduction for purchases of the state"),
            F.when(F.col("simplified"), "simplified regime"),
        )
    )
    failure = F.when(F.year("end") < F.greatest(F.year("start"), F.lit(2026)), "no year to rate").when(F.col("n_years") == 0, "no year could be rated")
    return joined.select(
        "contract", "n_years", "n_failed", F.round("mean_effective", 6).alias("mean_effective"), "difference", "annual_cents", "months_left", half_up(F.round(F.col("annual_cents") * F.col("months_left") / 12, 6)).cast("long").alias("remaining_cents"), F.array_join(alerts, "; ").alias("alerts"), failure.alias("failure")
    )


def verdict(out_of_scope: Column, late: Column, instructed: Column, proven: Column, delta: Column, points: Column, claim: Column, limit: float = 0.5) -> Column:
    """struct(verdict, value, reason, review): the first rule that holds decides."""
    rules = [
        (out_of_scope, "improcedente", F.lit(0), "fora_de_escopo", False),
        (late, "improcedente", F.lit(0), "intempestivo", False),
        (~instructed | ~proven | claim.isNull(), "diligencia", F.lit(0), "comprovacao_insuficiente", False),
        (delta < 0, "improcedente", F.lit(0), "carga_reduzida", True),
        (delta == 0, "improcedente", F.lit(0), "sem_desequilibrio", False),
        (F.abs(points) < limit, "improcedente", F.lit(0), "imaterial", False),
        (claim <= delta, "procedente", claim, "pleito_integral", False),
        (F.lit(True), "parcialmente_procedente", delta, "pleito_excede_delta", False),
    ]
    out = None
    for when, name, value, reason, review in rules:
        row = F.struct(F.lit(name).alias("verdict"), value.cast("long").alias("value"), F.lit(reason).alias("reason"), F.lit(review).alias("review"))
        out = F.when(when, row) if out is None else out.when(when, row)
    return out
