"""Price statistics over comparable purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import term_set
from ..storage import folders, kept_table, result_table


def relevance(samples: DataFrame, wanted: str, text: Column, least: float = 0.5) -> DataFrame:
    """Adds relevance_score (share of the wanted terms found, 2 digits), relevant (judged unrounded) and reason."""
    target = term_set(F.lit(wanted))
    found = F.size(F.array_intersect(target, term_set(text)))
    score = found / F.size(target)
    return samples.select(
        "*",
        F.when(F.size(target) == 0, 1.0).otherwise(half_up(score, 2)).alias("relevance_score"),
        ((F.size(target) == 0) | (score >= least)).alias("relevant"),
        F.when(F.size(target) == 0, "no terms to compare").otherwise(F.concat(found.cast("string"), F.lit(" of "), F.size(target).cast("string"), F.lit(" terms"))).alias("reason"),
    )


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, p): exact percentiles of whole numbers by group, linear between neighbours, as an array in the order of ``shares``.

    Values are counted first. The counts are dealt by ranges of (group, value), so that a group of any size lies in many
    slices; sums by slice tell which places each slice holds, and the running sum that finds the values around a share is
    taken within a slice. No group, the whole table as one included, meets in one task. Nulls don't count.
    """
    with folders(rows.sparkSession):
        counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
        # written: slices follow from a sample and have to be the same in all that comes
        dealt = kept_table(counts.repartitionByRange(*by, value).withColumn("slice", F.spark_partition_id()), "counted-values")
        slices = dealt.groupBy(*by, "slice").agg(F.sum("c").alias("n"))
        inside = Window.partitionBy(*by)
        before = F.coalesce(F.sum("n").over(inside.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = slices.select(*(F.col(g).alias(f"o_{g}") for g in by), F.col("slice").alias("o_slice"), before.alias("before"), F.sum("n").over(inside).alias("all"))
        same = F.col("slice") == F.col("o_slice")
        for g in by:
            same = same & F.col(g).eqNullSafe(F.col(f"o_{g}"))
        running = F.sum("c").over(Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        placed = dealt.withColumn("upto", running).join(offsets, same).withColumn("upto", F.col("upto") + F.col("before"))
        # the value at a place (from 0) is that with upto - c <= place < upto
        holds = lambda place: (F.col("upto") - F.col("c") <= place) & (place < F.col("upto"))
        found = []
        for i, share in enumerate(shares):
            at = F.lit(share) * (F.col("all") - 1)
            found += [F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"low{i}"), F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"high{i}"), F.max(at - F.floor(at)).alias(f"rest{i}")]
        between = [F.col(f"low{i}") + F.col(f"rest{i}") * (F.col(f"high{i}") - F.col(f"low{i}")) for i in range(len(shares))]
        return result_table(placed.groupBy(*by).agg(*found).select(*by, F.array(*between).alias("p")), "percentiles")


def price_statistics(samples: DataFrame, item: str, unit: str, price: str, date: str, relevant: str) -> DataFrame:
    """One row for each item: n, median, mean, p25, p75, min, max, first and last date over its dominant unit of supply.

    Samples that aren't relevant are left out and counted; of the rest the unit with most samples is taken (ties: the
    least unit, null last) and the others counted. Prices are whole cents; interpolated percentiles and the mean are
    rounded half up. An item without relevant samples has n 0 and null statistics.
    """
    by_unit = samples.groupBy(item, unit).agg(
        F.count_if(F.col(relevant)).alias("n"),
        F.count_if(~F.col(relevant)).alias("irrelevant"),
        *(F.when(F.count_if(F.col(relevant)) > 0, f(F.when(F.col(relevant), F.col(price)))).alias(name) for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))),
        F.min(F.when(F.col(relevant), F.col(date))).alias("first_date"),
        F.max(F.when(F.col(relevant), F.col(date))).alias("last_date"),
    )
    # units of an item are few: the window sees aggregated rows only
    inside = Window.partitionBy(item)
    ranked = by_unit.select(
        "*",
        F.row_number().over(inside.orderBy(F.desc("n"), F.col(unit).asc_nulls_last())).alias("place"),
        F.sum("n").over(inside).alias("all_n"),
        F.sum("irrelevant").over(inside).alias("discarded_relevance"),
    )
    shares = percentiles(samples.where(relevant), [item, unit], price, [0.25, 0.5, 0.75]).withColumnsRenamed({item: "p_item", unit: "p_unit"})
    best = ranked.where("place = 1").join(shares, F.col(item).eqNullSafe(F.col("p_item")) & F.col(unit).eqNullSafe(F.col("p_unit")), "left")
    some = F.col("n") > 0
    whole = lambda c: half_up(F.round(c, 4)).cast("long")
    return best.select(
        item,
        F.when(some, F.col(unit)).alias("unit"),
        F.col("n").cast("long").alias("n"),
        whole(F.col("p")[1]).alias("median"),
        whole(F.col("mean")).alias("mean"),
        whole(F.col("p")[0]).alias("p25"),
        whole(F.col("p")[2]).alias("p75"),
        F.col("min").cast("long").alias("min"),
        F.col("max").cast("long").alias("max"),
        F.to_date("first_date").alias("first_date"),
        F.to_date("last_date").alias("last_date"),
        F.col("discarded_relevance").cast("long").alias("discarded_relevance"),
        (F.col("all_n") - F.col("n")).cast("long").alias("discarded_unit"),
    )


def price_tails(samples: DataFrame, item: str, group: str, price: str, least: int = 5) -> DataFrame:
    """P5 and P95 for each item; items with fewer than ``least`` samples take their group's, groups too small the whole's."""
    both, counted = [0.05, 0.95], F.count("*").alias
    own = samples.groupBy(item, group).agg(counted("n"))
    own_p = percentiles(samples, [item, group], price, both).select(F.col(item).alias("o_item"), F.col(group).alias("o_group"), F.col("p").alias("own"))
    of_group = samples.groupBy(F.col(group).alias("g")).agg(counted("g_n"))
    group_p = percentiles(samples, [group], price, both).select(F.col(group).alias("g_group"), F.col("p").alias("grouped"))
    of_all = percentiles(samples.withColumn("whole_of", F.lit(1)), ["whole_of"], price, both).select(F.col("p").alias("whole"))  # one row
    one = lambda values: F.when(F.col("n") >= least, F.col("own")[values]).when(F.col("g_n") >= least, F.col("grouped")[values]).otherwise(F.col("whole")[values])
    return (
        own.join(own_p, F.col(item).eqNullSafe(F.col("o_item")) & F.col(group).eqNullSafe(F.col("o_group")), "left")
        .join(of_group, F.col(group).eqNullSafe(F.col("g")), "left")
        .join(group_p, F.col(group).eqNullSafe(F.col("g_group")), "left")
        .join(F.broadcast(of_all), how="left")
        .select(
            item,
            F.col("n").cast("long").alias("n"),
            F.when(F.col("n") >= least, "item").when(F.col("g_n") >= least, "group").otherwise("all").alias("level"),
            *(half_up(F.round(one(i), 4)).cast("long").alias(name) for i, name in ((0, "p5"), (1, "p95"))),
        )
    )


def price_report(samples: DataFrame, kind: str, item: str, unit: str, price: str, date: str, relevant: str, key: str, most: int = 50) -> DataFrame:
    """Price statistics with the first samples: (item, n, median, samples), for materials only (``kind`` not "S").

    samples: up to ``most`` relevant ones of the item, newest first, then by key. A sample's place is counted within its
    item, so that no item's samples are gathered beyond ``most``.
    """
    materials = samples.where(F.coalesce(F.col(kind), F.lit("")) != "S")
    figures = price_statistics(materials, item, unit, price, date, relevant).select(item, "n", "median")
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(date), key))
    shown = materials.where(relevant).select(item, key, date, price, place.alias("place")).where(F.col("place") <= most)
    listed = shown.groupBy(F.col(item).alias("s_item")).agg(F.array_sort(F.collect_list(F.struct("place", key, price))).alias("samples"))
    return figures.join(listed, F.col(item).eqNullSafe(F.col("s_item")), "left").drop("s_item")
