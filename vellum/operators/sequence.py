"""Order-dependent operators as windows and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence_gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers missing between the least and the greatest of each group: (group, missing, before, after)."""
    distinct = rows.where(F.col(number).isNotNull()).select(group, number).distinct()
    after = F.lead(number).over(Window.partitionBy(group).orderBy(number))
    wide = distinct.withColumn("after", after).where(F.col("after") > F.col(number) + 1)
    return wide.select(group, F.explode(F.sequence(F.col(number) + 1, F.col("after") - 1)).alias("missing"), F.col(number).alias("before"), "after")


def carry_forward(rows: DataFrame, document: str, order: str, kind: str, value: str, levels: list[str]) -> DataFrame:
    """Adds, for each level, the value of the last row of that kind; a row of a higher level resets the lower ones.

    ``levels`` run from the highest down. Rows before the first row of the highest level have nulls only.
    """
    for i, level in enumerate(levels):
        outer = [f"_s{j}" for j in range(i)]
        w = Window.partitionBy(document, *outer).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        is_level = F.col(kind) == level
        rows = rows.withColumn(f"_s{i}", F.count_if(is_level).over(w)).withColumn(level, F.last(F.when(is_level, F.col(value)), ignorenulls=True).over(w))
        if i:
            rows = rows.withColumn(level, F.when(F.col(levels[0]).isNotNull(), F.col(level)))
    return rows.drop(*(f"_s{i}" for i in range(len(levels))))


def depth(levels: list[str]) -> Column:
    """How deep a row stands: the number of levels that it has, less one; null without the highest."""
    return F.when(F.col(levels[0]).isNotNull(), sum((F.col(x).isNotNull().cast("int") for x in levels), F.lit(0)) - 1)


def fixed_window_limits(calls: DataFrame, client: str, ts: str, tie: str, per_minute: int = 60, per_day: int = 500) -> DataFrame:
    """Which calls fixed minute and day windows let pass; calls denied don't count.

    A call passes the minute if it is among its minute's first ``per_minute``, and the day if it is among the first
    ``per_day`` of these in its UTC day. Adds allowed, scope (the limit that denied it) and retry_after in seconds.
    """
    minute, day = F.date_trunc("minute", ts), F.date_trunc("day", ts)
    rows = calls.withColumn("_m", minute).withColumn("_d", day)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(client, "_m").orderBy(ts, tie)))
    rows = rows.withColumn("_in_minute", F.col("_rn") <= per_minute)
    before = Window.partitionBy(client, "_d").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_day_n", F.count_if("_in_minute").over(before))
    rows = rows.withColumn("allowed", F.col("_in_minute") & (F.col("_day_n") <= per_day))
    seen = Window.partitionBy(client, "_m").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.count_if("allowed").over(seen), F.lit(0))
    second = F.unix_timestamp(ts)
    rows = rows.withColumn("scope", F.when(~F.col("allowed"), F.when(passed >= per_minute, "minute").otherwise("day")))
    rows = rows.withColumn("retry_after", F.when(F.col("scope") == "minute", 60 - second % 60).when(F.col("scope") == "day", 86400 - second % 86400).cast("long"))
    return rows.drop("_m", "_d", "_rn", "_in_minute", "_day_n")


def monotone(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """A value that never goes back: its greatest so far."""
    return rows.withColumn(value, F.max(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Texts in order until ``budget`` characters are reached; the one that crosses it is cut, later ones go."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") < budget).withColumn(text, F.substr(text, F.lit(1), F.lit(budget) - F.col("_before"))).drop("_before")


def packed_chunks(pages: DataFrame, document: str, page: str, text: str, most: int = 2400, separator: str = "\n\n") -> DataFrame:
    """Packs the blocks of each document's pages, in order, into chunks of up to ``most`` characters: (document, chunk, text, first_page, last_page).

    A block (trimmed, not empty) is never cut: one longer than ``most`` makes a chunk of its own. Each block counts two
    characters more for the blank line that joins it. Pages are sorted by document, page and text, in partitions by
    document, equal ones one after another; the fold passes over them and holds one chunk only, so a document may be of
    any length.
    """
    kind = pages.schema[document].dataType
    kept = pages.select(F.col(document).alias("d"), F.col(page).cast("long").alias("p"), F.col(text).alias("t"), F.col(page).alias("o")).withColumn("c", F.monotonically_increasing_id())
    blocks = kept.select("d", "o", "p", "c", F.posexplode(F.filter(F.transform(F.split("t", separator), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")).alias("i", "b"), "t")
    sizes = blocks.select("d", "o", "p", "c", F.xxhash64("t").alias("h"), "i", "b", F.length("b").alias("n"))
    dealt = sizes.repartition("d").sortWithinPartitions("d", "o", "h", "c", "i").select("d", "p", "b", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, used, held, first, last = None, 0, 0, [], None, None
        done: list[tuple] = []
        waiting = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for d, p, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (d != own or used + n + 2 > most):
                    done.append((own, chunk, "\n\n".join(held), first, last))
                    waiting += used
                    chunk, used, held = chunk + 1, 0, []
                if d != own:
                    own, chunk, first, last = d, 0, None, None
                if not held:
                    first = last = p
                held.append(b)
                used += n + 2
                last = p if p is not None else last
                first = p if first is None else first
                if waiting > 8_000_000 or len(done) >= 10_000:
                    yield batch_of(done)
                    done, waiting = [], 0
        if held:
            done.append((own, chunk, "\n\n".join(held), first, last))
        if done:
            yield batch_of(done)

    names = [document, "chunk", "text", "first_page", "last_page"]
    return dealt.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, (kind, T.LongType(), T.StringType(), T.LongType(), T.LongType()), strict=True)]))
