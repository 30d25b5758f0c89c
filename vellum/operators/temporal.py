"""Lookups over versioned rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept_table


def valid_at(versions: DataFrame, entity: str, start: str, end: str, at: Column, payload: list[str]) -> DataFrame:
    """Of each entity the version valid at ``at``: start <= at < end (null end: open), overlaps resolved to the newest start."""
    valid = versions.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))
    return valid.groupBy(entity).agg(F.max_by(F.struct(start, end, *payload), F.struct(start, *payload)).alias("v")).select(entity, "v.*")


def as_of_join(facts: DataFrame, versions: DataFrame, entity: str, at: str, start: str, end: str, payload: list[str]) -> DataFrame:
    """Each fact with the payload of its entity's version valid at the fact's time, as ``valid_at``: the newest start of
    those with start <= at < end (null end: open), of equal starts the greatest payload. Facts without one have nulls.

    A sweep: facts and versions are sorted by entity and time, and one pass keeps the open versions as a stack, the newest
    on top. A version that ends no later than a newer one can't count again and goes, so ends grow down the stack, and
    what has ended lies on top and is taken off: each version comes and goes once, however versions overlap.

    Rows are dealt by ranges of (entity, time) and swept where they arrive, so an entity of any size lies in many slices.
    The stack that a slice leaves of its last entity is carried into the later slices of that entity, for those facts of
    theirs that met no version of their own slice. Null entities, times and starts match nothing.
    """
    types = {facts.schema[at].dataType, versions.schema[start].dataType, versions.schema[end].dataType}
    common = None if len(types) == 1 else T.TimestampType() if types & {T.DateType(), T.TimestampType()} else T.DoubleType()
    time = lambda c: F.col(c).cast(common) if common else F.col(c)
    value, fact = F.struct(*payload), F.struct("*")
    value_type, fact_type = versions.select(value.alias("x")).schema["x"].dataType, facts.select(fact.alias("x")).schema["x"].dataType
    v = versions.where(F.col(start).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("e"), time(start).alias("t"), F.lit(VERSION).alias("kind"), time(end).alias("end"), value.alias("value"), F.lit(None).cast(fact_type).alias("fact"))
    f = facts.select(F.col(entity).cast(versions.schema[entity].dataType).alias("e"), time(at).alias("t"), F.lit(FACT).alias("kind"), F.lit(None).cast(v.schema["end"].dataType).alias("end"), F.lit(None).cast(value_type).alias("value"), fact.alias("fact"))
    order = ["e", "t", "kind", "value"]
    dealt = v.unionByName(f).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    # written: slices follow from a sample and have to be the same in all that comes
    swept = kept_table(_swept(dealt), "as-of-facts")
    of = lambda kind: swept.where(F.col("kind") == kind)
    entering = F.broadcast(of(FIRST).select(F.col("slice").alias("into"), F.col("e").alias("into_e"), F.col("t").alias("into_t")))
    carried = of(VERSION).join(entering, (F.col("into") > F.col("slice")) & (F.col("e") == F.col("into_e")) & (F.col("end").isNull() | (F.col("end") > F.col("into_t"))))
    carried = carried.select("e", "t", "kind", "end", "value", "fact", F.col("into").alias("slice"))
    late = _swept(of(FACT).unionByName(carried).repartition("slice").sortWithinPartitions("slice", *order))
    met = of(DONE).unionByName(late.where(F.col("kind").isin(FACT, DONE)))
    return met.select("fact.*", *(F.col(f"value.{p}").alias(p) for p in payload))


#: Rows of a sweep: versions (that come, or are left on the stack), facts (that come, or that an earlier slice may still
#: meet), facts that are done, and the first row of a slice.
VERSION, FACT, DONE, FIRST = range(4)
#: An end that doesn't come.
NEVER = np.iinfo(np.int64).max


def _swept(rows: DataFrame) -> DataFrame:
    """Rows of all four kinds (e, t, kind, end, value, fact, slice) from sorted versions and facts: one pass over each
    partition with a stack of versions, which works batch by batch on whole columns."""
    columns = ["e", "t", "kind", "end", "value", "fact", "slice"]
    table = partial(pa.RecordBatch.from_arrays, names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, stack, still_first = None, None, None, True
        for batch in (b for b in batches if b.num_rows):
            e, t, kind, _, _, fact, at = batch.columns
            begins = np.concatenate(([True], _differs(e) | _differs(at)))
            goes_on = own == (at[0].as_py(), e[0].as_py())
            still_first = first is None or (still_first and goes_on)
            first = first if first is not None else batch.slice(0, 1)
            segment = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
            is_version = kind.to_numpy() == VERSION
            known, facts = batch.take(pa.array(np.flatnonzero(is_version))), np.flatnonzero(~is_version)
            held = stack.num_rows if goes_on else 0
            if held:
                known = table([pa.concat_arrays(x) for x in zip(stack.columns, known.columns, strict=True)])
            ends, times = _comparable(known.column(3), t)

            # versions before each fact, and before its entity; those of the stack belong to the batch's first entity
            before = np.cumsum(is_version) - is_version
            met = _last_above(ends[held:], before[segment[facts]], before[facts], times[facts]) + held
            below = np.flatnonzero((met < before[segment[facts]] + held) & (segment[facts] == 0))
            met[met < before[segment[facts]] + held] = -1
            met[below] = held - np.searchsorted(ends[:held][::-1], times[facts[below]], side="right") - 1
            met[~t.is_valid().to_numpy(zero_copy_only=False)[facts]] = -1
            unmet = (met < 0) & (segment[facts] == 0) & still_first
            pick = lambda x, places, none: x.take(pa.array(places, pa.int64(), mask=none))
            kinds = pa.array(np.where(unmet, FACT, DONE), pa.int32())
            yield table([pick(e, facts, ~unmet), pick(t, facts, ~unmet), kinds, pa.nulls(len(facts), t.type), pick(known.column(4), met, met < 0), pick(fact, facts, None), pick(at, facts, None)])

            own, last = (at[-1].as_py(), e[-1].as_py()), segment[-1]
            low = held + before[last] if last else 0
            stays = np.append(ends[low:], times[-1] if t[-1].is_valid else np.iinfo(np.int64).min)
            stays = stays[:-1] > np.maximum.accumulate(stays[::-1])[::-1][1:]
            stack = known.take(pa.array(low + np.flatnonzero(stays)))
        if first is not None:
            yield table(stack.columns)
            yield table([*first.columns[:2], pa.array([FIRST], pa.int32()), *first.columns[3:5], pa.nulls(1, first.column(5).type), first.column(6)])

    return rows.select(columns).mapInArrow(run, T.StructType([T.StructField(c, rows.schema[c].dataType) for c in columns]))


def _differs(x: pa.Array) -> np.ndarray:
    """Whether each item but the first differs from the one before; nulls do."""
    if pa.types.is_nested(x.type):
        items = x.to_pylist()
        return np.array([a != b for a, b in pairwise(items)], bool)
    return pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)


def _comparable(ends: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both as whole numbers in one order: dates and timestamps as they are stored, all else by rank; null ends are NEVER."""
    if pa.types.is_date32(ends.type) or pa.types.is_timestamp(ends.type):
        stored = pa.int32() if pa.types.is_date32(ends.type) else pa.int64()
        both = [x.view(stored).cast(pa.int64()) for x in (ends, times)]
    else:
        ranks = pc.rank(pa.concat_arrays([ends, times]), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").cast(pa.int64())
        both = [ranks[: len(ends)], ranks[len(ends) :]]
    ends_known = ends.is_valid().to_numpy(zero_copy_only=False)
    return np.where(ends_known, both[0].fill_null(0).to_numpy(zero_copy_only=False), NEVER), both[1].fill_null(0).to_numpy(zero_copy_only=False)


def _last_above(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row the last place in [low, high) whose value is above ``least``; low - 1 if there is none.

    By maxima over the 2, 4, 8 ... values up to a place: each row steps down over the longest stretches without one.
    """
    high, longest = high.astype(np.int64), int((high - low).max(initial=0)).bit_length()
    maxima = [values]
    for k in range(longest - 1):
        wide = maxima[-1].copy()
        wide[1 << k :] = np.maximum(wide[1 << k :], maxima[-1][: -(1 << k)])
        maxima.append(wide)
    for k in reversed(range(longest)):
        goes = np.flatnonzero(high - low >= 1 << k)
        goes = goes[maxima[k][high[goes] - 1] <= least[goes]]
        high[goes] -= 1 << k
    return high - 1


def closed_intervals(rows: DataFrame, entity: str, start: str, tie: str) -> DataFrame:
    """Versions from events: each is valid until the entity's next start; the last one is open."""
    return rows.withColumn("valid_until", F.lead(start).over(Window.partitionBy(entity).orderBy(start, tie)))


def append_versions(versions: DataFrame, new: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Adds versions (same columns, end null): open versions of the entities in ``new`` end where the new ones start."""
    closing = new.groupBy(entity).agg(F.min(start).alias("_closes"))
    closed = versions.join(closing, entity, "left").withColumn(end, F.when(F.col(end).isNull(), F.col("_closes")).otherwise(F.col(end))).drop("_closes")
    return closed.unionByName(new.select(*versions.columns))


def first_and_last(versions: DataFrame, entity: str, start: str, payload: str) -> DataFrame:
    """Payload of the first and the last version of each entity."""
    return versions.groupBy(entity).agg(F.min_by(payload, F.struct(start, payload)).alias("first"), F.max_by(payload, F.struct(start, payload)).alias("last"))


def lookup(provisions: DataFrame, **levels) -> DataFrame:
    """Rows whose levels equal the given ones exactly: a level given as None must be absent."""
    for name, value in levels.items():
        provisions = provisions.where(F.col(name).eqNullSafe(F.lit(value)))
    return provisions


def number_range(rows: DataFrame, group: str, number: str, low: int, high: int, tie: list, most: int = 20) -> DataFrame:
    """The first row of each number in [low, high] by group, ``most`` numbers at most, with truncated on all rows of a cut group."""
    one = rows.where(F.col(number).between(low, high)).withColumn("_r", F.row_number().over(Window.partitionBy(group, number).orderBy(*tie))).where("_r = 1").drop("_r")
    inside = Window.partitionBy(group).orderBy(number)
    counted = one.select("*", F.row_number().over(inside).alias("_place"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    return counted.where(F.col("_place") <= most).withColumn("truncated", F.col("_n") > most).drop("_place", "_n")


def equals_where_given(**wanted) -> Column:
    """The conjunction of equality predicates of those arguments that aren't None."""
    found = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            found = found & (F.col(name) == F.lit(value))
    return found


def resolve_references(refs: DataFrame, catalogue: DataFrame, slug: str, key: str) -> DataFrame:
    """Each reference with the catalogue's key: that equal to its slug, else the least one that ends in its number and year, else null.

    Two equi-joins: the second, on number and year, takes only what the first has left. Against an empty catalogue every
    reference keeps its slug.
    """
    ending = lambda c: F.regexp_extract(c, r"(\d+-\d{4})$", 1)
    known = catalogue.select(F.col(key).alias("_exact")).distinct()
    by_ending = catalogue.where(ending(F.col(key)) != "").groupBy(ending(F.col(key)).alias("_ending")).agg(F.min(key).alias("_like"))
    exact = refs.join(known, F.col(slug) == F.col("_exact"), "left")
    open_ending = F.when(F.col("_exact").isNull(), F.nullif(ending(F.col(slug)), F.lit("")))
    nothing = F.broadcast(catalogue.limit(1).agg((F.count("*") == 0).alias("_nothing")))
    found = exact.withColumn("_open", open_ending).join(by_ending, F.col("_open") == F.col("_ending"), "left").join(nothing)
    return found.withColumn(key, F.coalesce("_exact", "_like", F.when(F.col("_nothing"), F.col(slug)))).drop("_exact", "_open", "_ending", "_like", "_nothing")


def provisions_in_force(provisions: DataFrame, versions: DataFrame, norms: DataFrame, norm: str, provision: str, start: str, end: str, at: Column | None = None) -> DataFrame:
    """Provisions with their version in force (at a time, or the open one) and, where there is one, their norm.

    provisions: norm, provision ...; versions: provision, start, end ...; norms: norm .... A provision without such a
    version goes, one without a norm stays. Of versions that overlap the newest start counts.
    """
    valid = F.col(end).isNull() if at is None else (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))
    rest = [c for c in versions.columns if c not in (provision, start)]
    live = versions.where(valid).groupBy(provision).agg(F.max(F.struct(start, *rest)).alias("_v")).select(provision, "_v.*")
    return provisions.join(live, provision).join(norms, norm, "left")


def with_existence(rows: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a flag: whether ``others`` has a row of the same key, however many."""
    known = others.select(F.col(key).alias("_known")).where("_known is not null").distinct()
    return rows.join(known, F.col(key) == F.col("_known"), "left").withColumn(name, F.col("_known").isNotNull()).drop("_known")


def last_in_order(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows, in ascending order."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def compared_versions(versions: DataFrame, entity: str, start: str, end: str, text: str, first: Column | None = None, second: Column | None = None) -> DataFrame:
    """(entity, old, new): the versions valid at two times; without times, the first and the last by start."""
    if first is None or second is None:
        return first_and_last(versions, entity, start, text).select(entity, F.col("first").alias("old"), F.col("last").alias("new"))
    old, new = (valid_at(versions, entity, start, end, at, [text]).select(entity, F.col(text).alias(name)) for at, name in ((first, "old"), (second, "new")))
    return old.join(new, entity)
