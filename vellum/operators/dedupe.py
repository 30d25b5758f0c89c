"""Keeping one row of a key, and set operations by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in order; equal places are settled by the whole row. Aggregates, so hot keys combine early."""
    rest = [c for c in rows.columns if c not in order]
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(F.struct(*order, *rest)).alias("_row")).select(*(F.col(f"_row.{c}") for c in rows.columns))


def latest_wins(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert: of each key the row of the highest version, changes before current rows of the same version."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c != version]
    return both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.max(F.struct(version, "_new", *rest)).alias("_row")).select(*(F.col(f"_row.{c}") for c in current.columns))


def delete_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def confirmed(hits: DataFrame, rows: DataFrame, key: str, fresh: list[str]) -> DataFrame:
    """Hits whose key still exists, with the row's present columns in place of the hit's own."""
    stale = [c for c in fresh if c in hits.columns]
    return hits.drop(*stale).join(rows.select(key, *fresh), key)


def orphans(ids: DataFrame, rows: DataFrame, key: str, pattern: str | None = None) -> DataFrame:
    """Keys of ``ids`` that ``rows`` doesn't have (any more), of the given form only."""
    of_form = ids.where(F.col(key).cast("string").rlike(pattern)) if pattern else ids
    return of_form.select(key).distinct().join(rows.select(key), key, "left_anti")
