"""Rank fusion, rerank policies and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(lanes: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: each lane has key and rank (from 1); a key's score is the sum of 1 / (k + rank)."""
    rows = reduce(DataFrame.unionByName, [lane.select(key, "rank") for lane in lanes])
    return rows.groupBy(key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("rrf"), F.count("*").alias("n_lanes"))


def first_payload(lanes: list[DataFrame], key: str, payload: list[str]) -> DataFrame:
    """One row for each key with the payload of the first lane that has it."""
    rows = reduce(DataFrame.unionByName, [lane.select(key, *payload).withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)])
    return rows.groupBy(key).agg(F.min_by(F.struct(*payload), "lane").alias("p")).select(key, "p.*")


#: Rows of a pool that rerank policies place; pools are what lanes of a few dozen rows leave.
POOL = 10_000


def placed(pool: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows in the given order, each with its place from 1; only these meet in one task."""
    return pool.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rerank_all_or_nothing(pool: DataFrame, key: str, least: float = 0.02, most: int = POOL) -> DataFrame:
    """Orders a pool (key, rrf, rerank) by rerank only if every key has one finite score; else all by rrf, without threshold.

    A key that has been scored twice makes the scores as useless as one that has none; it comes out once, with its
    greatest rrf. Rows below ``least`` go when the scores are used. Adds score, reranked and place; the first ``most`` stay.
    """
    finite = F.col("rerank").isNotNull() & ~F.isnan("rerank") & (F.abs("rerank") < float("inf"))
    keys = pool.groupBy(key).agg(F.max("rrf").alias("rrf"), F.max("rerank").alias("rerank"), ((F.count("*") == 1) & F.bool_and(finite)).alias("once"))
    usable = keys.agg(F.coalesce(F.bool_and("once"), F.lit(True)).alias("usable"))
    judged = keys.join(F.broadcast(usable)).withColumn("score", F.when(F.col("usable"), F.col("rerank")).otherwise(F.col("rrf")))
    kept = judged.where(~F.col("usable") | (F.col("rerank") >= least)).select(key, "rrf", "score", F.col("usable").alias("reranked"))
    return placed(kept, [F.desc("score"), F.col(key)], most)


def rerank_first(pool: DataFrame, key: str, most: int = POOL) -> DataFrame:
    """Rows with a rerank score first, best first; the rest in their rrf order; the first ``most`` of them."""
    order = [F.col("rerank").isNull(), F.col("rerank").desc_nulls_last(), F.desc("rrf"), F.col(key)]
    return placed(pool.select(key, "rrf", "rerank"), order, most)


def rerank_mixed(pool: DataFrame, key: str, most: int = POOL) -> DataFrame:
    """Rerank scores where there are any, rrf elsewhere, in one order (the scales differ: kept for comparison)."""
    return placed(pool.select(key, F.coalesce("rerank", "rrf").alias("score")), [F.desc("score"), F.col(key)], most)


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """``size`` rows from ``offset`` on in the given order, each with total, the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))
