"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_side

GRAIN = 2**30
#: Groups whose sizes are broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 100_000


def bounded_sample(df: DataFrame, id_col: str, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), drawn evenly by the hash of the id; the same ones each time."""
    share = int(min(1.0, rows / max(1, df.count())) * GRAIN)
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(GRAIN)) < share)


def sample_by_group(df: DataFrame, id_col: str, group_col: str, rows: int, least: int, salt: str) -> DataFrame:
    """About ``rows`` rows of ``df``, as many of each group (``least`` or more, all of a smaller one), by the hash of the id."""
    sizes = df.groupBy(F.col(group_col).alias("s_group")).agg(F.count("*").alias("s_n"))
    quota = max(least, rows // max(1, sizes.count()))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(GRAIN)) < F.lit(quota * GRAIN) / F.col("s_n")
    return df.join(small_side(sizes, BROADCAST_GROUPS), F.col(group_col) == F.col("s_group")).where(drawn).select(*df.columns)
