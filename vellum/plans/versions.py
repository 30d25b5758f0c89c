"""Comparison of versions of one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parsing import diff_counts, word_diff
from ..operators.temporal import compared_versions


def version_differences(versions: DataFrame, entity: str, start: str, end: str, text: str, first: Column | None = None, second: Column | None = None) -> DataFrame:
    """(entity, old, new, diff, n_same, n_removed, n_added): two versions of each entity, how one becomes the other, and words of each class.

    The versions are those valid at two times, else the first and the last. Entities without both are left out where times
    are given; null texts count as empty.
    """
    pairs = compared_versions(versions, entity, start, end, text, first, second).withColumn("diff", word_diff(F.col("old"), F.col("new")))
    whole = pairs.withColumn("pair", F.struct(entity, "old", "new", "diff"))
    return diff_counts(whole, "pair", "diff").select("pair.*", "n_same", "n_removed", "n_added")
