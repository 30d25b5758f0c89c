"""Catalogue files: CSV with quoted line breaks, JSON lines, and the cleaning of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_or_null, fold, positive_code
from ..operators.dedupe import keep_first


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of ``;``-separated files with a header, doubled quotes and line breaks in quotes; all columns as text.

    A header without the expected columns raises; rows of another number of fields are left out.
    """
    found = [c.lstrip("﻿") for c in spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"').columns]
    if [c for c in columns if c not in found]:
        raise ValueError(f"{path} lacks columns {[c for c in columns if c not in found]}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in found), T.StructField("_corrupt", T.StringType())])
    rows = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"', schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    return rows.where(F.col("_corrupt").isNull()).select(*columns)


def items(rows: DataFrame, kind: str, code: str, description: str, group: str, repairs: dict[str, str] | None = None) -> DataFrame:
    """Catalogue items: id ``cat-kind-code``, cleaned texts, group names repaired; rows without code or description go, repeated codes keep the first."""
    fix = F.create_map(*(F.lit(x) for pair in repairs.items() for x in pair)) if repairs else None
    name = clean_or_null(group)
    made = rows.select(positive_code(code).alias("code"), clean_or_null(description).alias("description"), (F.coalesce(fix[name], name) if fix is not None else name).alias("group"), F.monotonically_increasing_id().alias("_at"))
    valid = made.where(F.col("code").isNotNull() & F.col("description").isNotNull())
    return keep_first(valid, ["code"], ["_at"]).select(F.concat_ws("-", F.lit("cat"), F.lit(kind), F.col("code").cast("string")).alias("id"), "code", "description", "group")


def valid_class(c: Column) -> Column:
    """A class name that says something."""
    return c.isNotNull() & ~fold(F.trim(c)).isin("", "invalido", "n/a")


def embedding_text(description: str, pattern: str, group: str) -> Column:
    """What is embedded: description, pattern in parentheses, class in brackets if valid."""
    return F.concat_ws(" ", F.col(description), F.concat(F.lit("("), F.col(pattern), F.lit(")")), F.when(valid_class(F.col(group)), F.concat(F.lit("["), F.col(group), F.lit("]"))))


def write_json_shards(rows: DataFrame, path: str, most: int = 40_000) -> None:
    """JSON lines, ``most`` rows a file at most."""
    rows.write.option("maxRecordsPerFile", most).json(path)


def equal_counts(index: DataFrame, source: DataFrame) -> DataFrame:
    """One row: rows of the index, of its source, and whether they are as many."""
    return index.agg(F.count("*").alias("indexed")).join(F.broadcast(source.agg(F.count("*").alias("present")))).withColumn("complete", F.col("indexed") == F.col("present"))
