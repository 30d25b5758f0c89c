"""Tables in the folder that driver and executors share, and the scopes that remove them."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import new_folder

_scopes = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def folders(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what ``kept_table`` made inside; ``result_table`` passes its folder to the scope around it."""
    made: list[str] = []
    _open().append(made)
    try:
        yield
    finally:
        _open().remove(made)
        for path in made:
            remove(spark, path)


def _stored(df: DataFrame, name: str, scopes: list[list[str]]) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table, read back: cuts lineage, survives lost executors."""
    return _stored(df, name, _open())


def result_table(df: DataFrame, name: str) -> DataFrame:
    """As ``kept_table``, for the result of a ``folders`` scope: the table outlives the scope."""
    return _stored(df, name, _open()[:-1])
