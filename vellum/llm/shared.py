"""Helpers that the operators of this subpackage share: shared storage, checked broadcasts, identifiers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master (tests on one machine) a temporary folder is made where the session names none, and kept in
    the session; elsewhere a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.vellum.local.shared", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.vellum.local.shared", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str, scoped: bool = False) -> str:
    """A path of its own below the shared folder; a ``scoped`` one is deleted at the end of the innermost ``scratch``."""
    path = f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
    if scoped and _open_scopes():
        _open_scopes()[-1].append(path)
    return path


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``new_path`` named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` made inside; ``settled`` ones pass to the scope around it."""
    made: list[str] = []
    _open_scopes().append(made)
    try:
        yield
    finally:
        _open_scopes().remove(made)
        for path in made:
            remove(spark, path)


def _stored(df: DataFrame, name: str, scopes: list[list[str]]) -> DataFrame:
    path = new_path(df.sparkSession, name)
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    return _stored(df, name, _open_scopes())


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for the result of a ``scratch`` scope: the table outlives the scope."""
    return _stored(df, name, _open_scopes()[:-1])


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``max_rows`` rows; beyond that unchanged, so that joins shuffle.

    The check is a count of its own, stopped by the limit after ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def aside(df: DataFrame, **used: str) -> tuple[DataFrame, list]:
    """``df`` with the columns ``used`` under their keywords and all others under names like ``aside_3``, and the way back.

    What an operator then adds can't clash with a column of its input, whatever that is called. The way back is a list
    of columns for ``select``.
    """
    names = {c: k for k, c in used.items()} | {c: f"aside_{i}" for i, c in enumerate(df.columns) if c not in used.values()}
    return df.toDF(*(names[c] for c in df.columns)), [F.col(names[c]).alias(c) for c in df.columns]


def crc_bucket(doc_id: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``: which fold a row belongs to."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(buckets))


#: A-Z and a-z for translate(): ASCII-only lower case, so that results don't depend on Unicode tables.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
