"""Exact vector retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import folders, kept_table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one query vector among those that ``keep`` allows: (key, score, rank)."""
    rows = vectors.where(keep) if keep is not None else vectors
    scored = rows.select(key, F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


#: Queries, and rows, that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 4_096, 65_536


def nearest_to_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of each row of ``queries`` (same columns), itself left out: (query, key, score, rank).

    Queries and rows are dealt into blocks by the hash of their keys, and every block of queries meets every block of rows
    in a task of its own, which multiplies them as matrices and keeps the best ``k`` of each query. Nothing passes through
    the driver but two counts, and nothing is broadcast: a row is sent once for each block of queries, a query once for
    each block of rows, and k rows leave for each of both.

    Rows without a vector, or with a number missing in it, are near to nothing and find nothing. Vectors of unequal
    length are compared over the common one, as ``cosine`` does; norms are those of the common part.
    """
    kind, stored = dict(vectors.dtypes)[key], to_arrow_type(vectors.schema[key].dataType)
    schema = f"query {kind}, {key} {kind}, score double"
    whole = F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array()), lambda x: x.isNull())
    rows, asking = vectors.where(whole).select(key, vector), queries.where(whole).select(key, vector)
    n_rows, n_asking = (max(1, -(-df.count() // size)) for df, size in ((rows, row_block), (asking, query_block)))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select(dealt(n_asking).alias("b"), each(n_rows).alias("r"), key, vector).groupBy("b", "r")
    right = rows.select(each(n_asking).alias("b"), dealt(n_rows).alias("r"), key, vector).groupBy("b", "r")

    def best(some: pa.Table, others: pa.Table) -> pa.Table:
        found = [best_of(a, b, k) for a in matrices(some, stored) for b in matrices(others, stored)]
        columns = [pa.array(np.concatenate(x)) if found else pa.array([], stored) for x in (zip(*found, strict=True) if found else ((), (), ()))]
        return pa.Table.from_arrays([columns[0].cast(stored), columns[1].cast(stored), columns[2].cast(pa.float64())], names=["query", key, "score"])

    near = left.cogroup(right).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


#: Scores that are worked on at once.
SCORES = 4_000_000


def matrices(rows: pa.Table, stored: pa.DataType) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block (its last two columns), one matrix for each length of vector."""
    ids, vectors = rows.column(2).to_numpy(), rows.column(3).combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    found = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        found.append((ids[at], vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)))
    return found


def best_of(asking: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, score) of the best ``k`` of ``rows`` for each of the queries, equal scores by key."""
    (q_ids, q), (ids, v) = asking, rows
    n = min(q.shape[1], v.shape[1])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    order = np.argsort(ids, kind="stable")
    ids, v, q = ids[order], unit(v[order, :n]), unit(q[:, :n])
    found = []
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(q), step):
        some = q_ids[at : at + step]
        s = np.round(q[at : at + step] @ v.T, 6)
        s[some[:, None] == ids[None, :]] = -2
        first = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are in order: equal scores come by id
        score = np.take_along_axis(s, first, axis=1)
        real = score > -2
        found.append((np.broadcast_to(some[:, None], score.shape)[real], ids[first][real], score[real]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def valid_dimension(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """Adds valid: whether a vector is there and has ``size`` numbers, none of them missing or not a number."""
    v = F.col(vector)
    return vectors.withColumn("valid", F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False)))


#: Texts that an encoder gets at once.
ENCODED = 64


def fill_missing(rows: DataFrame, text: str, vector: str, encode, size: int, at_once: int = ENCODED) -> DataFrame:
    """``rows`` with the vectors that are missing made from their texts; those that are there stay, and aren't sent to the encoder.

    ``encode`` is a function of a list of texts that returns as many vectors of ``size`` finite numbers; anything else is an
    error. Rows without a text keep their null vector. The order of columns and their types stay.
    """
    missing = F.col(vector).isNull() & (F.coalesce(F.col(text), F.lit("")) != "")
    kind = to_arrow_type(rows.schema[vector].dataType)

    def vectors(texts: list[str]) -> pa.Array:
        found = np.asarray(encode(texts), np.float64)
        if found.shape != (len(texts), size) or not np.isfinite(found).all():
            raise ValueError(f"the encoder gave {found.shape} numbers for {len(texts)} texts, not {size} finite ones each")
        return pa.array(found.tolist(), kind)

    def run(texts: pa.Array) -> pa.Array:
        asked = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        made = [vectors(texts.take(pa.array(asked[i : i + at_once])).to_pylist()) for i in range(0, len(asked), at_once)]
        at = np.full(len(texts), -1)
        at[asked] = np.arange(len(asked))
        return pa.concat_arrays([*made, pa.array([], kind)]).take(pa.array(at, mask=at < 0))

    # only texts go to Python, and only numbers come back; no more than ``at_once`` texts are Python's at a time
    filled = F.coalesce(F.col(vector), arrow_udf(run, rows.schema[vector].dataType)(F.when(missing, F.col(text))))
    return rows.select(*(filled.alias(c) if c == vector else F.col(c) for c in rows.columns))


def fill_table(spark: SparkSession, path: str, folder: str, text: str, vector: str, encode, size: int) -> int:
    """Fills the missing vectors of a Parquet table dealt into folders by the column ``folder``; returns the number of folders touched.

    Only folders that hold a text without vector are read whole and replaced; what is made is written aside first, so that
    no folder is replaced by what is still read from it.
    """
    table = spark.read.parquet(path)
    touched = [r[0] for r in table.where(F.col(vector).isNull() & (F.coalesce(F.col(text), F.lit("")) != "")).select(folder).distinct().collect()]  # as many as there are folders, at most
    if touched:
        with folders(spark):
            filled = kept_table(fill_missing(table.where(F.col(folder).isin(touched)), text, vector, encode, size), "filled-vectors")
            filled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)
    return len(touched)
