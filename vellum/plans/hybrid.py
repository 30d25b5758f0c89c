"""Composed retrieval plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fusion import fuse, rerank_all_or_nothing, rerank_first
from ..operators.lexical import expand_synonyms, query_tokens, scored, substring_tokens, token_table, top
from ..operators.vector import nearest

#: Rows that a lane, and the pool that is reranked, may have.
LANE = POOL = 20


def lexical_lanes(docs: DataFrame, key: str, text: str, query: str, lane: int = LANE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The token table of a query, and its two lanes (key, score, rank): by terms and by substrings. Texts are read once."""
    tokens, parts = query_tokens(query), substring_tokens(query)
    counts = token_table(docs, text, tokens, parts)
    lanes = [top(scored(counts, c, length, len(t)).select(key, F.round("score", 6).alias("score")), key, lane) for c, length, t in (("tf", "length", tokens), ("sf", "grams", parts))]
    return counts, *lanes


def hybrid(lanes: list[DataFrame], rows: DataFrame, key: str, payload: list[str], k: int) -> DataFrame:
    """Fuses ranked lanes, joins the present rows (hits that no longer exist go), drops those without text, cuts at ``k``.

    ``rows`` has key, payload and has_text. The lanes are a few rows each: the fused ids are broadcast.
    """
    fused = fuse(lanes, key)
    present = rows.where("has_text").select(key, *payload).join(F.broadcast(fused), key)
    best = present.orderBy(F.desc("rrf"), key).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf"), key)).cast("long"))


def clamp(k: int | None, default: int, most: int, least: int = 1) -> int:
    """A limit as asked for, or the default, between ``least`` and ``most``."""
    return max(least, min(default if k is None else k, most))


def two_way_search(docs: DataFrame, key: str, text: str, query: str, k: int | None = None) -> DataFrame:
    """Catalogue search without vectors: terms and substrings fused (key, rrf, n_lanes, place), up to ``k`` (20; 50 at most)."""
    counts, terms_lane, parts_lane = lexical_lanes(docs, key, text, query)
    return hybrid([terms_lane, parts_lane], counts, key, [], clamp(k, 20, 50)).select(key, "rrf", "n_lanes", "place")


def catalogue_search(docs: DataFrame, key: str, text: str, query: str, k: int | None = None) -> DataFrame:
    """Catalogue search with both lanes: rows with all terms, or, if there are none, with any of them or of their synonyms,
    fused with the substring lane: (key, rrf, n_lanes, place, mode), up to ``k`` (20; 50 at most).

    mode says whether all terms were found together. Texts are read once, for the terms of both ways.
    """
    wide, parts = query_tokens(expand_synonyms(query), "catalogue"), substring_tokens(query)
    n_strict = len(query_tokens(query, "catalogue"))  # the query's own terms come first
    counts = token_table(docs, text, wide, parts)
    strict = scored(counts, "tf", "length", n_strict, every=True)
    found = n_strict > 0 and not strict.isEmpty()
    by_terms = strict if found else scored(counts, "tf", "length", len(wide))
    by_parts = scored(counts, "sf", "grams", len(parts))
    lanes = [top(x.select(key, F.round("score", 6).alias("score")), key, LANE) for x in (by_terms, by_parts)]
    return hybrid(lanes, counts, key, [], clamp(k, 20, 50)).select(key, "rrf", "n_lanes", "place").withColumn("mode", F.lit("all" if found else "any"))


def law_search(docs: DataFrame, vectors: DataFrame, rerank: DataFrame, key: str, text: str, query: str, vector: list[float], k: int | None = None) -> DataFrame:
    """Law search: vector and term lanes of LANE rows, fused; rows without text go; POOL rows reranked; the best ``k`` (5; 20 at most).

    ``vectors`` has key and embedding, ``rerank`` key and rerank: a score for each candidate, or all by fusion.
    """
    counts = token_table(docs, text, query_tokens(query))
    by_terms = top(scored(counts, "tf", "length", len(query_tokens(query))).select(key, F.round("score", 6).alias("score")), key, LANE)
    pool = hybrid([nearest(vectors, key, "embedding", vector, LANE), by_terms], counts, key, [], POOL)
    return rerank_all_or_nothing(pool.join(rerank, key, "left"), key).where(F.col("place") <= clamp(k, 5, 20))


def ruling_search(rows: DataFrame, vectors: DataFrame, rerank: DataFrame, key: str, text: str, query: str, vector: list[float], k: int | None = None) -> DataFrame:
    """Ruling search: the LANE nearest rows with text, those with a rerank score first; queries of under three characters find nothing."""
    if len(query.strip()) < 3:
        return rows.where("false").select(key, F.lit(0.0).alias("rrf"), F.lit(0.0).alias("rerank"), F.lit(0).cast("long").alias("place"))
    near = nearest(vectors, key, "embedding", vector, LANE)
    present = rows.where(F.coalesce(F.col(text), F.lit("")) != "").join(F.broadcast(near.select(key, F.col("score").alias("rrf"))), key).select(key, "rrf")
    return rerank_first(present.join(rerank, key, "left"), key).where(F.col("place") <= clamp(k, 5, 20))
