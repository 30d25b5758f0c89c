"""Benchmark decontamination by winnowing.

Words are hashed in runs of ``K``; of every ``W`` consecutive run hashes the smallest is a fingerprint. ``K + W - 1``
equals the window of ten words, so each ten-word window that a document shares with the benchmark holds a
fingerprint that both sides choose, at the same place in the window: the join of fingerprints misses no shared window.
Each hit is extended to the whole window at that alignment by comparing the hashes of its two halves. Benchmark items
with fewer words than a window are joined by the hash of their first word, then compared word by word.

Only DataFrame expressions are used. Documents are exploded into fingerprints (two of seven words) beside the run
hashes around each; nothing else of a document is moved before the join has thrown out what doesn't match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, aside, scratch, settled, small_side, written

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: Up to so many distinct benchmark windows (about 50 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_WINDOWS = 300_000

#: What stands between words, before and after lower-casing.
BETWEEN_ANY, BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: F.Column) -> F.Column:
    """The words of a text in order, A-Z lower-cased; none for null."""
    given = F.coalesce(text, F.lit(""))
    # lower() does the same as translate(), and faster, where all is ASCII
    lowered = F.when(F.octet_length(given) == F.length(given), F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def word_hashes(text: F.Column) -> F.Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def word_count(text: F.Column) -> F.Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY), "")).cast("long")


def _run_hashes(words_col: str, n: int) -> str:
    """SQL for the array of hashes of every ``n`` consecutive word hashes; empty if there are fewer."""
    args = ", ".join(f"{words_col}[i + {j}]" if j else f"{words_col}[i]" for j in range(n))
    return f"if(size({words_col}) < {n}, cast(array() as array<bigint>), transform(sequence(0, size({words_col}) - {n}), i -> xxhash64({n}, {args})))"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of each item: (item, len, hash, left and right half, fingerprint, its offset in the window, whole).

    An item shorter than a window has one row, without fingerprint, with the hashes of all its words in ``whole``. Items
    without words have none.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    lowest = ", ".join(f"k[i + {j}]" for j in range(W))
    full = (
        items.where(f"size(w) >= {WINDOW}")
        .select("item", F.expr(_run_hashes("w", K)).alias("k"))
        .select("item", F.explode(F.expr(f"""transform(sequence(0, size(k) - {W}), i -> struct({WINDOW} as len, xxhash64(k[i], k[i + {K}]) as hash,
            k[i] as left, k[i + {K}] as right, least({lowest}) as fp, cast(array_position(slice(k, i + 1, {W}), least({lowest})) as int) - 1 as off))""")).alias("x"))
        .select("item", "x.*", F.lit(None).cast("array<bigint>").alias("whole"))
    )
    whole = " ".join(f"when {n} then xxhash64({n}, {', '.join(f'w[{j}]' for j in range(n))})" for n in range(1, WINDOW))
    short = items.where(f"size(w) < {WINDOW}").select("item", F.size("w").alias("len"), F.expr(f"case size(w) {whole} end").alias("hash"), *(F.lit(None).cast("bigint").alias(x) for x in ("left", "right", "fp")), F.lit(None).cast("int").alias("off"), F.col("w").alias("whole"))
    return full.unionByName(short)


def contaminated_spans(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(d_id, d_key, start, len, hash) of every place in ``docs`` (d_id, d_key, w) where a benchmark window occurs."""
    distinct = windows.drop("item").distinct()
    full = small_side(distinct.where("fp is not null").drop("len", "whole"), BROADCAST_WINDOWS)
    # a position is chosen if its hash is the least of some window of W hashes: the greatest of the least values around it
    least = ", ".join(f"k[i + {j}]" for j in range(W))
    around = ", ".join(f"get(m, i - {j})" for j in range(W))
    # no filter on the words: it would be pushed below them and compute them twice; too short a text has no m
    marked = (
        docs.select("d_id", "d_key", F.expr(_run_hashes("w", K)).alias("k"))
        .withColumn("m", F.expr(f"if(size(k) < {W}, null, transform(sequence(0, size(k) - {W}), i -> least({least})))"))
        .select("d_id", "d_key", F.explode(F.expr(f"""
            transform(filter(if(m is null, null, sequence(0, size(k) - 1)), i -> k[i] = greatest({around})),
                i -> struct(i as at, k[i] as fp, greatest(0, i - {K}) as begin, slice(k, greatest(0, i - {K}) + 1, {WINDOW + 1}) as near))""")).alias("x"))
        .select("d_id", "d_key", "x.at", F.col("x.fp").alias("d_fp"), "x.begin", "x.near")
    )
    # the window begins `off` before the hit: both its halves must be the item's
    same = F.expr(f"get(near, at - off - begin) = left and get(near, at - off - begin + {K}) = right")
    found = marked.join(full, (F.col("d_fp") == F.col("fp")) & same).select("d_id", "d_key", (F.col("at") - F.col("off")).alias("start"), F.lit(WINDOW).alias("len"), "hash")
    short = distinct.where("fp is null").select("hash", "len", "whole", F.get("whole", F.lit(0)).alias("first"))
    if short.limit(1).count():
        # short items of all lengths in one pass: a word that begins an item, then all of the item's words
        runs = docs.select("d_id", "d_key", "w", F.posexplode("w").alias("start", "d_first"))
        at = (F.col("d_first") == F.col("first")) & (F.slice("w", F.col("start") + 1, F.col("len")) == F.col("whole"))
        found = found.unionByName(runs.join(small_side(short, BROADCAST_WINDOWS), at).select("d_id", "d_key", "start", "len", "hash"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted item ids as strings), items_sha256 and contaminated.

    A window is ten consecutive words of an item (a shorter item is one window); n_hit counts the document's words
    that lie in an occurrence of some window. Columns of ``docs`` with these names are replaced.

    Null and wordless texts have no words and no hits; null, wordless and id-less items have no windows. Repeated
    rows (same id, same text) each get the result; rows of one id with different texts are told apart. Equal and
    overlapping items all count. Texts of any length are searched whole, from the first word to the last. Empty tables on
    either side give no hits.
    """
    made = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    kept, back = aside(docs.drop(*(x for x in made if x not in (id_col, text_col))), own_id=id_col, own_text=text_col)
    windows = benchmark_windows(benchmark)
    kept = kept.withColumn("own_key", F.xxhash64("own_text"))
    parts = kept.select(F.col("own_id").alias("d_id"), F.col("own_key").alias("d_key"), word_hashes(F.col("own_text")).alias("w"))
    with scratch(docs.sparkSession):
        hits = settled(_hits(written(contaminated_spans(parts, windows), "contaminated-spans"), windows), "contaminated-documents")  # few rows: those that match
    return (
        kept.withColumn("n_words", word_count(F.col("own_text")))
        .join(hits, F.col("own_id").eqNullSafe(F.col("d_id")) & (F.col("own_key") == F.col("d_key")), "left")
        .select(
            *back,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def _hits(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(d_id, d_key, n_hit, items) of each document that holds a window."""
    by_doc = spans.groupBy("d_id", "d_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("spans"))
    covered = F.expr("aggregate(spans, struct(0L as n, 0 as stop), (a, s) -> struct(a.n + greatest(0, s.stop - greatest(s.start, a.stop)) as n, greatest(a.stop, s.stop) as stop), a -> a.n)")
    of_item = small_side(windows.select(F.col("hash").alias("i_hash"), F.col("len").alias("i_len"), "item").distinct(), BROADCAST_WINDOWS)
    items = (
        spans.select("d_id", "d_key", "len", "hash")
        .distinct()
        .join(of_item, (F.col("hash") == F.col("i_hash")) & (F.col("len") == F.col("i_len")))
        .groupBy("d_id", "d_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumnsRenamed({"d_id": "i_id", "d_key": "i_key"})
    )
    same = F.col("d_id").eqNullSafe(F.col("i_id")) & (F.col("d_key") == F.col("i_key"))
    return by_doc.select("d_id", "d_key", covered.alias("n_hit")).join(items, same, "left").select("d_id", "d_key", "n_hit", "items")
