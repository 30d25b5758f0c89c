"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, runs of other visible characters) and pairs of neighbouring tokens (the last one
paired with the end of the text) hash into a fixed number of buckets. Two multinomials over these buckets, one of trusted documents and one of the whole corpus,
give each bucket a log ratio; a document's score is the mean ratio over its n-grams. A document is kept if no base
rule fails and its score reaches the threshold: no draw is involved, every document is judged alike.

Everything is a DataFrame expression. Texts are read to count buckets, to add up ratios and for the base counts; n-grams
are exploded, so that hashing and adding stay in compiled code, and pre-aggregated before anything moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aside, scratch, settled, small_side, written

#: Buckets of hashed n-grams (a power of two): the model has so many numbers, whatever the corpus. Their unit: a millionth.
BUCKETS, SCALE = 8192, 1_000_000
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
#: So many trusted ids at most are broadcast (16 MB or so); more are joined by shuffling.
BROADCAST_IDS = 500_000

WHITE = r"[\x20\x09-\x0D]+"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the text (all 0 for null).

    n_repeat_words counts the words that lie in some five-word window found at least twice in the text. Windows are
    compared by their 64-bit hash: sorting (hash, position) brings equal ones together, the positions of those with
    an equal neighbour are sorted again, and each covers the words up to the next, five at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = (
        docs.withColumn("_q_text", text)
        .withColumn("_q_words", F.filter(F.split("_q_text", WHITE), lambda x: x != ""))
        .withColumn("n_words", F.size("_q_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_q_words", "")).cast("long"))
        .withColumn("n_symbols", (F.size(F.split("_q_text", "[#*$%&|<>]")) - 1).cast("long"))
        .withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
        .withColumn("_q_hashes", F.transform("_q_words", lambda x: F.xxhash64(x)))
        .withColumn("_q_windows", F.expr("""if(n_words < 5, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 5),
            i -> xxhash64(_q_hashes[i], _q_hashes[i + 1], _q_hashes[i + 2], _q_hashes[i + 3], _q_hashes[i + 4])))"""))
        .withColumn("_q_unlike", F.size(F.array_distinct("_q_windows")) == F.size("_q_windows"))
        .withColumn("_q_sorted", F.expr("if(_q_unlike, null, sort_array(transform(_q_windows, (h, i) -> struct(h as h, i as i))))"))
        .withColumn("_q_twice", F.expr("""sort_array(transform(filter(_q_sorted,
            (x, k) -> x.h <=> get(_q_sorted, k - 1).h or x.h <=> get(_q_sorted, k + 1).h), x -> x.i))"""))
        .withColumn("n_repeat_words", F.expr("""coalesce(aggregate(_q_twice, struct(0L as n, -5 as last),
            (a, i) -> struct(a.n + least(5, i - a.last) as n, i as last), a -> a.n), 0L)"""))
    )
    return counted.drop("_q_text", "_q_words", "_q_hashes", "_q_lines", "_q_windows", "_q_unlike", "_q_sorted", "_q_twice")


def tokens(text: F.Column) -> F.Column:
    """Runs of letters and digits, and runs of other visible characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), 0)


def exploded_buckets(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """A row for each token of ``docs``: ``keep``, single and pair, the buckets of the token and of it with the next one.

    Of the last token, pair is that of the token with the end of the text. Only built-in functions without lambdas.
    """
    found = docs.select(*keep, tokens(F.col(text_col)).alias("found"))
    zipped = F.arrays_zip(F.col("found").alias("token"), F.slice("found", F.lit(2), F.greatest(F.size("found"), F.lit(1))).alias("next"))
    bucket = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    rows = found.select(*keep, F.explode(zipped).alias("gram"))
    return rows.select(*keep, bucket("gram.token").alias("single"), bucket(F.lit(1), "gram.token", "gram.next").alias("pair"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, ratio): log of a bucket's share in trusted documents over its share in all, both smoothed, in millionths.

    ``trusted`` has the ids of the trusted documents in ``id_col``. Counts cover every document. There is a row for each
    bucket that some document has, at most BUCKETS. Without any trusted text all ratios are 0.
    """
    ids = small_side(trusted.select(F.col(id_col).alias("t_id")).where("t_id is not null").distinct().withColumn("t_trusted", F.lit(True)), BROADCAST_IDS)
    marked = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")).join(ids, F.col("d_id") == F.col("t_id"), "left").withColumn("t_trusted", F.coalesce("t_trusted", F.lit(False)))
    counts = (
        exploded_buckets(marked, "d_text", "t_trusted")
        .select("t_trusted", F.explode(F.array("single", "pair")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count_if("t_trusted").alias("t"))
    )
    counts = written(counts, "bucket-counts")
    totals = counts.agg((F.sum("n") + BUCKETS / 2).alias("all_n"), (F.sum("t") + BUCKETS / 2).alias("all_t"))
    ratio = F.log((F.col("t") + 0.5) / F.col("all_t")) - F.log((F.col("n") + 0.5) / F.col("all_n"))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.when(F.col("all_t") == BUCKETS / 2, F.lit(0)).otherwise(F.round(ratio * SCALE)).cast("long").alias("ratio"))


def mean_ratios(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """(m_id, m_key, llr) of the documents ``docs`` (own_id, own_key, own_text) with a token: the mean ratio of their n-grams.

    Ratios are whole numbers, so the sum doesn't depend on the order of rows. Repeated rows don't change a mean.
    """
    table = F.broadcast(ratios)  # BUCKETS rows at most
    one, two = (table.select(F.col("bucket").alias(f"{x}_bucket"), F.col("ratio").alias(f"{x}_ratio")) for x in ("one", "two"))
    rows = exploded_buckets(docs, "own_text", "own_id", "own_key").join(F.broadcast(one), F.col("single") == F.col("one_bucket")).join(F.broadcast(two), F.col("pair") == F.col("two_bucket"))
    sums = rows.groupBy(F.col("own_id").alias("m_id"), F.col("own_key").alias("m_key")).agg(F.sum(F.col("one_ratio") + F.col("two_ratio")).alias("total"), F.count("*").alias("n"))
    return sums.select("m_id", "m_key", (F.col("total") / (2 * SCALE * F.col("n"))).alias("llr"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns but those of equal name) with the base counts, base_failed, llr and kept.

    base_failed: fewer than 10 words, or over a fifth of the words repeat in five-word windows. llr: mean log ratio
    of the text's n-grams, 0 for a text without any. kept: not base_failed and llr >= threshold.

    Null texts count as empty: they fail the base rules. All words of a text count, however long it is. Repeated rows and null ids are judged each by its own text
    (a null id is never trusted). Empty ``docs`` give no rows; empty ``trusted`` gives llr 0. Columns of any other name
    stay as they are.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept, back = aside(docs.drop(*(x for x in made if x not in (id_col, text_col))), own_id=id_col, own_text=text_col)
    kept = kept.withColumn("own_key", F.xxhash64("own_text"))
    with scratch(docs.sparkSession):
        ratios = settled(log_ratios(kept, trusted.select(F.col(id_col).alias("own_id")), "own_id", "own_text"), "bucket-ratios")
    means = mean_ratios(kept.select("own_id", "own_key", "own_text"), ratios)
    scored = (
        base_counts(kept, "own_text")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .join(means, F.col("own_id").eqNullSafe(F.col("m_id")) & F.col("own_key").eqNullSafe(F.col("m_key")), "left")
        .withColumn("llr", F.coalesce("llr", F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )
    return scored.select(*back, *made)
