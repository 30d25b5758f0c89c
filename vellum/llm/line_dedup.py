"""Line dedup by distinct-site spread.

Every line that has a word counts for the sites (sources) on which it stands. A HyperLogLog sketch per line hash
estimates its spread; sketches of tasks merge by aggregation, so a line on a third of all rows costs one sketch a
task. Lines whose estimate is well above the threshold are boilerplate, lines well below are not, and those within
the sketch's error (three standard errors) get an exact distinct count. With thresholds in the tens sketches are all but
exact; with one in the thousands, a line further off than that is judged by its estimate, which is right with a
probability of about 0.997 a line. Of a boilerplate line the first occurrence (least document id, then
position) stays; all others are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aside, scratch, settled, written

#: Sites from which a line is boilerplate.
MIN_SITES = 10
#: What makes a line one with a word.
WORD = r"[^\x20\x09-\x0D]"
#: Log2 of the sketch's registers, and the relative error beyond which an estimate is trusted (three standard errors).
LG_K = 10
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def exploded_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row for each line with a word: l_id, l_key (hash of the text), site, at, line (hash)."""
    word = F.col("l_line").rlike(WORD)
    return (
        docs.select(F.col(id_col).alias("l_id"), F.xxhash64(F.col(text_col)).alias("l_key"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "l_line"))
        .where(word)
        .select("l_id", "l_key", "site", "at", F.xxhash64("l_line").alias("line"))
    )


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites, first) of lines on at least ``min_sites`` distinct sites; first is their first place (l_id, at).

    Lines of a null site count for no site.
    """
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"), F.min(F.when(F.col("l_id").isNotNull(), F.struct("l_id", "at"))).alias("first"), F.count("site").alias("n")
    )
    # fewer rows than sites asked for can't reach them: an exact way to leave out most lines early
    likely = written(spread.where((F.col("n") >= min_sites) & (F.col("about") >= min_sites * (1 - ERROR))), "line-spread")
    sure = likely.where(F.col("about") > min_sites * (1 + ERROR)).select("line", F.col("about").cast("long").alias("sites"), "first")
    near = likely.where(F.col("about") <= min_sites * (1 + ERROR))
    exact = (
        lines.where("site is not null")
        .select("line", "site")
        .distinct()
        .join(near.select(F.col("line").alias("n_line")), F.col("line") == F.col("n_line"), "left_semi")
        .groupBy("line")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .join(near.select(F.col("line").alias("n_line"), "first"), F.col("line") == F.col("n_line"))
        .select("line", "sites", "first")
    )
    return sure.unionByName(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, n_lines (with a word) and n_removed.

    Lines are compared as they are, byte for byte (64-bit hash); blank lines stay. A line is removed where it stands
    on ``min_sites`` sites or more, except at its first place: least id, then least line number.

    Null texts stay null (0 lines) and empty ones empty; null sites count for no site; rows with a null id are never
    the first place. Repeated rows (same id, same text) are treated alike. A text may become empty: the row stays. Texts
    of any length, and of any number of lines, count whole.
    An empty table gives no rows. Columns named n_lines or n_removed are replaced.
    """
    made = ("n_lines", "n_removed")
    kept, back = aside(docs.drop(*(x for x in made if x not in (id_col, text_col, site_col))), own_id=id_col, own_text=text_col, own_site=site_col)
    lines = exploded_lines(kept, "own_id", "own_text", "own_site")
    with scratch(docs.sparkSession):
        boiler = settled(boilerplate_lines(lines, min_sites).select(F.col("line").alias("b_line"), "first"), "boilerplate")
    gone = (
        lines.join(boiler, F.col("line") == F.col("b_line"))
        .where(~(F.col("l_id").eqNullSafe(F.col("first.l_id")) & (F.col("at") == F.col("first.at"))))
        .groupBy("l_id", "l_key")
        .agg(F.collect_set("at").alias("gone"))
    )
    text = F.col("own_text")
    lined = F.split(text, "\n")
    left = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lined) - 1), F.col("gone"))), lambda i: F.get(lined, i)), "\n")
    return (
        kept.withColumn("own_key", F.xxhash64(text))
        .join(gone, F.col("own_id").eqNullSafe(F.col("l_id")) & F.col("own_key").eqNullSafe(F.col("l_key")), "left")
        .withColumn("n_lines", F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(lined, lambda x: x.rlike(WORD)))).cast("long"))
        .withColumn("n_removed", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long"))
        .withColumn("own_text", F.when(F.col("gone").isNull(), text).otherwise(left))
        .select(*back, "n_lines", "n_removed")
    )
