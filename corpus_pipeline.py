"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; further columns of the input, whatever their names, come
through unchanged. A stage on an empty table gives an empty table. Ids may be null and may repeat: a row is told from
others by its id and its text, so what befalls one text of an id doesn't touch another. All stages take texts whole,
however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontaminate import decontaminate
from vellum.llm.jaccard_join import near_duplicates
from vellum.llm.language_id import UNKNOWN, identify_held_out
from vellum.llm.line_dedup import dedup_lines
from vellum.llm.queries import piece_model
from vellum.llm.sentencepiece_codec import encode_decode
from vellum.llm.shared import scratch, settled, written

#: Share that a document's main language must have.
MAIN_SHARE = 0.5
#: The columns that stages use.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with all columns that no stage uses under names of no meaning, and the columns as they were."""
    names = [c if c in USED else f"unused_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: texts without a letter, and those without a main language, go.

    Null and empty texts have no letter and go. Rows are judged each by its text, so repeated rows stay or go together;
    rows with a null id are judged too, but nothing is learned from them. Where no row has a language all rows go.
    """
    plain, back = _plain(docs)
    return identify_held_out(plain).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MAIN_SHARE)).select(*back)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sources stay at their first place only; n_chars follows the text.

    All rows stay, with the text that is left, which may be empty; null texts stay null, with n_chars null. Null sources
    count for no source, null ids are never the first place. Repeated rows are treated alike.
    """
    plain, back = _plain(docs)
    return dedup_lines(plain).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*back)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by shingle overlap, directly or through others.

    The row of least id stays, a null id coming last; of several texts of that id that of least hash, of exact repeats
    one row, that whose other columns, of whatever types, come first as JSON. Documents without words are in no group: all
    stay. Texts of any length count whole.
    """
    plain, back = _plain(docs)
    with scratch(spark):
        texts = written(near_duplicates(plain).where("component_key is not null").groupBy("component_key", "doc_id", "text_key").agg(F.count("*").alias("n")), "grouped-texts")
        first = texts.groupBy(F.col("component_key").alias("f_key")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
        marked = texts.join(first, F.col("component_key") == F.col("f_key")).select(F.col("doc_id").alias("g_id"), "text_key", "n", stays.alias("stays"))
        marked = settled(marked.where("not stays or n > 1"), "near-duplicates-or-repeated")
    mine = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("text_key"))
    single = plain.join(marked, mine, "left_anti")
    repeated = plain.join(marked.where("stays"), mine, "left_semi")
    others = [c for c in plain.columns if c not in ("doc_id", "text")]
    whole = F.struct(*others)
    one = repeated.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("rest")).select("doc_id", "text", "rest.*")
    return single.unionByName(one).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and wordless texts hold none and stay. Rows are judged each by its text: repeated rows stay or go together, and
    null ids don't matter.
    """
    plain, back = _plain(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(plain, benchmark).where(~F.col("contaminated")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with what they decode to compared with the text itself: piece_ids, n_tokens, round_trip.

    All rows stay; null texts encode as empty ones. Columns of these three names are replaced.
    """
    plain, back = _plain(docs.drop("piece_ids", "n_tokens", "round_trip"))
    coded = encode_decode(plain, piece_model())
    return coded.select(*back, "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: Language identification and similarity components are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote is removed when the next one is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
