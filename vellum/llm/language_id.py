"""Language identification by mixture inference.

Each language has a multinomial over hashed byte trigrams. A document's trigrams are taken as drawn from a mixture of
languages: expectation-maximisation, run until the proportions settle, estimates them. The set of languages grows
greedily from the likeliest single one; a further language stays only if it raises the log-likelihood by more than a
penalty that grows with the logarithm of the document's length. Nothing else bounds the set. The language of the largest
proportion is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample_by_group
from .sentencepiece_codec import slices
from .shared import crc_bucket

#: Documents from which the likelihoods are learned, about, and those of a language at least (all, if it has fewer).
SAMPLE_DOCS, LEAST_DOCS = 20_000, 200
#: Buckets of hashed trigrams; smoothing of counts.
BUCKETS = 2**15
SMOOTHING = 0.2
#: Penalty of a further language: so many times the log of the number of trigrams. EM ends when no proportion moves more.
PENALTY, SETTLED = 3.0, 1e-4
UNKNOWN = "und"

_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_ASCII = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a text has a character of the Unicode letter classes; numerals like ½, ② or Ⅷ are none."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def trigrams(text: str) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased text, runs of ASCII other than letters taken as one space."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_ASCII) + b"  ", np.uint8)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    if len(b) < 3:
        return np.empty(0, np.int64)
    x = b.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64)


class Mixture:
    """Log-likelihoods of buckets by language (rows in the order of ``languages``)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = counts + SMOOTHING
        self.p = share / share.sum(axis=1, keepdims=True) if languages else share
        self.log_p = np.log(self.p)

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Predicted language, its proportion, and the proportions of the whole set."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, []
        x = trigrams(text)
        if len(x) > BUCKETS:
            weight = np.bincount(x, minlength=BUCKETS).astype(float)
            x = np.flatnonzero(weight)
            weight = weight[x]
        else:
            weight = np.ones(len(x))
        n, p = weight.sum(), self.p[:, x]
        alone = self.log_p[:, x] @ weight
        chosen = [int(np.argmax(alone))]
        share, best, mix = np.ones(1), alone[chosen[0]], p[chosen[0]]
        while len(chosen) < len(self.languages):
            slope = (p / mix) @ weight / n  # how fast the likelihood grows with a language's proportion
            slope[chosen] = 0
            more = int(np.argmax(slope))
            if slope[more] <= 1:
                break
            wider, pi = [*chosen, more], np.append(share * 0.8, 0.2)
            q, before = p[wider], np.zeros(len(wider))
            while np.abs(pi - before).max() > SETTLED:
                before = pi
                pi = pi * (q @ (weight / (pi @ q))) / n
            total = pi @ q
            reached = np.log(total) @ weight
            if reached - best <= PENALTY * np.log(n + 1):
                break
            chosen, share, best, mix = wider, pi, reached, total
        order = np.argsort(-share, kind="stable")
        found = [(self.languages[chosen[i]], float(share[i])) for i in order]
        return found[0][0], min(1.0, found[0][1]), found


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Mixture:
    """Counts trigrams by language over a bounded sample of the rows with text and language, in tasks; the driver adds up.

    The sample is drawn language by language: each gets an equal part of ``sample_docs`` (LEAST_DOCS at least), one with
    fewer documents all of them, so that rare languages are learned whatever the size of the corpus.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = sample_by_group(known, "id", "lang", sample_docs, LEAST_DOCS, "language").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(lang, np.zeros(BUCKETS, np.int32))
                totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS).astype(np.int32)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    for r in sample.repartition(12).mapInArrow(count, "lang string, counts binary").collect():
        totals[r.lang] = totals.get(r.lang, 0.0) + np.frombuffer(r.counts, np.int32).astype(float)
    languages = sorted(totals)
    return Mixture(languages, np.array([totals[x] for x in languages]) if languages else np.zeros((0, BUCKETS)))


def identify(docs: DataFrame, mixture: Mixture, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (proportion of that language) and languages (struct of lang, share; largest first).

    ``und`` with score 0 and no languages where the text is null or has no letter, or nothing was learned. Texts of
    any length count whole. Repeated rows are kept. An empty table gives no rows. Columns of these names are replaced.
    """
    made = ("lang_pred", "score", "languages")
    base = docs.drop(*(x for x in made if x != text_col))
    at = base.columns.index(text_col)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))]
    languages = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    model = docs.sparkSession.sparkContext.broadcast(mixture)  # languages x BUCKETS doubles, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infer = model.value.infer
        for batch in batches:
            for part in slices(batch, at, 8_000_000):
                found = [infer(t) for t in part.column(at).to_pylist()]
                new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"lang": k, "share": v} for k, v in x[2]] for x in found], languages)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *made])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(id) mod ``folds`` is not ``held`` and identifies all rows; adds held_out."""
    fold = F.coalesce(crc_bucket(id_col, folds), F.lit(held))
    mixture = learn_languages(docs.where(fold != held), id_col, text_col, lang_col)
    return identify(docs.withColumn("held_out", fold == held), mixture, text_col)
