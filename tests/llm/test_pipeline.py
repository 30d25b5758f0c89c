"""Each stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_classifiers import brute_mixture
from test_decontaminate import brute as brute_contamination
from test_jaccard_join import brute as brute_components
from test_line_dedup import brute as brute_lines

from vellum.llm.shared import written
from vellum.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage, by doc_id."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def test_columns(steps, spark):
    columns = table(spark, SF, "documents").columns
    assert all(c == columns for name, (_, _, c) in steps.items() if name != "sentencepiece")
    assert steps["sentencepiece"][2] == [*columns, "piece_ids", "n_tokens", "round_trip"]


def test_language_id_against_brute_force(steps, spark):
    import zlib

    from vellum.llm.language_id import PENALTY, learn_languages, trigrams

    before, after, _ = steps["language_id"]
    docs = table(spark, SF, "documents")
    model = learn_languages(spark.createDataFrame([r for r in before if zlib.crc32(str(r.doc_id).encode()) % 4 != 2], docs.schema))
    stay, p, tried = {r.doc_id for r in after}, model.p.tolist(), 0
    for r in before:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.doc_id not in stay
        elif len(r.text) < 1500:
            share = max(brute_mixture(model.languages, p, trigrams(r.text).tolist(), PENALTY).values())
            assert (r.doc_id in stay) == (share >= corpus_pipeline.MAIN_SHARE) or abs(share - corpus_pipeline.MAIN_SHARE) < 0.01
            tried += 1
    assert tried > 50


ODD = [
    (3, "one two three four five six seven", "en", "a"), (5, "one two three four five six seven", "en", "b"),
    (5, "an altogether other text of the same id five", "en", "c"), (9, "nine has a text that stands here twice", "en", "d"),
    (9, "nine has a text that stands here twice", "en", "e"), (None, "one two three four five six seven", "en", "a"),
    (None, "nobody knows the id of this text at all", "en", "a"), (11, None, None, None), (11, None, None, None), (12, "", "en", "a"), (13, " \n ", "en", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None, "s", i, "g", -9.0, "l", {"k": i} if i % 3 else None) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_key string, n_hit int, `gone.by` string, score double, lang_pred string, extra map<string,int>")


@pytest.mark.parametrize("k", range(5))
def test_nulls_repeats_clashing_names_and_empty_tables(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    assert out.columns[: len(odd.columns)] == odd.columns and out.columns[len(odd.columns) :] == (["piece_ids", "n_tokens", "round_trip"] if k == 4 else [])
    assert stage(spark, odd.limit(0), SF).count() == 0
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    whole = sorted((r[:2] for r in ODD), key=repr)
    assert all((r.component_key, r["gone.by"], r.score, r.lang_pred) == ("s", "g", -9.0, "l") for r in out.collect())
    if name == "language_id":
        assert got == [x for x in whole if (x[1] or "").strip()]
    elif name == "jaccard_join":
        want = [(3, ODD[0][1]), (5, ODD[2][1]), (9, ODD[3][1]), ODD[6][:2], (11, None), (11, None), (12, ""), (13, " \n ")]
        assert got == sorted(want, key=repr) and [r.source for r in out.collect() if r.doc_id == 9] == ["d"]
    else:
        assert got == whole


def test_very_long_texts(spark):
    docs = table(spark, SF, "documents").limit(40)
    long = " ".join(f"the word{i} and" for i in range(150_000))
    one = docs.where("lang = 'en'").limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit(long)})
    docs = written(docs.unionByName(one), "test-long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-long-{name}")
        assert docs.where("doc_id = 1000000").count() == 1, name
    assert docs.where("doc_id = 1000000").first().round_trip


def test_line_dedup(steps):
    before, after, _ = steps["line_dedup"]
    want = {i: t for i, t, _, _ in brute_lines([(r.doc_id, r.text, r.source) for r in before], 10)}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(steps):
    before, after, _ = steps["jaccard_join"]
    assert {r.doc_id for r in after} == {root for _, _, root in brute_components([(r.doc_id, r.text) for r in before])}


def test_decontamination(steps, spark):
    before, after, _ = steps["decontaminate"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in after} == {x[0] for x in brute_contamination([(r.doc_id, r.text) for r in before], items) if not x[-1]}


def test_encoding(steps):
    import sentencepiece

    from vellum.llm.queries import piece_model

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    _, after, _ = steps["sentencepiece"]
    assert after and all(r.round_trip and r.piece_ids == library.encode(r.text) and r.n_tokens == len(r.piece_ids) for r in after)
