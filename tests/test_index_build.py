"""How the index is built: nothing is shuffled, and odd texts are inverted as the operators read them."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vellum.functions.text import ACCENTED
from vellum.operators import index as module
from vellum.operators.index import SearchIndex
from vellum.operators.lexical import bm25, substring_lane

dice = random.Random(4)
LETTERS = "aeyk" * 6 + " " * 14 + ".,_-\n1\0" + ACCENTED + "ŸÅKİ̇ſßΣσςéÉÿåŷǻ日𝒳١"
ODD = ["".join(dice.choices(LETTERS, k=dice.randrange(60))) for _ in range(1500)] + [None, "", " .", "ab", "aaaa" * 3000, "Ÿ y ÿ a Å å", "İa iİ xi", "𝒳𝒳𝒳 a"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)


def same(got, want):
    a, b = ({x.id: round(x.score, 6) for x in df.collect()} for df in (got, want))
    assert a == b and len(b) > 0


def test_trigrams_are_listed_by_part_without_a_shuffle(spark, tmp_path):
    docs = frame(spark, ODD)
    idx = SearchIndex(spark, f"file://{tmp_path}/index", ("grams",))
    idx.add(docs, "id", "text")
    (name,) = idx.segments
    rows = spark.read.parquet(idx._at(name, "rows"))
    assert "Exchange" not in module._grams(rows, "id")._jdf.queryExecution().executedPlan().toString()
    written = spark.read.parquet(idx._at(name, "grams"))
    have = {(r.gram, r.part, k) for r in written.collect() for k in r["keys"]}
    low = rows.select("id", "part", F.lower("text").alias("low")).collect()
    assert have == {(r.low[i : i + 3], r.part, r.id) for r in low for i in range(len(r.low or "") - 2)}
    assert {r.gram: r.n for r in written.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()} == {r.gram: r["rows"] for r in spark.read.parquet(idx._at(name, "gram_counts")).collect()}


def test_pieces_are_cut_where_numbers_do_not_suffice():
    import numpy as np
    import pyarrow as pa

    many = "".join(chr(c) for c in range(32, 0x10000) if not 0xD800 <= c < 0xE000)
    texts = pa.array(["abcd"] * 40_000 + [many, "bcd"])  # 60,000 letters in 40,000 texts: more than 63 bits
    found = list(module._trigrams(pa.array(np.arange(len(texts))), texts))
    assert len(found) > 1
    by_gram = {}
    for grams, keys in found:
        for g, k in zip(grams.to_pylist(), keys.to_pylist(), strict=True):
            by_gram.setdefault(g, []).extend(k)
    assert by_gram["abc"] == list(range(40_001)) and by_gram["bcd"][-1] == 40_001
    assert len(by_gram) == len(many) - 2


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_KEYS": 0, "ASKED_PARTS": 0}])
def test_texts_do_not_travel_to_a_substring_search(spark, tmp_path, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(module, name, value)
    docs = frame(spark, ODD)
    idx = SearchIndex(spark, f"file://{tmp_path}/index")
    idx.add(docs, "id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in ("aaa", "ya. KAY", "日𝒳a aek"):
            found = idx.substring(query)
            plan = found._jdf.queryExecution().toString()
            assert ("SortMergeJoin" in plan) == bool(bounds)  # texts are joined by shuffling beyond a bound only
            same(found, substring_lane(docs, "text", query)) if query != "日𝒳a aek" else found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_are_made_when_they_are_asked_for(spark, tmp_path):
    docs, at = frame(spark, ODD), f"file://{tmp_path}/index"
    idx = SearchIndex(spark, at, ("grams",))
    idx.add(docs, "id", "text")
    idx.delete(docs.where("id % 3 = 0").select("id"))
    with pytest.raises(ValueError, match="no terms"):
        idx.search(["a"])
    with pytest.raises(ValueError, match="no blocks"):
        idx.best(["a"], 3)
    idx.ensure("blocks")
    again, left = SearchIndex(spark, at), docs.where("id % 3 <> 0")
    assert again.parts == ["terms", "blocks", "grams"] and again.figures("length") == idx.figures("length")
    same(again.search(["a", "y"]), bm25(left, "text", ["a", "y"]))
    same(again.best(["a", "y"], 10**6), bm25(left, "text", ["a", "y"]))
    same(again.substring("aaa"), substring_lane(left, "text", "aaa"))


def test_terms_are_inverted_without_a_shuffle(spark, tmp_path):
    frame(spark, ODD).withColumn("length", F.coalesce(F.size(module.terms_of("text")), F.lit(0)).cast("long")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows").withColumn("length", F.greatest("length", F.lit(0).cast("long")))
    made = module._terms(rows.drop("length"), "id")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    seen = lambda df: {(r.term, r.block, r.id, r.tf, r.length, tuple(r.positions)) for r in df.collect()}
    found = seen(made)
    assert {x for x in found if x[0]} == seen(module._postings(rows, "id"))
    assert {(x[2], x[4]) for x in found if not x[0]} == {(r.id, r.length) for r in rows.collect()}
    assert made.count() == len(found)


def test_a_run_is_in_order():
    import pyarrow as pa

    forms = ["b a b", "", "são sao a", "z"]
    found = [r for x in module._inverted(pa.array([4, 3, 2, 1]), pa.array([0, 0, 0, 0]), pa.array(forms), ["term", "block", "key", "tf", "length", "positions"]) for r in x.to_pylist()]
    places = [(r["term"], r["block"], r["key"]) for r in found]
    assert places == sorted(places) and [p for p in places if p[0] == ""] and len(places) == 4 + 5
    assert {(r["term"], r["key"]): r["positions"] for r in found if r["term"]} == {("a", 2): [2], ("a", 4): [1], ("b", 4): [0, 2], ("sao", 2): [0, 1], ("z", 1): [0]}


def test_postings_of_a_phrase_are_joined_once(spark, tmp_path):
    docs = frame(spark, [*ODD, "a y k", "K, a-y a y", "a k y"])
    idx = SearchIndex(spark, f"file://{tmp_path}/index", ("terms",))
    idx.add(docs, "id", "text")
    found = idx.search(["a y", "k"], every=True)
    assert found._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 2  # the weights and the scores
    same(found, bm25(docs, "text", ["a y", "k"], every=True))
    with pytest.raises(AnalysisException):  # parts that weren't asked for aren't there
        spark.read.parquet(idx._at(next(iter(idx.segments)), "grams"))


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_texts_do_not_travel_to_a_merge_with_many_tombstones(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(module, "BROADCAST_DELETED", 0)
    monkeypatch.setattr(module, "BROADCAST_KEYS", most)
    docs = frame(spark, ODD)
    idx = SearchIndex(spark, f"file://{tmp_path}/index", ("terms",))
    idx.add(docs.where("id % 2 = 0"), "id", "text")
    idx.add(docs.where("id % 2 = 1"), "id", "text")
    idx.add(docs.where("id % 5 = 0").withColumn("text", F.lit("a new text")), "id", "text")
    idx.delete(docs.where("id % 7 = 0").select("id"))
    left = docs.withColumn("text", F.when(F.col("id") % 5 == 0, "a new text").otherwise(F.col("text"))).where("id % 7 <> 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ("SortMergeJoin" in idx._live("rows")._jdf.queryExecution().executedPlan().toString()) == (not most)
        assert {(r.id, r.text) for r in idx.rows().collect()} == {(r.id, r.text) for r in left.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    same(idx.search(["a", "new"]), bm25(left, "text", ["a", "new"]))
    idx.merge()
    assert len(idx.segments) == 2
    same(idx.search(["a", "new"]), bm25(left, "text", ["a", "new"]))


def test_blocks_are_read_off_the_runs(spark, tmp_path):
    idx = SearchIndex(spark, f"file://{tmp_path}/index", ("terms", "blocks"))
    idx.add(frame(spark, ODD), "id", "text")
    (name,) = idx.segments
    terms = spark.read.parquet(idx._at(name, "terms"))
    made = module._blocks(terms)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    figures = lambda df, most, least, rows: {tuple(r) for r in df.groupBy("term", "block").agg(F.max(most), F.min(least), rows).collect()}
    want = figures(terms.where("term <> ''"), "tf", "length", F.count("*"))
    assert figures(made, "most", "shortest", F.sum("rows")) == figures(spark.read.parquet(idx._at(name, "blocks")), "most", "shortest", F.sum("rows")) == want
