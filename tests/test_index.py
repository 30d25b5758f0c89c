"""The index on disk against the operators that read whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import index as module
from vellum.operators.index import SearchIndex
from vellum.operators.lexical import bm25, substring_lane, top


def texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "then", "there", "a", "tion", "action", "São", "paulo", "x-y", "of the", "q" * r.randrange(1, 6)])
    return [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 40, 200])))) for i in range(n)] + [(n, None), (n + 1, "")]


def same(got, want):
    a, b = ({x.id: round(x.score, 6) for x in df.collect()} for df in (got, want))
    assert a == b and len(b) > 0


def compare(idx, docs):
    for tokens in (["the"], ["the", "tion", "the"], ["sao", "paulo", "nowhere"]):
        same(idx.search(tokens), bm25(docs, "text", tokens))
    for tokens in (["the", "a"], ["of the", "action"]):
        same(idx.search(tokens, every=True), bm25(docs, "text", tokens, every=True))
    for tokens in (["the"], ["act", "pau"], ["of the"]):
        same(idx.search(tokens, prefix=True), bm25(docs, "text", tokens, prefix=True))
    same(idx.search(["the the", "a a"]), bm25(docs, "text", ["the the", "a a"]))
    for query in ("ction", "then PAULO", "o p zzzz tion"):
        same(idx.substring(query), substring_lane(docs, "text", query))
    for tokens, k in ((["the", "action"], 5), (["tion", "tion"], 300), (["paulo"], 1)):
        want = [(x.id, round(x.score, 6), x.rank) for x in top(bm25(docs, "text", tokens).withColumn("score", F.round("score", 6)), "id", k).orderBy("rank").collect()]
        assert [(x.id, round(x.score, 6), x.rank) for x in idx.best(tokens, k, first=2).orderBy("rank").collect()] == want


def test_built_changed_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_SEGMENTS", 2)
    at = f"file://{tmp_path}/index"
    rows = dict(texts(1))
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, text string")
    idx = SearchIndex(spark, at)
    idx.add(frame(rows), "id", "text")
    compare(idx, frame(rows))
    changed = {i: t for i, t in texts(2)[:30]} | {1000: "the new action"}
    idx.add(frame(changed), "id", "text")
    gone = list(range(20, 50))
    idx.delete(spark.createDataFrame([(i,) for i in gone], "k long"))
    rows = {i: t for i, t in (rows | changed).items() if i not in gone}
    compare(SearchIndex(spark, at), frame(rows))
    idx.add(frame({2000: "a late action of the then"}), "id", "text")  # the third segment: the smaller two are merged
    rows[2000] = "a late action of the then"
    again = SearchIndex(spark, at)
    assert len(again.segments) == 2 and {x.id: x.text for x in again.rows().collect()} == rows
    compare(again, frame(rows))


def test_only_some_blocks_and_files_are_read(spark, tmp_path):
    rows = [(i, "rare " * (i % 7 == 0) + "common " * (1 + i % 300)) for i in range(3000)]
    idx = SearchIndex(spark, f"file://{tmp_path}/index")
    idx.add(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    best = idx.best(["rare", "common"], 3)
    assert best.count() == 3 and len(idx.read_blocks) < idx._table("blocks", list(idx.segments)).select("block").distinct().count() / 2
    plan = idx.search(["rare"])._jdf.queryExecution().toString()
    assert "EqualTo(term,rare)" in plan
    plan = idx.search(["ra"], prefix=True)._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ra)" in plan
    assert "PushedFilters: [In(gram" in idx.substring("rare")._jdf.queryExecution().toString()


def test_refusals_and_empty(spark, tmp_path):
    idx = SearchIndex(spark, f"file://{tmp_path}/index")
    assert idx.search(["a"]).count() == 0 and idx.substring("abc").count() == 0
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    idx.add(docs, "id", "text")
    with pytest.raises(ValueError):
        idx.add(docs.union(docs), "id", "text")
    other = SearchIndex(spark, f"file://{tmp_path}/index")
    other.delete(docs.select("id"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):  # a writer that has missed a version
        SearchIndex.delete(idx, docs.select("id"))
