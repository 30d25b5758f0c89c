"""Cases that come up where tables are large: halves in long sums, spans of a stream in several files."""

from vellum.operators.checks import cost_rollup


def test_costs_are_rounded_as_doubles(spark):
    calls = spark.createDataFrame([("m", 332, 332)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 0.075, 0.3)], "model string, price_in double, price_out double")
    assert {r.cost_micro for r in cost_rollup(calls, prices).collect()} == {124}  # 0.0001245 * 1e6 is 124.49999999999999


def test_rows_that_arrive_in_several_files_are_taken_in_order(spark, tmp_path):
    import pandas as pd

    from vellum import registry

    n = 400
    events = pd.DataFrame({"event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="7min"), "user_id": [i % 3 for i in range(n)], "event_type": "view", "value": 1.0, "props": "{}"})
    spark.createDataFrame(events).repartition(6, "event_id").write.parquet(f"{tmp_path}/events.parquet")  # each file holds rows of all times
    places = {r.job_id: r.place for r in registry.QUERIES["streamed_jobs"](spark, str(tmp_path)).collect()}
    assert places == {i: i // 3 + 1 for i in range(n)}
    allowed = {r.event_id for r in registry.QUERIES["streamed_limiter"](spark, str(tmp_path)).collect() if r.allowed}
    of_day = events.groupby([events["user_id"], events["ts"].dt.date])["ts"].rank()
    assert allowed == set(events["event_id"][of_day <= 5])


def test_long_texts_are_read_as_tokens_only_near_citations():
    from vellum.operators.parsing import citations_of, norms_cited, own_references_of, tokens_after_articles, tokens_near

    text = "palavra " * 5000 + "art. 9 da MP 7/2001 " + "palavra " * 5000 + "arts. 3, 4 e 5, § 2º, da Lei 8.666/1993 fim"
    assert [(c[0], c[3], c[5]) for c in citations_of(text)] == [("MP-07-2001", 9, None), ("LEI-8.666-1993", 3, "2")]
    assert [r[2] for r in own_references_of(text + " art. 1º")] == [9, 1]
    assert len(tokens_near(text, [x[:2] for x in norms_cited(text)])) < 150 and len(tokens_after_articles(text)) < 100


def test_levels_are_carried_in_one_order(spark):
    from vellum.operators.laws import counts_below_levels, subtree_counts
    from vellum.operators.parsing import provisions_of

    marks = [("article", "1"), ("letter", "z"), ("item", "II"), ("letter", "a"), ("paragraph", "1"), ("letter", "b"), ("paragraph", None), ("item", "II"), ("article", "2"), ("item", "I"), ("article", "1"), ("item", "II")]
    rows = provisions_of(spark.createDataFrame([(d, i, *m) for d in (1, 2) for i, m in enumerate(marks)], "document int, seq int, kind string, number string"))
    want = ["art1", "art1-alz", "art1-incII", "art1-incII-ala", "art1-par1", "art1-par1-alb", "art1-par1", "art1-par1-incII", "art2", "art2-incI", "art1", "art1-incII"]
    assert [r.path for r in rows.where("document = 1").orderBy("seq").collect()] == want
    assert sorted(map(tuple, counts_below_levels(rows).collect())) == sorted(map(tuple, subtree_counts(rows).collect()))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_places_of_terms_do_not_travel(spark, tmp_path):
    from vellum.operators.index import _postings

    spark.createDataFrame([(1, "a b a", 3), (2, "b", 1)], "k long, text string, length long").write.parquet(f"{tmp_path}/rows")
    made = _postings(spark.read.parquet(f"{tmp_path}/rows"), "k")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # plans are printed from the top
    assert {(r.term, r.k, r.tf, tuple(r.positions)) for r in made.collect()} == {("a", 1, 2, (0, 2)), ("b", 1, 1, (1,)), ("b", 2, 1, (0,))}


def test_differences_of_many_pairs_take_little_memory_and_time():
    import random
    import time
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from vellum.operators.parsing import Edits, segments_of, way_back, word_diff

    dice = random.Random(7)
    for words in (1, 3, 30) * 60:
        x, y = ([dice.randrange(words) for _ in range(dice.randrange(25))] for _ in range(2))
        assert way_back(x, y) == Edits(np.array(x, np.int64), np.array(y, np.int64)).back()
    texts = [" ".join(str(dice.randrange(1000)) for _ in range(80)) for _ in range(1001)]
    began = time.process_time()
    tracemalloc.start()
    made = word_diff.func(pa.array(texts[:-1]), pa.array(texts[1:]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and time.process_time() - began < 30  # as dicts 57 MB; unlike texts took 40 ms a pair
    assert made.slice(0, 1).to_pylist() == segments_of(zip(texts[:1], texts[1:2])).to_pylist()


def test_a_reference_is_split_into_words_once(spark):
    from pyspark.sql import functions as F

    from vellum.functions.text import provision_ref

    said = ["Art. 5º, § 3º, IV", "artigo 7, parágrafo único, alínea b", "ARTIGO 12, inciso XL, c", "art. 9, b", "§ 2º, IV", "", None, "art", ", a"]
    rows = spark.createDataFrame([(x,) for x in said], "said string").distinct().select("said", provision_ref("said").alias("r")).select("said", "r.*")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    found = {r.said: tuple(r)[1:] for r in rows.collect()}
    none = (None,) * 4
    assert [found[x] for x in said] == [(5, "3", "IV", None), (7, "unico", None, "b"), (12, None, "XL", "c"), (9, None, None, "b"), *[none] * 5]


def test_blocks_are_cut_and_classified_once(spark):
    from vellum.operators.laws import law_provisions

    text = ["Art. 1º Um texto,", "que continua", "§ 1º Outro texto.", "I - mais texto e", "sem fim", "longe demais", "Art. 2º Fim."]
    start = [0, 100, 200, 300, 5000, 9000, 9100]
    blocks = spark.createDataFrame([(d, i, at, at + len(t), t) for d in (1, 2) for i, (at, t) in enumerate(zip(start, text))], "document int, seq int, start int, stop int, text string")
    made = law_provisions(blocks)
    got = [(r.place, r.span_id, r.text) for r in made.where("document = 2").orderBy("place").collect()]
    assert got == [(1, "ART-001", "Art. 1º Um texto,\nque continua"), (2, "PAR-001-1", "§ 1º Outro texto."), (3, "INC-001-1-I", "I - mais texto e\nsem fim"), (4, "ART-002", "Art. 2º Fim.")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "size(CASE" not in plan and "size(array" not in plan  # no filter works the parts out again
    assert plan.count("Window [") <= 6


def test_only_texts_without_vector_go_to_the_encoder(spark):
    from vellum.operators.vector import fill_missing

    rows = spark.createDataFrame([(1, "abc", None), (2, "x", [9.0]), (3, None, None), (4, "", None), (5, "ab", None)], "id int, text string, v array<double>")
    made = fill_missing(rows, "text", "v", lambda texts: [[float(len(t))] for t in texts], 1, 1)
    assert {r.id: r.v for r in made.collect()} == {1: [3.0], 2: [9.0], 3: None, 4: None, 5: [2.0]}
    plan = made.select("id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "mapInArrow" not in plan.replace("MapInArrow", "mapInArrow")  # the texts don't pass through Python and back


def test_as_of_rows_are_dealt_once_and_swept_by_columns(spark, monkeypatch):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from vellum.operators import temporal

    dice = random.Random(19)
    written, store = [], temporal.kept_table
    monkeypatch.setattr(temporal, "kept_table", lambda df, name: (written.append(name), store(df, name))[1])
    versions = [(e, s, dice.choice([None] + [s + dice.randrange(60)] * 9), i) for i in range(500) if (e := dice.choice("aaab")) and (s := dice.randrange(200)) >= 0]
    versions += [("nest", i, 1000 - i, i) for i in range(100)]
    facts = [(i, dice.choice("aab"), dice.randrange(260)) for i in range(500)] + [(1000 + i, "nest", 850 + i) for i in range(160)] + [(2000, "a", None), (2001, None, 5)]
    v, f = spark.createDataFrame(versions, "e string, start long, stop long, n long"), spark.createDataFrame(facts, "id long, e string, at long")
    seconds = lambda df, *names: df.withColumns({c: F.timestamp_seconds(c) for c in names})
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        made = [{r.id: r.n for r in temporal.as_of_join(a, b, "e", "at", "start", "stop", ["n"]).collect()} for a, b in ((f, v), (seconds(f, "at"), seconds(v, "start", "stop")))]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    best = lambda e, at: max(((s, n) for x, s, end, n in versions if x == e and at is not None and s <= at and (end is None or end > at)), default=(0, None))[1]
    assert made == [{i: best(e, at) for i, e, at in facts}] * 2
    assert written == ["as-of-facts"] * 2  # neither the slices nor their edges are written and dealt again

    ends, low = np.array([dice.randrange(50) for _ in range(300)]), np.sort([dice.randrange(300) for _ in range(200)])
    high, at = np.array([dice.randrange(x, 301) for x in low]), np.array([dice.randrange(55) for _ in low])
    assert [max((j for j in range(a, z) if ends[j] > t), default=a - 1) for a, z, t in zip(low, high, at)] == temporal._last_above(ends, low, high, at).tolist()


def test_terms_are_counted_without_rewriting_the_texts(spark):
    import random

    from pyspark.sql import functions as F

    from vellum.functions.text import ACCENTED, index_form
    from vellum.operators.lexical import needle, token_table

    dice = random.Random(20)
    letters = "aeyk" * 6 + " " * 14 + ".,_-\n1" + ACCENTED + "ŸÅKİ̇ſßΣσςéÉÿåŷǻ日𝒳١"
    texts = ["".join(dice.choices(letters, k=dice.randrange(60))) for _ in range(3000)] + [None, "", " .", "a" * 9, "a a a a a", "A.a-Á_à", "İa iİ xi", "Ÿ y ÿ a Å å", "a.c abc"]
    tokens, parts = ["a", "É", "a a", "y", "k a", "i", "xi", "a-e", "!!", "ss", "σ", "日"], ["a", "a.", "ya", "1", "k"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    for prefix in (False, True):
        rows = token_table(docs, "text", tokens, parts, prefix)
        plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().analyzed().toString()
        assert "regexp_replace" not in plan and "replace(" not in plan
        got = {r.id: r for r in rows.collect()}
        for r in docs.select("id", "text", index_form("text").alias("form"), F.lower("text").alias("low")).collect():
            doubled, low = (r.form or "").replace(" ", "  "), r.low or ""
            want = [doubled.count(" " + needle(t).replace(" ", "  ") + ("" if prefix else " ")) if needle(t) else 0 for t in tokens]
            have = got[r.id]
            assert [have[f"tf{i}"] for i in range(len(tokens))] == want, (r.text, want)
            assert (have.length, have.grams) == (len((r.form or "").split()), max(len(r.text or "") - 2, 0))
            assert [have[f"sf{i}"] for i in range(len(parts))] == [low.count(t) for t in parts]
