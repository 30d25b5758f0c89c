"""Cases that once came out wrong, against brute force or by example."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.operators.fusion import rerank_all_or_nothing
from vellum.operators.sequence import packed_chunks
from vellum.operators.temporal import as_of_join
from vellum.sources import frontmatter
from vellum.streaming.windows import limiter, run_to_table


def valid(versions, e, at):
    """The version of the newest start, of equal ones that of the greatest payload."""
    found = [(s, p) for f, s, x, p in versions if f == e and s is not None and at is not None and s <= at and (x is None or x > at)]
    return max(found)[1] if found else None


@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 40), (3, 1)])
def test_as_of_join_over_overlapping_versions(spark, seed, parts):
    r = random.Random(seed)
    versions = [(r.choice(["hot", "hot", "b", "c", None]), s := r.choice([None, *range(60)]), r.choice([None, (s or 0) + r.randrange(0, 30)]), f"v{i}") for i in range(600)]
    versions += [("nest", 0, None, "A"), ("nest", 5, 7, "B"), ("nest", 5, 6, "C")]
    facts = [(i, r.choice(["hot", "b", "c", "none", None]), r.choice([None, *range(-2, 95)])) for i in range(900)] + [(1000 + t, "nest", t) for t in range(10)]
    v = spark.createDataFrame(versions, "e string, start int, stop int, text string")
    f = spark.createDataFrame(facts, "id int, e string, at int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {x.id: x.text for x in as_of_join(f, v, "e", "at", "start", "stop", ["text"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {i: valid(versions, e, at) if e is not None else None for i, e, at in facts}
    assert out[1008] == "A" and out[1005] == "C"


def test_as_of_join_of_empty_tables_and_dates(spark):
    v = spark.createDataFrame([("a", datetime(2020, 1, 1), None, 1)], "e string, start timestamp, stop timestamp, n int")
    f = spark.createDataFrame([("a", "2020-01-01"), ("a", "2019-12-31")], "e string, day string").select("e", F.to_date("day").alias("day"))
    assert sorted((str(x.day), x.n) for x in as_of_join(f, v, "e", "day", "start", "stop", ["n"]).collect()) == [("2019-12-31", None), ("2020-01-01", 1)]
    assert [x.n for x in as_of_join(f, v.limit(0), "e", "day", "start", "stop", ["n"]).collect()] == [None, None]
    assert as_of_join(f.limit(0), v, "e", "day", "start", "stop", ["n"]).count() == 0


def test_a_key_scored_twice_spoils_the_scores(spark):
    pool = spark.createDataFrame([("a", 0.3, 0.1), ("b", 0.2, 0.9), ("b", 0.2, 0.8), ("c", 0.1, 0.7)], "id string, rrf double, rerank double")
    out = rerank_all_or_nothing(pool, "id").orderBy("place").collect()
    assert [(x.id, x.score, x.reranked, x.place) for x in out] == [("a", 0.3, False, 1), ("b", 0.2, False, 2), ("c", 0.1, False, 3)]


def test_blocks_of_equal_pages_stay_together(spark):
    pages = spark.createDataFrame([("d", 1, "a\n\nb"), ("d", 1, "a\n\nb"), ("d", 1, "a\n\nb"), ("e", 1, "a\n\nb")], "d string, p int, t string").repartition(3)
    out = {x.d: x.text.split("\n\n") for x in packed_chunks(pages, "d", "p", "t", 500).collect()}
    assert out == {"d": ["a", "b"] * 3, "e": ["a", "b"]}


def test_inline_lists():
    assert frontmatter.value_of("[it's, x]") == ["it's, x"]
    assert frontmatter.value_of("[a, 'b, c', [d, e], 3, true]") == ["a", "b, c", "[d, e]", 3, True]
    assert frontmatter.value_of("[]") == [] and frontmatter.value_of("[a, ]") == ["a"] and frontmatter.value_of("[a,, b]") == ["a", "", "b"]


def test_rendered_values_stay_on_their_lines(spark):
    rows = spark.createDataFrame([('a "b" \\c\nd', 7, ["x: y", None, 'z"'], "body")], "id string, year int, cited array<string>, text string")
    fields = {"id": F.col("id"), "year": F.col("year"), "none": F.lit(None), "cited": F.col("cited")}
    doc = rows.select(frontmatter.render(fields, F.col("text"), numbers=("year",), lists=("cited",)).alias("doc")).first().doc
    assert doc == '---\nid: "a \\"b\\" \\\\c d"\nyear: 7\ncited:\n  - "x: y"\n  - "z\\""\n---\n\nbody\n'
    parsed = frontmatter.parse(doc)
    assert parsed["year"] == 7 and len(parsed["cited"]) == 2
    where = frontmatter.provision_path(F.lit("LEI-1"), F.array(F.lit("Livro I"), F.lit("Título II")), F.lit("x"), F.lit(5), F.lit("1"), F.lit("II"), F.lit(None))
    assert spark.range(1).select(where.alias("w")).first().w == "LEI-1/dispositivos/livro-i/titulo-ii/art-005-p-1-i-ii.md"
    assert spark.range(1).select(frontmatter.provision_path(F.lit("L"), F.lit(None), F.lit("Anexo 1"), F.lit(None).cast("int"), *[F.lit(None)] * 3).alias("w")).first().w == "L/dispositivos/sem-hierarquia/anexo-1.md"


def sequential(triggers, per_minute, per_day):
    counts, out = {}, {}
    for calls in triggers:
        for client, ts, event in sorted(calls):
            windows = [("minute", client, int(ts.timestamp()) // 60), ("day", client, int(ts.timestamp()) // 86400)]
            full = [w[0] for w, most in zip(windows, (per_minute, per_day), strict=True) if counts.get(w, 0) >= most]
            if not full:
                for w in windows:
                    counts[w] = counts.get(w, 0) + 1
            out[event] = (not full, full[0] if full else None)
    return out


def test_limiter_counts_late_calls_in_their_own_windows(spark, tmp_path):
    noon = datetime(2024, 5, 1, 12)
    r = random.Random(2)
    triggers = [[(1, noon + timedelta(seconds=70), 1)], [(1, noon + timedelta(seconds=10), 2)], [(1, noon + timedelta(seconds=75), 3)]]
    triggers += [[(r.randrange(2, 5), noon + timedelta(seconds=120 * k + r.randrange(0, 500)), 100 * k + i) for i in range(12)] for k in range(1, 12)]
    path = str(tmp_path / "in")
    for calls in triggers:
        spark.createDataFrame(calls, "client long, ts timestamp, event_id long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("client long, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(path)
    out = {x.event_id: (x.allowed, x.scope) for x in run_to_table(limiter(stream, 1, 20), f"file://{tmp_path}/out").collect()}
    assert out == sequential(triggers, 1, 20) and out[3] == (False, "minute")
    left = [json.loads(x.json) for x in spark.read.format("statestore").option("stateVarName", "minute").load(f"file://{tmp_path}/out/checkpoint").select(F.to_json(F.struct("*")).alias("json")).collect()]
    assert 0 < len(left) < len({(c, int(t.timestamp()) // 60) for calls in triggers for c, t, _ in calls})


def test_jobs_are_worked_off_once_and_fail_alone(spark, tmp_path):
    from vellum.streaming.windows import dead_letters, drain_jobs

    path, noon = str(tmp_path / "in"), datetime(2024, 5, 1, 12)
    batches = [[(1, 11, noon, "a"), (1, 10, noon, "bad"), (2, 20, noon, "c")], [(1, 12, noon - timedelta(hours=1), "d"), (2, 20, noon, "c")], [(1, 13, noon, "bad"), (1, 14, noon, "e")]]
    for jobs in batches:
        spark.createDataFrame(jobs, "queue long, job_id long, created_at timestamp, payload string").coalesce(1).write.mode("append").parquet(path)

    def handler(payload):
        if payload == "bad":
            raise RuntimeError("no")
        return payload * 2

    stream = lambda: spark.readStream.schema("queue long, job_id long, created_at timestamp, payload string").option("maxFilesPerTrigger", 1).parquet(path)
    folder = f"file://{tmp_path}/out"
    out = drain_jobs(stream(), handler, folder)
    want = {(10, 1, "failed", None), (11, 2, "done", "aa"), (12, 3, "done", "dd"), (13, 4, "failed", None), (14, 5, "done", "ee"), (20, 1, "done", "cc")}
    assert {(x.job_id, x.place, x.status, x.result) for x in out.collect()} == want
    assert {(x.job_id, x.error) for x in dead_letters(out).collect()} == {(10, "RuntimeError: no"), (13, "RuntimeError: no")}
    assert {(x.job_id, x.place, x.status, x.result) for x in drain_jobs(stream(), handler, folder).collect()} == want  # nothing new: nothing is done again


def test_windows_and_sessions_of_late_files(spark, tmp_path):
    from vellum.streaming.windows import run_closed, run_upserted, session_counts, tumbling_counts

    noon, r = datetime(2024, 5, 1, 12), random.Random(3)
    rows = sorted(((noon + timedelta(seconds=r.randrange(0, 40_000)), r.randrange(3), 1.0) for _ in range(600)), key=lambda x: x[0] + timedelta(seconds=r.randrange(0, 590)))
    path = str(tmp_path / "in")
    for k in range(6):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "ts timestamp, k long, v double").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("ts timestamp, k long, v double").option("maxFilesPerTrigger", 1).parquet(path)
    whole = spark.read.parquet(path)
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(run_upserted(tumbling_counts(stream(), "ts", "k", "v", "1 hour"), f"file://{tmp_path}/a", ["start", "k"])) == as_rows(tumbling_counts(whole, "ts", "k", "v", "1 hour"))
    assert as_rows(run_closed(stream(), lambda e: session_counts(e, "ts", "k", "4 minutes"), "ts", "k", f"file://{tmp_path}/b")) == as_rows(session_counts(whole, "ts", "k", "4 minutes"))
    left = spark.read.format("statestore").load(f"file://{tmp_path}/a/checkpoint").count()
    assert left < 12 * 3  # windows that the watermark has passed are gone


def test_only_missing_vectors_are_made_and_only_their_folders_replaced(spark, tmp_path):
    from pathlib import Path

    from vellum.operators.vector import fill_missing, fill_table

    schema = "id long, text string, v array<double>, part int"
    rows = [(1, "aa", [9.0], 0), (2, "bbb", None, 1), (3, None, None, 2), (4, "", None, 2), (5, "c", None, 1), (6, "d", [8.0], 1)]
    spark.createDataFrame(rows, schema).write.partitionBy("part").parquet(f"{tmp_path}/t")
    files = lambda: {k: sorted(x.name for x in Path(f"{tmp_path}/t/part={k}").glob("*.parquet")) for k in (0, 1, 2)}
    before = files()
    assert fill_table(spark, f"{tmp_path}/t", "part", "text", "v", lambda ts: [[float(len(t))] for t in ts], 1) == 1
    after = files()
    assert after[0] == before[0] and after[2] == before[2] and after[1] != before[1]
    assert {x.id: x.v for x in spark.read.parquet(f"{tmp_path}/t").collect()} == {1: [9.0], 2: [3.0], 3: None, 4: None, 5: [1.0], 6: [8.0]}
    assert fill_table(spark, f"{tmp_path}/t", "part", "text", "v", lambda ts: 1 / 0, 1) == 0
    with pytest.raises(Exception, match="not 2 finite ones"):
        fill_missing(spark.createDataFrame(rows, schema), "text", "v", lambda ts: [[1.0] for _ in ts], 2).collect()
