import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from vellum.operators.sequence import fixed_window_limits
from vellum.session import table
from vellum.sources import catalogue, frontmatter
from vellum.sources.paged import PagedSource
from vellum.streaming.windows import limiter, session_counts, tumbling_counts, upsert_batches

SF = "/root/testdata/sf0.001"


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿code;description;group\n1;"Luva ""P""\ncom duas linhas";A  B\n2;short\n1;again;X\n0;zero;X\n3;ok;INVÁLIDO\n', encoding="utf-8")
    rows = catalogue.read_csv(spark, str(tmp_path / "c.csv"), ["code", "description", "group"])
    out = {r.id: (r.description, r.group) for r in catalogue.items(rows, "mat", "code", "description", "group", {"A B": "AB"}).collect()}
    assert out == {"cat-mat-1": ('Luva "P" com duas linhas', "AB"), "cat-mat-3": ("ok", "INVÁLIDO")}
    with pytest.raises(ValueError):
        catalogue.read_csv(spark, str(tmp_path / "c.csv"), ["missing"])
    texts = spark.createDataFrame([("d", None, "INVÁLIDO"), ("d", "p", "g")], "a string, b string, c string").select(catalogue.embedding_text("a", "b", "c").alias("t"))
    assert [r.t for r in texts.collect()] == ["d", "d (p) [g]"]
    catalogue.write_json_shards(spark.range(25).coalesce(1), str(tmp_path / "j"), 10)
    assert len(list((tmp_path / "j").glob("*.json"))) == 3
    assert catalogue.equal_counts(spark.read.json(str(tmp_path / "j")), spark.range(25)).first().complete


def test_front_matter(spark, tmp_path):
    text = "---\na: 1\nb: [x, 'y']\nc:\n  - p\nd:\n  k: true\n---\n\nBody\n"
    assert frontmatter.parse(text) == {"a": 1, "b": ["x", "y"], "c": ["p"], "d": {"k": True}}
    df = spark.createDataFrame([(text,), ("no",), ("---\n  x\n---",)], "t string").select(frontmatter.front_matter("t").alias("f"), frontmatter.body(F.col("t")).alias("b"))
    out = df.collect()
    assert json.loads(out[0].f.fields)["d"] == {"k": True} and out[0].b.strip() == "Body"
    assert [r.f.error for r in out[1:]] == ["line 1: no front matter", "line 2: indented without a key"]
    made = spark.createDataFrame([("n1", "t")], "norm string, text string").select("norm", frontmatter.render({"norm": F.col("norm"), "none": F.lit(None)}, F.col("text")).alias("doc"))
    assert made.first().doc == '---\nnorm: "n1"\n---\n\nt\n'
    frontmatter.write_markdown(made, str(tmp_path / "md"), "norm", "doc")
    assert list((tmp_path / "md").glob("norm=n1/*.txt"))


def test_paged_source(spark):
    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            if self.path.endswith("2") and seen.count(self.path) == 1:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": [{"n": int(self.path[-1])}], "total": 3}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    out = spark.read.format("paged").options(url=f"http://127.0.0.1:{server.server_port}/?p={{page}}", pages=3, field="rows", wait=0.01).load().collect()
    counted = spark.read.format("paged").options(url=f"http://127.0.0.1:{server.server_port}/?p={{page}}", pagesField="total", field="rows", wait=0.01).load().collect()
    server.shutdown()
    assert len(counted) == 3
    assert sorted((r.page, r.row) for r in out) == [(i, json.dumps({"n": i})) for i in (1, 2, 3)]


def streamed(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, "ts").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(path)


def test_streaming_limiter_equals_windows(spark, tmp_path):
    events = table(spark, SF, "events").select(F.col("user_id").cast("long").alias("client"), "event_id", "ts")
    source = limiter(streamed(spark, tmp_path, events, 1), 1, 3)
    q = source.writeStream.outputMode("append").format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    want = {r.event_id: (r.allowed, r.scope) for r in fixed_window_limits(events, "client", "ts", "event_id", 1, 3).collect()}
    assert {r.event_id: (r.allowed, r.scope) for r in spark.table("limits").collect()} == want


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    for n, op in (("w", lambda e: tumbling_counts(e, "ts", "event_type", "value", "1 hour")), ("s", lambda e: session_counts(e, "ts", "user_id", "2 hours"))):
        q = op(streamed(spark, tmp_path / n, events, 1)).writeStream.outputMode("append").format("memory").queryName(f"out_{n}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        got = {tuple(r) for r in spark.table(f"out_{n}").drop("total").collect()}
        batch = {tuple(r) for r in op(events).drop("total").collect()}
        assert got <= batch and len(got) > 0.8 * len(batch)  # the last windows wait for the watermark


def test_upsert_batches(spark, tmp_path):
    target = str(tmp_path / "t")
    apply = upsert_batches(target, "k", "v", buckets=4)
    rows = lambda x: spark.createDataFrame(x, "k int, v int, x string")
    kept = lambda: sorted(map(tuple, spark.read.parquet(target).select("k", "v", "x").collect()))
    apply(rows([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    apply(rows([(1, 2, "d"), (1, 0, "old")]), 1)
    apply(rows([(1, 2, "d"), (1, 0, "old")]), 1)  # the batch comes again
    assert kept() == [(1, 2, "d"), (2, 1, "b"), (3, 1, "c")]
    assert any(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())  # folders without a key of the batch stay
    apply(rows([]), 2)
    assert len(kept()) == 3


def test_front_matter_scalars_and_lists():
    parsed = frontmatter.parse("---\na: 1.5\nb: null\nc: -7\nd: ['x, y', z, 3, true]\ne: \"q\"\nf: 9007199254740993\ng: []\n---\n")
    assert parsed == {"a": "1.5", "b": "null", "c": -7, "d": ["x, y", "z", 3, True], "e": "q", "f": "9007199254740993", "g": []}
    with pytest.raises(ValueError, match="line 3"):
        frontmatter.parse("---\na:\n\t- x\n---\n")
