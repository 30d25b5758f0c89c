import hashlib
import re

from vellum.llm.warc import DICTIONARY_FRAME, archive, archived_records, read_archives


def brute(rows, least=1000):
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        same = [x for x, _, g in rows if (g or "").encode() == b and x is not None]
        last = max(same, default=None) if len(b) >= least else None
        revisit = last is not None and i != last
        out.append((None if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(last) if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_and_revisits(spark, got):
    big = "<p>" + "é body " * 300
    rows = [(i, f"http://x.org/{i}", f"<html>page {i} {'tail ' * (i % 40)}</html>") for i in range(60)]
    rows += [(100 + i, "http://copy", big) for i in range(40)] + [(7, "http://again", big), (200, None, None), (201, "bad\r\nurl", ""), (202, "u", "a" * 999), (203, "u", "a" * 999), (204, "u", "b" * 1000), (205, "u", "b" * 1000), (None, "u", big), (300, "u", "long " * 400_000), (59, rows[59][1], rows[59][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as r_last")
    manifest = archive(df)
    back = read_archives(manifest)
    assert got(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(rows)
    given = {(None if i is None else str(i), (h or "").encode()) for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in given for r in back.where("record_type = 'response'").collect())
    assert {r.url for r in back.collect() if r.page_id == "201"} == {"bad%0D%0Aurl"}
    named = []
    for m in manifest.collect():
        with open(m.path.removeprefix("file://"), "rb") as f:
            assert int.from_bytes(f.read(4), "little") == DICTIONARY_FRAME and int.from_bytes(f.read(4), "little") > 0
        offsets = [o for o, _ in archived_records(m.path)]
        named += [re.search(rb"WARC-Record-ID: (\S+)", raw)[1] for _, raw in archived_records(m.path)]
        assert len(offsets) == m.records and offsets == sorted(set(offsets))
    assert len(set(named)) == len(named) - 1  # row 59 is there twice


def test_only_null_ids_and_empty_table(spark, got):
    rows = [(None, "u", "c" * 2000), (None, "v", "c" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(read_archives(archive(df)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(rows)
    assert archive(df.limit(0)).count() == 0
    assert read_archives(archive(df.limit(0))).count() == 0
