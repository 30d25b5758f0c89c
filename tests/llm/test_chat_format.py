import random

from vellum.llm.chat_format import format_chats


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((-(2**63) if t is None else t, role or "user", text or ""))
    talks = {c: tuple(x[1:] for x in sorted(v)) for c, v in by.items()}
    keep = {}
    for c, v in talks.items():
        if not any(w != v and w[: len(v)] == v for w in talks.values()):
            keep[v] = min(keep.get(v, c), c)
    return sorted([(c, len(v), "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in v)) for v, c in keep.items()], key=repr)


def cases():
    r = random.Random(4)
    rows = []
    for c in range(80):
        base = random.Random(c % 9)
        full = [(base.choice(["user", "assistant", None]), f"say {base.randrange(5)}") for _ in range(9)]
        for t, (role, text) in enumerate(full[: r.randrange(1, 10)]):
            rows.append((c, t + (c % 3), role, text if r.random() > 0.05 else None))
    rows += [(500, None, None, None), (501, 0, "user", ""), (None, 0, "user", "lost"), (502, 1, "user", "b"), (502, 1, "user", "a"), (502, 1, "user", "a"), (503, 0, "user", "x" * 50_000)]
    return rows


def test_against_brute_force(spark, got):
    rows = cases()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as part", "3 as n_turns")
    assert got(format_chats(df), "conv_id", "n_turns", "chat") == brute(rows)


def test_parts_of_long_conversations(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(50)] + [(2, t, "user", f"t{t}") for t in range(30)] + [(3, t, "user", f"t{t}") for t in range(49)] + [(3, 49, "user", "other")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=8).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in out} == {1, 3} and all(r.n_turns == 50 for r in out) and [r.part for r in out] == [*range(7)] * 2
    assert "".join(r.chat for r in out if r.conv_id == 1) == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(50))


def test_long_and_tied_conversations_against_sql_and_brute_force(spark, tmp_path):
    import duckdb

    from vellum.llm.queries import ORACLES, op10_chat_format

    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2999)]  # 2 is a snapshot of 1
    rows += [(3, 7, "user", "same")] * 2500 + [(4, 7, "user", "same")] * 2499 + [(5, 7, "user", "same")] * 2499 + [(5, 7, "user", "sane")]
    rows += [(6, None, None, f"n{t:04}") for t in range(1500)] + [(7, 5000, "assistant", "late")]
    rows += [x for i in range(10, 50, 2) for x in [(i, 1, "user", f"a{i}"), (i + 1, 1, "user", f"a{i}"), (i + 1, 1, "user", f"b{i}")]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op10_chat_format(spark, str(tmp_path)).collect()
    duckdb.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(ORACLES["op10_chat_format"])
    assert sorted(tuple(r) for r in out) == sorted(want.project(", ".join(out[0].__fields__)).fetchall())
    chats = {}
    for r in format_chats(spark.read.parquet(f"{tmp_path}/conversations.parquet")).orderBy("conv_id", "part").collect():
        chats[r.conv_id] = r.n_turns, chats.get(r.conv_id, (0, ""))[1] + r.chat
    assert sorted((c, n, x) for c, (n, x) in chats.items()) == sorted(brute(rows))


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_snapshots_that_end_inside_a_tie(spark, got):
    rows = [x for i in range(0, 40, 2) for x in [(i, 1, "user", f"a{i}"), (i + 1, 1, "user", f"a{i}"), (i + 1, 1, "user", f"b{i}")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(format_chats(df), "conv_id", "n_turns", "chat") == brute(rows) and len(brute(rows)) == 20
