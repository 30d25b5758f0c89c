import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from vellum.llm import prefix_trie as module
from vellum.llm.prefix_trie import SpillingQueue, placed_words, prefix_trie, trie_of
from vellum.llm.shared import scratch, settled, written

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def talks_of(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            talks[c].append((-(2**63) if t is None else t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(talks):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[k] for k in kids[node]]
        totals[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(talks[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases(seed):
    r = random.Random(seed)
    rows = []
    for c in range(150):
        depth = r.choice([0, 1, 3, 9])
        shared = random.Random(c % 4)
        turns = [(shared.choice(["user", "assistant", None]), f"say it {shared.randrange(3)} times") for _ in range(depth)]
        turns += [(r.choice(["user", None]), r.choice([None, "", "yes", "well, no", "a\tb\n c"])) for _ in range(r.randrange(0, 4))]
        rows += [(c, t + c % 3, *x) for t, x in enumerate(turns)]
    rows += [(c, 0, "user", "same") for c in range(200, 240)] + [(None, 0, "user", "lost"), (300, None, "a", "b"), (300, None, "a", "b"), (301, None, None, None)]
    rows += [(c, t, "user", "long talk") for c in (400, 401) for t in range(60)] + [(401, 99, "user", "end")]
    rows += [(500 + i, t, "user", f"comb {t if t < i else -i}") for i in range(30) for t in range(i + 1)]
    return rows


@pytest.mark.parametrize("seed,part,branch,queue", [(1, 1024, 1024, 10**6), (2, 8, 3, 2), (3, 4, 2, 5)])
def test_against_brute_force(spark, got, monkeypatch, seed, part, branch, queue):
    monkeypatch.setattr(module, "SEGMENT_IDS", 7)
    monkeypatch.setattr(module, "READ_BACK", 3)
    rows = cases(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as owner", "2 as pos").repartition(5)
    with scratch(spark):
        placed = written(placed_words(df), "test-turns")
        out = settled(trie_of(placed, placed.select("conv").distinct(), part, branch, queue), "test-trie")
    assert got(out, *NAMES) == brute(talks_of(rows))


def test_operator_and_empty_table(spark, got):
    rows = [(7, 1, "user", "a b"), (8, 1, "user", "a b"), (8, 1, "user", "a b"), (9, 1, "user", "x" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie(df), *NAMES) == brute(talks_of(rows))
    assert prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_query_against_brute_force_and_sql(spark, got, tmp_path, seed):
    from vellum.llm.queries import ORACLES, op11_prefix_trie

    rows = [x for x in cases(seed) if x[0] not in (40, 100)]  # families without a first conversation
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = got(op11_prefix_trie(spark, str(tmp_path)), *NAMES)
    assert out == brute(rebuilt(talks_of(rows)))
    duckdb.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert out == sorted(duckdb.sql(ORACLES["op11_prefix_trie"]).project(", ".join(NAMES)).fetchall(), key=repr)


def test_queue_spills_and_takes_in_order(tmp_path):
    r = random.Random(6)
    sent = [(r.randrange(20), r.randrange(5), r.randrange(9), r.randrange(9)) for _ in range(500)]
    queue = SpillingQueue(f"file://{tmp_path}/queue", 16)
    for x in sent:
        queue.put(*x)
    for depth in range(19, -1, -1):
        for conv in range(5):
            mine = [x for x in sent if x[:2] == (depth, conv)]
            assert queue.take(depth, conv) == (sum(x[2] for x in mine), sum(x[3] for x in mine))
    assert not queue.held and not queue.spilled and queue.files > 10
