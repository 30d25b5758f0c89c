import hashlib
import random
import re

import pytest

from vellum.llm import decontaminate as module
from vellum.llm.decontaminate import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, b in items:
            b = words(b)
            n = min(10, len(b))
            if k is None or not n:
                continue
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def cases():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ß", "日本"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 9, 10, 11, 15, 40])))) for i in range(25)]
    items += [(90, items[3][1]), (91, items[4][1].upper()), (None, "some other words"), (92, None), (93, " .. "), (94, "z z z z z z z z z z z z")]
    docs = []
    for i in range(120):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))
        if i % 2:
            b = r.choice(items)[1] or ""
            w = b.split()
            a = r.randrange(len(w) + 1)
            t = t + r.choice([" ", ", ", "\n"]) + " ".join(w[a : a + r.randrange(1, 20)]) + " " + t[:30]
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "... !"), (203, "z " * 30), (204, (docs[1][1] + " ") * 50), (1, docs[1][1]), (None, items[10][1])]
    return docs, items


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_against_brute_force(spark, got, monkeypatch, broadcast):
    monkeypatch.setattr(module, "BROADCAST_WINDOWS", broadcast)
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as hash", "3 as w", "4 as d_id", "5 as c_key", "6 as _dc_id", "7 as own_key", "8 as aside_0")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(d, b), *COLUMNS) == brute(docs, items)


def test_every_long_shared_span_is_found(spark, got):
    r = random.Random(9)
    item = [f"i{r.randrange(9)}" for _ in range(200)]
    docs = [(i, " ".join([f"x{j}" for j in range(i % 7)] + item[i : i + 10] + ["y"])) for i in range(190)]
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert got(out, *COLUMNS) == brute(docs, [(1, " ".join(item))])
    assert out.where("n_hit >= 10").count() == 190


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(d.limit(0), b).count() == 0
    assert [r.contaminated for r in decontaminate(d, b.limit(0)).collect()] == [False]
    assert [r.n_hit for r in decontaminate(d, b).collect()] == [2]
