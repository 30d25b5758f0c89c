import random
import re
from collections import defaultdict

import pytest

from vellum.llm import jaccard_join as module
from vellum.llm.graph import connected_components
from vellum.llm.jaccard_join import near_duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        met = defaultdict(int)
        for x in sets[i]:
            for j in holders[x]:
                met[j] += 1
            holders[x].append(i)
        for j, n in met.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), find(i)) for i, _ in rows), key=repr)


def cases(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = " ".join(word() for _ in range(40))
    texts = []
    for g in range(30):
        base = [word() for _ in range(r.randrange(20, 120))]
        if g % 3 == 0:
            base[5:5] = passage.split()
        for _ in range(r.choice([1, 2, 5, 30 if g < 3 else 3])):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    # around the threshold: chains whose neighbours link and whose ends don't
    chain = [word() for _ in range(60)]
    for k in range(25):
        texts.append(" ".join(chain[k : k + 35]))
    texts += [passage] * 3 + ["a b c", "A b\tc", "a b", "a b c d e", "A B C D E f", "x y z w v " * 50, "x y z w v " * 51]
    ids = list(range(10, 10 + len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(1, None), (2, ""), (3, " \t\n"), (4, None)]


@pytest.mark.parametrize("seed,long,broadcast,rounds", [(1, 64, 400_000, 2), (2, 3, 0, 1), (3, 10, 400_000, 0)])
def test_against_brute_force(spark, got, monkeypatch, seed, long, broadcast, rounds):
    monkeypatch.setattr(module, "LONG_LIST", long)
    monkeypatch.setattr(module, "BROADCAST_DELIVERIES", broadcast)
    monkeypatch.setattr(module, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(module, "SEGMENT", 5)
    monkeypatch.setattr(module, "QUERY_SETS", 7)
    rows = cases(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as set", "3 as token").repartition(5)
    assert got(near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_repeated_and_empty(spark, got):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "q")], "doc_id long, text string")
    assert got(near_duplicates(df), "doc_id", "n_shingles", "component_id") == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 1, 9)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.where("doc_id = 9")).collect()[0].component_id == 9


def test_components_of_a_long_path(spark, got):
    r = random.Random(3)
    names = list(range(200))
    r.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(149)] + [(names[i], names[i + 1]) for i in range(160, 180)] + [(5, 5), (None, 3)]
    out = got(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "root")
    want = [(x, min(names[:150])) for x in names[:150]] + [(x, min(names[160:181])) for x in names[160:181]]
    assert out == sorted(want, key=repr)
