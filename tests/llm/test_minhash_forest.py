import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vellum.llm.minhash_forest import VALUES, alike, minhash_duplicates, signatures

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
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
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows), key=repr)


def cases(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = " ".join(word() for _ in range(40))
    texts = []
    for g in range(30):
        base = [word() for _ in range(r.randrange(20, 150))]
        if g % 3 == 0:
            base[5:5] = passage.split()
        for _ in range(r.choice([1, 2, 5, 60 if g < 3 else 3])):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(90)]
    texts += [" ".join(chain[k : k + 50]) for k in range(0, 36, 2)]
    texts += [passage] * 3 + ["a b c", "A b\tc", "a b", "a b c d", "A B C D e f", "x y z w v " * 50, "x y z w v " * 51]
    ids = list(range(10, 10 + len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(1, None), (2, ""), (3, " \t\n"), (4, None)]


@pytest.mark.parametrize("seed,crowd", [(1, 1024), (2, 10), (3, 3)])
def test_against_brute_force(spark, got, seed, crowd):
    rows = cases(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as set", "3 as region").repartition(5)
    assert got(minhash_duplicates(df, crowd=crowd), *NAMES) == brute(rows)


def test_repeated_and_empty(spark, got):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "q")], "doc_id long, text string")
    assert got(minhash_duplicates(df), *NAMES) == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (9, 1, 9, True)], key=repr)
    assert minhash_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        x = r.integers(0, 2**64, 3000, dtype=np.uint64)
        y = np.concatenate([x[: int(3000 * share)], r.integers(0, 2**64, 3000 - int(3000 * share), dtype=np.uint64)])
        a, b, empty = signatures([np.sort(x), np.sort(y), x[:0]])
        want = 3000 * share / (6000 - 3000 * share)
        assert abs((a == b).mean() - want) < 5 * (want * (1 - want) / VALUES) ** 0.5 and not empty.any()
    assert alike(np.arange(8, dtype=np.uint64), [np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(11, dtype=np.uint64)]).tolist() == [True, True, False]
