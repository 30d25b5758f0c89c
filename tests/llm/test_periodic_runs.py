import hashlib
import random
import re
import zlib

import pytest

from vellum.llm.periodic_runs import periodic_runs, runs_of


def brute(w, periods=4, least=6):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            a = x
            while x < n - q and w[x] == w[x + q]:
                x += 1
            length = x - a + q
            if length >= max(least, periods * q) and not any(all(w[j] == w[j + p] for j in range(a, a + length - p)) for p in range(1, q)):
                out.add((a, length, q))
    return sorted(out)


def repetitive(r, n):
    words, letters = [], r.choice([1, 2, 2, 3, 5])
    while len(words) < n:
        if r.random() < 0.3 or not words:
            words += [f"w{r.randrange(letters)}" for _ in range(r.randrange(1, 12))]
        else:
            p = r.randrange(1, min(len(words), 30) + 1)
            words += (words[-p:] * 8)[: r.randrange(1, 7 * p + 1)]
    return words[:n]


@pytest.mark.parametrize("appended", [1, 2, 7, 50, 10**6])
def test_runs_against_brute_force(appended):
    r = random.Random(appended)
    for _ in range(60):
        words = repetitive(r, r.randrange(0, 200))
        for periods, least in [(4, 6), (2, 2), (3, 9)]:
            assert runs_of(words, periods, least, appended) == brute(words, periods, least), words


def test_long_texts():
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    assert runs_of(base * 5 + ["x"]) == [(0, 15000, 3000)]
    assert runs_of(["a"] * 100_000 + ["b"] * 5 + ["c"] * 6, appended=1000) == [(0, 100_000, 1), (100_005, 6, 1)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(((length, -s, -q) for s, length, q in runs), default=None)
    first = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *first, digest, hashlib.sha256(kept.encode()).hexdigest())


def test_query_against_brute_force(spark, got, tmp_path):
    from vellum.llm.queries import op13_periodic_runs

    r = random.Random(9)
    rows = [(i, " ".join(repetitive(r, r.randrange(0, 120)))) for i in range(150)] + [(i, " a\tb\n c\x1fd  e" * 9) for i in range(150, 200)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (5, "b " * 6), (5, "b " * 6)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as n_words", "3 as start").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got(op13_periodic_runs(spark, str(tmp_path)), *names) == sorted((expected(*x) for x in rows), key=repr)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a a a a a a a b", 5)], "doc_id long, text string, runs long")
    assert [tuple(x) for x in periodic_runs(df).collect()] == [(1, 8, [(0, 7, 1)], "a b")]
    assert periodic_runs(df.limit(0)).count() == 0
