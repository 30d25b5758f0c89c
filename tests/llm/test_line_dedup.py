import random
from collections import defaultdict

from vellum.llm.line_dedup import dedup_lines


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(" \t\n\x0b\x0c\r"):
                if s is not None:
                    sites[x].add(s)
                if i is not None:
                    first[x] = min(first.get(x, (i, k)), (i, k))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for k, x in enumerate(lines) if len(sites.get(x, ())) < least or not x.strip(" \t\n\x0b\x0c\r") or first.get(x) == (i, k)]
        out.append((i, "\n".join(keep), sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, got):
    r = random.Random(2)
    lines = [f"line {i}" for i in range(40)] + ["", " ", "\t"]
    rows = [(i, "\n".join(r.choice(lines[: r.choice([10, 43])]) for _ in range(r.randrange(12))), r.choice(["a", "b", "c", "d", "e", None])) for i in range(150)]
    rows += [(200, None, "a"), (201, "", "b"), (202, "line 1\nline 1\n\n" * 200, "c"), (3, rows[3][1], rows[3][2]), (None, "line 1\nline 2", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as gone", "3 as n_removed", "4 as at", "5 as _ld_id", "6 as own_key", "7 as aside_0", "8 as l_id")
    for least in (1, 3, 5, 6):
        out = dedup_lines(df, min_sites=least)
        assert got(out, "doc_id", "text", "n_lines", "n_removed") == brute(rows, least)
        assert all((x.line, x.gone, x.at, x._ld_id, x.own_key, x.aside_0, x.l_id) == (1, 2, 4, 5, 6, 7, 8) for x in out.collect())


def test_many_sites_beyond_the_sketch_error(spark, got):
    rows = [(i, f"own {i}\neverywhere\n" + ("often" if i < 1000 else "rare" if i < 1100 else f"x{i}"), f"site{i}") for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (1000, 1001, 100):
        assert got(dedup_lines(df, min_sites=least), "doc_id", "text", "n_lines", "n_removed") == brute(rows, least)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
