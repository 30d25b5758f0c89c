import random
import re
from collections import Counter

from vellum.llm.quality_rules import base_counts, quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(spark, got):
    r = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a b c d e a b c d e", "x " * 400, "é\u00a0b 🎉 #|<>", "l\nl\n l\nl", "a\x0bb\x0cc\rd"]
    texts += ["".join(r.choice(["a", "b", " ", "\n", "#", " c d e f g "]) for _ in range(r.randrange(120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = got(base_counts(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert out == sorted([(i, *brute(t)) for i, t in enumerate(texts)], key=repr)


def test_target_words_score_higher_and_rules_hold(spark):
    good = "the quick brown fox jumps over a lazy dog and runs far away from here"
    bad = "$$$ !!! @@@ ~~~ ^^^ $$$ !!! @@@ qq ~~~ ^^^ zz $$$ xx !!! yy"
    rows = [(i, good + f" today {i}") for i in range(30)] + [(100 + i, bad + f" {i}") for i in range(30)] + [(200, None), (201, ""), (None, good), (5, good + " today 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as q_tokens2")
    trusted = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long")
    out = quality_rules(df, trusted).collect()
    assert len(out) == len(rows)
    is_good = lambda r: bool(r.text) and r.text.startswith("the")
    least, most = min(r.llr for r in out if is_good(r)), max(r.llr for r in out if r.text and not is_good(r))
    assert least > most
    assert all(r.kept == (is_good(r)) for r in quality_rules(df, trusted, threshold=least).collect())
    assert all(r.llr == 0 for r in out if not r.text)
    assert {r.llr for r in quality_rules(df, trusted.limit(0)).collect()} == {0.0}
    assert quality_rules(df.limit(0), trusted).count() == 0


def test_ratios_and_verdicts_against_brute_force(spark):
    import math

    import regex

    from vellum.llm.quality_rules import BUCKETS

    r = random.Random(8)
    texts = [" ".join(r.choice(["alpha", "beta,", "gamma!", "dé", "x1", "--", "omega"]) + str(r.randrange(4)) for _ in range(r.randrange(1, 60))) for _ in range(60)] + [None, "", "!!", "one"]
    rows = [*enumerate(texts), (3, "another text of one id that is long enough to be kept, if its words are"), (4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as _q_text", "'b' as _q_tokens", "'c' as own_id", "'d' as single", "'e' as llr", "'f' as aside_0")
    trusted = set(range(0, 60, 3))
    out = quality_rules(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), threshold=-0.05).collect()
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", t or "")
    grams = {(w,) for _, t in rows for w in split(t)} | {p for _, t in rows for w in [split(t)] for p in zip(w, [*w[1:], None], strict=False)}
    asked = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None, len(g)) for g in grams], "a string, b string, n int")
    bucket = {(x.a, x.b)[: x.n]: x.h for x in asked.selectExpr("*", f"if(n = 1, xxhash64(a), xxhash64(1, a, b)) & {BUCKETS - 1} as h").collect()}
    of = lambda t: [bucket[g] for w in [split(t)] for p in zip(w, [*w[1:], None], strict=False) for g in ((p[0],), p)]
    n, t = Counter(b for _, x in rows for b in of(x)), Counter(b for i, x in rows if i in trusted for b in of(x))
    ratio = {b: math.log((t[b] + 0.5) / (t.total() + BUCKETS / 2)) - math.log((n[b] + 0.5) / (n.total() + BUCKETS / 2)) for b in n}
    want = []
    for i, x in rows:
        llr = sum(ratio[b] for b in of(x)) / max(1, len(of(x)))
        words, _, _, _, repeat = brute(x)
        want.append((i, x or "", round(llr, 5), not (words < 10 or 100 * repeat > 20 * words) and llr >= -0.05))
    assert sorted((y.doc_id, y.text or "", round(y.llr, 5), y.kept) for y in out) == sorted(want)
    assert {y.kept for y in out} == {True, False} and all((y._q_text, y._q_tokens, y.own_id, y.single, y.aside_0) == tuple("abcdf") for y in out)


def test_very_long_texts(spark):
    from vellum.llm.decontaminate import decontaminate
    from vellum.llm.line_dedup import dedup_lines
    from vellum.llm.quality_rules import quality_rules

    words = [f"w{i}" for i in range(200_000)]
    text = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)) + "\n" + " ".join(words[:40])
    docs = spark.createDataFrame([(i, text if i == 1 else "the last line\nand one more", f"s{i % 12}") for i in range(1, 30)], "doc_id long, text string, source string")
    base = quality_rules(docs, docs.where("doc_id = 2")).where("doc_id = 1").first()
    assert (base.n_words, base.n_dup_lines, base.n_repeat_words) == (200_040, 1, 80)
    items = spark.createDataFrame([(7, " ".join(words[199_980:199_995])), (8, "nowhere " * 12)], "item_id long, text string")
    hit = decontaminate(docs, items).where("doc_id = 1").first()
    assert (hit.n_words, hit.n_hit, hit.n_items) == (200_040, 15, 1)
    lines = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert lines[1].text == text and lines[1].n_lines == 5001 and lines[3].n_removed == 2
