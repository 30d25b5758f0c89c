import random
import zlib

import numpy as np

from vellum.llm.language_id import Mixture, identify, identify_held_out, learn_languages, trigrams
from vellum.llm.quality_classifier import WIDTH, chunks, classify_held_out, train
from vellum.session import table

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    out = identify_held_out(docs)
    held = [r for r in out.collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_mixtures_and_defined_results(spark, got):
    docs = table(spark, SF, "documents")
    mixture = learn_languages(docs)
    by = {r.lang: r.text for r in docs.orderBy("doc_id").collect() if len(r.text) > 3000}
    mixed = by["en"][:3000] + " " + by["de"][:1500]
    lang, share, found = mixture.infer(mixed)
    assert lang == "en" and {x for x, _ in found} == {"en", "de"} and 0.55 < share < 0.8
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "日本"), (None, by["fr"]), (6, by["es"]), (6, by["es"]), (7, by["de"] * 60)]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'zz' as lang", "'clash' as languages")
    out = got(identify(df, mixture), "doc_id", "lang_pred")
    assert [x for x in out if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert (None, "fr") in out and out.count((6, "es")) == 2 and (7, "de") in out
    assert identify(df.limit(0), mixture).count() == 0
    none = Mixture([], np.zeros((0, 2**15)))
    assert none.infer("words") == ("und", 0.0, [])
    assert learn_languages(df.limit(0)).languages == []


def test_trigrams_ignore_case_and_symbols():
    assert trigrams("Ab, cd!").tolist() == trigrams("ab   cd").tolist()


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    out = {r.doc_id: r for r in classify_held_out(docs, labels).collect()}
    held = [(out[r.doc_id].score, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_chunks_cover_every_byte():
    for n in (0, 1, WIDTH - 1, WIDTH, WIDTH + 1, 1000, 1001):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        c = chunks(data)
        at = {k * 8 + j: int(c[k, j]) for k in range(len(c)) for j in range(WIDTH)}
        assert [at[i] for i in range(n)] == list(data)


def test_score_sees_the_end_of_a_long_text():
    texts = [b"good words here " * 20 for _ in range(40)] + [b"good words here " * 19 + b"@@##@@##@@##@@##" for _ in range(40)]
    net = train(texts, [1] * 40 + [0] * 40)
    long = b"good words here " * 30_000
    assert net.probability(long) > 0.5 > net.probability(long + b"@@##@@##@@##@@##")
    assert net.probability(b"") == train(texts, [1] * 40 + [0] * 40).probability(b"")


def test_labels_of_one_kind_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as l_label")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = classify_held_out(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert classify_held_out(docs.limit(0), labels).count() == 0
    assert classify_held_out(docs, labels.limit(0)).count() == 4


def test_scores_against_brute_force(spark):
    """The network's forward pass written out, byte by byte, over whole texts."""
    from math import exp

    from vellum.llm.quality_classifier import PAD, STRIDE, score_quality

    r = random.Random(5)
    texts = [None, "", "a", "é" * 9, "good words " * 5, *("".join(chr(r.randrange(32, 400)) for _ in range(r.randrange(1, 90))) for _ in range(12))]
    net = train([(t or "").encode() for t in texts], [i % 2 for i in range(len(texts))])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in score_quality(rows, net).collect():
        data = list((row.text or "").encode())
        top = [float("-inf")] * len(net.bias)
        for at in range(0, max(1, len(data) - WIDTH + STRIDE), STRIDE):
            chunk = (data[at : at + WIDTH] + [PAD] * WIDTH)[:WIDTH]
            for f in range(len(top)):
                own = net.bias[f] + sum(float(net.embed[b][e]) * float(net.filters[j * 8 + e][f]) for j, b in enumerate(chunk) for e in range(8))
                top[f] = max(top[f], own)
        total = net.offset[0] + sum(max(0, x) * w for x, w in zip(top, net.weight, strict=True))
        assert abs(row.score - 1 / (1 + exp(-total))) < 1e-4 and row.predicted == int(row.score >= 0.3)


def test_long_labelled_texts_are_learned_from_whole(spark, monkeypatch):
    from vellum.llm import quality_classifier as module

    long = "plain words of a page " * 5_000
    docs = spark.createDataFrame([(i, long + ("" if i % 2 else "&&&&" * 300)) for i in range(1, 41)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(50, 1)], "doc_id long, quality int")
    seen, train = [], module.train
    monkeypatch.setattr(module, "train", lambda texts, given: seen.append((texts, given)) or train(texts, given))
    out = classify_held_out(docs, labels).where("doc_id < 50").collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)
    whole = {r.text.encode() for r in docs.where("text is not null").collect()} | {b""}
    assert set(seen[0][0]) <= whole and len(seen[0][0]) > 25
    module.learn_quality(docs, labels, sample_bytes=5 * len(long) + 20_000)
    assert 3 <= len(seen[1][0]) <= 6 and set(seen[1][0]) <= whole
    assert len(seen) == 2


def test_numerals_are_no_letters():
    from vellum.llm.language_id import has_letter

    assert not any(map(has_letter, ("½ ② ³ Ⅷ", "12 _ -", "", "٣"))) and all(map(has_letter, ("½ a", "ª", "語", "ǅ")))


def brute_mixture(languages, p, x, penalty):
    """Greedy sets of languages and EM over single trigrams, without arrays."""
    from math import log

    n = len(x)
    alone = [sum(log(q[b]) for b in x) for q in p]
    chosen = [max(range(len(p)), key=lambda i: alone[i])]
    share, best = {chosen[0]: 1.0}, alone[chosen[0]]
    while len(chosen) < len(languages):
        mix = [sum(share[i] * p[i][b] for i in chosen) for b in x]
        slope = {i: sum(p[i][b] / m for b, m in zip(x, mix, strict=True)) / n for i in range(len(p)) if i not in chosen}
        more = max(slope, key=slope.get)
        if slope[more] <= 1:
            break
        pi = {**{i: 0.8 * s for i, s in share.items()}, more: 0.2}
        while True:
            gained = dict.fromkeys(pi, 0.0)
            for b in x:
                total = sum(pi[i] * p[i][b] for i in pi)
                for i in pi:
                    gained[i] += pi[i] * p[i][b] / total / n
            moved, pi = max(abs(gained[i] - pi[i]) for i in pi), gained
            if moved <= 1e-6:
                break
        reached = sum(log(sum(pi[i] * p[i][b] for i in pi)) for b in x)
        if reached - best <= penalty * log(n + 1):
            break
        chosen, share, best = [*chosen, more], pi, reached
    return {languages[i]: s for i, s in share.items()}


def test_mixtures_of_any_number_of_languages_against_brute_force():
    from vellum.llm.language_id import BUCKETS, PENALTY, SMOOTHING

    r = random.Random(2)
    names = [f"l{i}" for i in range(7)]
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    letters = {x: r.sample(alphabet, 7) for x in names}
    say = lambda x, n: " ".join("".join(r.choice(letters[x]) for _ in range(6)) for _ in range(n))
    counts = np.array([np.bincount(trigrams(say(x, 3000)), minlength=BUCKETS) for x in names])
    model = Mixture(names, counts)
    for mixed in (names[:1], names[:2], names[1:4], names[:6], names):
        text = " ".join(say(x, 150) for x in mixed)
        lang, score, found = model.infer(text)
        want = brute_mixture(names, ((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)).tolist(), trigrams(text).tolist(), PENALTY)
        assert dict(found).keys() == want.keys() == set(mixed)
        assert all(abs(s - want[x]) < 0.01 for x, s in found) and score == found[0][1] == max(s for _, s in found) and lang == found[0][0]


def test_rare_languages_are_learned_and_nothing_learned_is_unknown(spark, monkeypatch):
    from vellum.llm import language_id

    monkeypatch.setattr(language_id, "LEAST_DOCS", 5)
    rows = [(i, "common words in the usual tongue", "en") for i in range(3000)] + [(9000 + i, "zyx qwv zzyx vwq", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn_languages(df, sample_docs=20).languages == ["en", "rare"]
    out = identify_held_out(df.withColumn("lang", df.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in out] == [("und", 0.0)]
    assert identify_held_out(df.limit(0)).count() == 0
