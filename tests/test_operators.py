"""Operators on small fixtures."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.numbers import half_up, iso_date, months_inclusive
from vellum.operators.checks import audit_citations, cost_rollup, grounded, missing_items
from vellum.operators.fiscal import burden_differential, rates, verdict
from vellum.operators.fusion import fuse, rerank_all_or_nothing
from vellum.operators.lexical import UNSAFE, expand_synonyms, query_tokens
from vellum.operators.laws import block_class, child_offsets, children_in_order, law_provisions, merge_orphans, split_headed_articles, split_page_headers
from vellum.operators.parsing import citations_of, diff_words, normalised_id, own_references_of, sibling_order, truncate_at
from vellum.operators.pricing import percentiles, price_statistics, relevance
from vellum.operators.sequence import fixed_window_limits, packed_chunks
from vellum.operators.temporal import as_of_join, lookup, resolve_references
from vellum.operators.vector import nearest_to_each


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_query_profiles():
    assert query_tokens("luva procedimento", "catalogue") == ["luva", "procedimento"]
    assert query_tokens("tv de 50 polegadas", "catalogue") == ["polegadas"]
    assert query_tokens("de a e", "catalogue") == []
    assert query_tokens('luva* (nitrilica) "caixa"', "catalogue") == ["luva", "nitrilica", "caixa"]
    assert query_tokens("Art. 5º e o §2", "rulings") == ["art", "5º"]
    with pytest.raises(ValueError):
        query_tokens("x", "other")


def test_synonyms_and_unsafe_patterns():
    assert expand_synonyms("notebook resistente") == "notebook resistente laptop computador portátil"
    assert expand_synonyms("notebooks") == "notebooks"
    assert UNSAFE.search("(a+)+") and not UNSAFE.search("ab+c")


def test_fusion_and_rerank(spark):
    lane = lambda *ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    found = {r.id: r.rrf for r in fuse([lane("x", "y"), lane("y", "z")], "id").collect()}
    assert found == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6), "z": round(1 / 62, 6)}
    assert fuse([lane("a")], "id", 10).first().rrf == round(1 / 11, 6)
    pool = spark.createDataFrame([("a", 0.03, 0.01), ("b", 0.02, 0.9), ("c", 0.01, 0.5)], "id string, rrf double, rerank double")
    assert [r.id for r in rerank_all_or_nothing(pool, "id").orderBy("place").collect()] == ["b", "c"]
    for bad in (None, float("nan"), float("inf")):
        partial = pool.withColumn("rerank", F.when(F.col("id") == "c", F.lit(bad).cast("double")).otherwise(F.col("rerank")))
        assert [r.id for r in rerank_all_or_nothing(partial, "id").orderBy("place").collect()] == ["a", "b", "c"]
    assert rerank_all_or_nothing(pool.limit(0), "id").count() == 0


def stats(spark, rows):
    df = spark.createDataFrame(rows, "item int, unit string, price long, day date, ok boolean")
    return price_statistics(df, "item", "unit", "price", "day", "ok").collect()[0]


def test_price_statistics(spark):
    d = dt.date(2025, 1, 2)
    r = stats(spark, [(1, "CX", p, d, True) for p in (2000, 2250, 2500)] + [(1, "UN", 19, d, True)])
    assert (r.unit, r.n, r.median, r.discarded_unit) == ("CX", 3, 2250, 1)
    r = stats(spark, [(1, "CX", p, d, True) for p in (1900, 2000, 2250, 2500)])
    assert (r.p25, r["median"]) == (1975, 2125)
    r = stats(spark, [(1, None, 5, None, False)])
    assert (r.n, r.median, r.min, r.discarded_relevance) == (0, None, None, 1)
    r = stats(spark, [(1, "B", 1, d, True), (1, "A", 3, d, True), (1, None, 9, d, True)])
    assert r.unit == "A"


def test_relevance(spark):
    df = spark.createDataFrame([("Luva de procedimento nitrílica",), ("Caneta azul",)], "t string")
    out = [(r.relevance_score, r.relevant) for r in relevance(df, "luva para procedimento", F.col("t")).collect()]
    assert out == [(1.0, True), (0.0, False)]
    assert all(r.relevant for r in relevance(df, "de para", F.col("t")).collect())


def test_rounding_and_dates(spark):
    r = one(spark, half_up(F.lit(-2.5)).alias("a"), half_up(F.lit(0.125), 2).alias("b"), months_inclusive(F.lit("2024-11-30").cast("date"), F.lit("2025-01-01").cast("date")).alias("c"), months_inclusive(F.lit("2025-02-01").cast("date"), F.lit("2025-01-01").cast("date")).alias("d"), iso_date(F.lit("2024-02-30x")).alias("e"), iso_date(F.lit("2024-02-28T1")).alias("f"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (-2, 0.13, 3, 0, None, dt.date(2024, 2, 28))


@pytest.mark.parametrize("year,cbs,ibs,want", [(2025, 8.8, 18.0, None), (2026, None, None, (0.9, 0.1)), (2027, 8.8, None, (8.7, 0.1)), (2027, None, 18.0, None), (2031, 8.8, 18.0, (8.8, 5.4)), (2033, 8.8, 18.0, (8.8, 18.0)), (2030, 8.8, None, None)])
def test_rates(spark, year, cbs, ibs, want):
    r = one(spark, rates(F.lit(year), F.lit(cbs).cast("double"), F.lit(ibs).cast("double")).alias("r")).r
    assert (r.problem is None) == (want is not None)
    if want:
        assert (round(r.cbs, 6), round(r.ibs, 6)) == want


def test_burden_of_2026_is_compensated(spark):
    row = ("c", dt.date(2026, 1, 1), dt.date(2026, 12, 31), None, None, None, False, 0.0, 1_000_000, 27.25, True)
    df = spark.createDataFrame([row], "contract string, start date, end date, ref_cbs double, ref_ibs double, reduction double, government boolean, credits double, value_cents long, pre double, simplified boolean")
    r = burden_differential(df, F.lit("2026-07-01").cast("date")).first()
    assert (r.difference, r.annual_cents, r.months_left, r.alerts, r.failure) == (-27.25, -272500, 6, "simplified regime", None)


@pytest.mark.parametrize("facts,want", [((True, False, True, True, 10, 1.0, 5), ("improcedente", 0, "fora_de_escopo")), ((False, True, True, True, 10, 1.0, 5), ("improcedente", 0, "intempestivo")), ((False, False, True, False, 10, 1.0, 5), ("diligencia", 0, "comprovacao_insuficiente")),
                                        ((False, False, True, True, -1, -1.0, 5), ("improcedente", 0, "carga_reduzida")), ((False, False, True, True, 0, 0.0, 5), ("improcedente", 0, "sem_desequilibrio")), ((False, False, True, True, 10, 0.4, 5), ("improcedente", 0, "imaterial")),
                                        ((False, False, True, True, 10, 1.0, 5), ("procedente", 5, "pleito_integral")), ((False, False, True, True, 10, 1.0, 50), ("parcialmente_procedente", 10, "pleito_excede_delta")), ((False, False, True, True, 10, 1.0, None), ("diligencia", 0, "comprovacao_insuficiente"))])
def test_verdict(spark, facts, want):
    *flags, delta, points, claim = facts
    v = one(spark, verdict(*(F.lit(x) for x in flags), F.lit(delta), F.lit(points), F.lit(claim).cast("long")).alias("v")).v
    assert (v.verdict, v.value, v.reason) == want


def sequential(calls, per_minute, per_day):
    minutes, days, out = {}, {}, {}
    for c, s, i in sorted(calls):
        m, d = minutes.get((c, s // 60), 0), days.get((c, s // 86400), 0)
        scope = "minute" if m >= per_minute else "day" if d >= per_day else None
        if scope is None:
            minutes[c, s // 60], days[c, s // 86400] = m + 1, d + 1
        out[i] = (scope is None, scope, None if scope is None else (60 - s % 60 if scope == "minute" else 86400 - s % 86400))
    return out


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_limiter_equals_the_sequential_one(spark, seed):
    r = random.Random(seed)
    calls = [(r.randrange(3), 86400 * 19000 + r.randrange(86400 * 2 if r.random() < 0.3 else 400), i) for i in range(120)]
    df = spark.createDataFrame(calls, "client int, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    m, d = r.randrange(1, 4), r.randrange(1, 12)
    got = {x.id: (x.allowed, x.scope, x.retry_after) for x in fixed_window_limits(df, "client", "ts", "id", m, d).collect()}
    assert got == sequential(calls, m, d)


def test_as_of_join_and_lookup(spark):
    v = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, None, "b"), (1, 4, 6, "c"), (2, 5, 7, "d")], "e int, start int, end int, text string")
    f = spark.createDataFrame([(1, -1), (1, 0), (1, 5), (1, 10), (2, 6), (2, 7), (3, 1)], "e int, at int")
    out = {(r.e, r.at): r.text for r in as_of_join(f, v, "e", "at", "start", "end", ["text"]).collect()}
    assert out == {(1, -1): None, (1, 0): "a", (1, 5): "c", (1, 10): "b", (2, 6): "d", (2, 7): None, (3, 1): None}
    assert [r.text for r in lookup(v, e=1, end=None).collect()] == ["b"]


def test_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "aaaa\n\n bbbb "), (1, 2, "c" * 30 + "\n\n\n\ndd"), (2, 1, "")], "d int, p int, t string")
    out = [(r.d, r.chunk, r.text, r.first_page, r.last_page) for r in packed_chunks(pages, "d", "p", "t", 20).orderBy("d", "chunk").collect()]
    assert out == [(1, 0, "aaaa\n\nbbbb", 1, 1), (1, 1, "c" * 30, 2, 2), (1, 2, "dd", 2, 2)]


def test_text_functions(spark):
    r = one(spark, tx.slug(F.lit(" Ação  & Reação! ")).alias("slug"), tx.norm_slug(F.lit("Lei Complementar nº 214/2025")).alias("norm"), tx.provision_ref(F.lit("Art 5º, § 3º, IV, b")).alias("ref"), tx.preview(F.lit("x" * 300), 280).alias("cut"), tx.audit_form(F.lit("﻿a​  b\n")).alias("audit"), tx.canonical(F.lit("a \r\nb\t\n\n")).alias("canon"), tx.positive_code(F.lit("12x")).alias("code"))
    assert (r.slug, r.norm, tuple(r.ref), len(r.cut), r.audit, r.canon, r.code) == ("acao-reacao", "lc-214-2025", (5, "3", "IV", "b"), 280, "a b", "a\nb\n", None)


def blocks_of(spark, texts, step=100):
    rows = [(1, i, i * step, i * step + len(t), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document int, seq int, start int, stop int, text string")


def test_law_parsing(spark):
    lines = ["LEI Nº 1", "Art. 1º Texto.", "I - primeiro;", "a) letra;", "§ 1º Par.", "II - outro;", "Art. 2-A Novo.", "Parágrafo único. Fim.", "Art. 3º ........ 12"]
    out = [(r.kind, r.path, r.parent, r.depth, r.span_id) for r in law_provisions(blocks_of(spark, lines)).orderBy("place").collect()]
    assert out == [
        ("article", "art1", None, 0, "ART-001"), ("item", "art1-incI", "art1", 1, "INC-001-I"), ("letter", "art1-incI-ala", "art1-incI", 2, "ALI-001-I-a"), ("paragraph", "art1-par1", "art1", 1, "PAR-001-1"),
        ("item", "art1-par1-incII", "art1-par1", 2, "INC-001-1-II"), ("article", "art2-A", None, 0, "ART-002-A"), ("paragraph", "art2-A-parunico", "art2-A", 1, "PAR-002-A-0"),
    ]
    s = spark.createDataFrame([("item", "IX"), ("item", "V"), ("letter", "b"), ("paragraph", "unico"), ("article", "10"), ("article", "9")], "k string, n string")
    assert [r.n for r in s.orderBy(sibling_order(F.col("k"), F.col("n"))).collect()] == ["9", "10", "V", "IX", "b", "unico"]
    tree = {r.parent: r.children for r in children_in_order(law_provisions(blocks_of(spark, lines))).collect()}
    assert tree == {"art1": ["art1-incI", "art1-par1"], "art1-incI": ["art1-incI-ala"], "art1-par1": ["art1-par1-incII"], "art2-A": ["art2-A-parunico"]}


def test_summary_tree(spark):
    import json

    from vellum.operators.laws import classified, nested_children, subtree_counts
    from vellum.operators.parsing import provisions_of

    lines = ["Art. 1º Um.", "II - dois;", "I - um;", "a) letra;", "§ 1º Par.", "Art. 2º Dois."]
    rows = provisions_of(classified(blocks_of(spark, lines)))
    assert {r.path: r.n_nodes for r in subtree_counts(rows).collect()} == {"art1": 5, "art1-incII": 1, "art1-incI": 2, "art1-incI-ala": 1, "art1-par1": 1, "art2": 1}
    tree = {r.path: json.loads(r.tree) for r in nested_children(rows.unionByName(rows)).collect()}
    assert set(tree) == {"art1", "art2"} and list(tree["art1"]["children"]) == ["ite:I", "ite:II", "par:1"] and tree["art2"]["children"] == {}
    assert tree["art1"]["children"]["ite:I"]["children"]["let:a"] == {"kind": "letter", "number": "a", "children": {}}
    assert nested_children(rows.limit(0)).count() == 0 and subtree_counts(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("i - texto", "unclassified"), ("I -Texto", "item"), ("LXXXI - Texto longo", "heading"), ("Página 3 de 10", "metadata"), ("12", "metadata"), ("01/02/2024, 10:30", "metadata"), ("O MINISTRO DE ESTADO resolve:", "preamble"), ("Dispõe sobre o uso.", "preamble"),
    ("DIÁRIO OFICIAL DA UNIÃO", "metadata"), ("Órgão: Ministério", "metadata"), ("LEI Nº 14.133, DE 1º DE ABRIL DE 2021", "heading"), ("CAPÍTULO I", "heading"), ("Das Licitações", "heading"), ("a) letra", "letter"), ("§ 2º Par", "paragraph"), ("Art. 5º ..... 12", "metadata"),
    ("Art. 5º O", "article"), ("Artigo cinco", "heading"), ("", "metadata"), ("continuação do texto", "unclassified"), (None, "metadata"), ("1. Numerado", "unclassified"),
])
def test_block_class(spark, text, want):
    assert one(spark, block_class(F.lit(text).cast("string")).alias("k")).k == want


def test_bold_blocks_are_headings(spark):
    long = "Título em negrito, com muitas palavras, que não caberia como texto simples"
    r = one(spark, block_class(F.lit(long)).alias("a"), block_class(F.lit(long), F.lit(True)).alias("b"))
    assert (r.a, r.b) == ("unclassified", "heading")


def test_splits_of_blocks(spark):
    header = "01/02/2024, 10:30 Lei\nhttps://x.gov.br/lei.htm\n1/10\n"
    rest = "Art. 1º Este é o texto de um artigo."
    out = [(r.start, r.stop, r.text) for r in split_page_headers(blocks_of(spark, [header + rest, header + "curto"], 1000)).orderBy("start").collect()]
    assert out == [(0, len(header), header.strip()), (len(header), len(header + rest), rest), (1000, 1000 + len(header) + 5, header + "curto")]
    article = "Art. 35. O órgão adotará as medidas que forem necessárias ao caso."
    cases = ["Subseção I\nAdoção\n" + article, "considerando o disposto no\n" + article, "ADOÇÃO\nArt. 3. curto", "x\n" * 120 + "SEÇÃO I\n" + article, article]
    split = [(r.seq, r.text) for r in split_headed_articles(blocks_of(spark, cases, 5000)).orderBy("start").collect()]
    assert split == [(0, "Subseção I\nAdoção"), (0, article), *((i, t) for i, t in enumerate(cases) if i)]


def test_citations_and_diff(spark):
    found = citations_of("Nos termos do art. 124 da Lei nº 14.133/2021, da LC 214, de 2025, e da Constituição Federal.")
    assert [(c[0], c[3]) for c in found] == [("LEI-14.133-2021", 124), ("LC-214-2025", 124), ("CF-1988", None)]
    names = lambda t: [c[0] for c in citations_of(t)]
    assert names("Decreto-Lei 2.848/40") == ["DL-2.848"] and names("Decreto-Lei 5.452/1943") == ["DL-5.452-1943"] and names("LC 87") == ["LC-87-1996"] and names("Lei 8.666/93") == ["LEI-8.666-1993"]
    assert names("EC 5/1980") == ["EC-05"] and citations_of(None) == []
    own = own_references_of("Conforme o art. 5º, § 2º, inciso IV, alínea b, e o art. 9º desta lei, o art. 7º da Lei nº 8.666/1993 e o art. 8 da portaria do órgão.")
    assert [(r[2:]) for r in own] == [(5, "2", "IV", "b", 0.9), (9, None, None, None, 0.9), (8, None, None, None, 0.6)]
    assert diff_words("a b c", "a x c") == [("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c")]
    assert diff_words("same", "same") == [("same", "same")] and diff_words("", "new") == [("added", "new")]
    ids = spark.createDataFrame([("LEI 14133/2021",), ("IN-58-2022",), ("Decreto nº 10947 / 2022",), ("lc 214",)], "t string").select(normalised_id(F.col("t")).alias("i"))
    assert [r.i for r in ids.collect()] == ["LEI-14.133-2021", "IN-58-2022", "DECRETO-10.947-2022", "LC-214"]


def test_differences_of_long_texts():
    import random
    import time

    from vellum.operators import parsing

    r = random.Random(4)

    def by_table(old, new):
        """The way that a whole table of common lengths gives."""
        x, y = old.split(), new.split()
        longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                longest[i][j] = longest[i - 1][j - 1] + 1 if x[i - 1] == y[j - 1] else max(longest[i - 1][j], longest[i][j - 1])
        return longest[-1][-1]

    for kept in (1, 3, 256):
        parsing.FRONTIERS, before = kept, parsing.FRONTIERS
        for _ in range(60):
            a, b = (" ".join(r.choice("abc") for _ in range(r.randrange(0, 15))) for _ in range(2))
            d = diff_words(a, b)
            assert "".join(t for k, t in d if k != "added") == a and "".join(t for k, t in d if k != "removed") == b
            assert sum(len(t.split()) for k, t in d if k == "same") <= by_table(a, b)
        parsing.FRONTIERS = before
    words = [f"w{r.randrange(2000)}" for _ in range(20_000)]
    new = [f"w{r.randrange(2000)}" if r.random() < 0.02 else w for w in words]
    began = time.time()
    d = diff_words(" ".join(words), " ".join(new))
    assert time.time() - began < 60 and "".join(t for k, t in d if k != "added") == " ".join(words) and "".join(t for k, t in d if k != "removed") == " ".join(new)


def test_truncation_and_orphans(spark):
    text = "a" * 30 + ". " + "b" * 20
    at_budget = "a" * 40 + ". " + "b" * 20
    t = one(spark, truncate_at(F.lit(text), 0, 10).alias("t"), truncate_at(F.lit("short"), 0, 10).alias("s"), truncate_at(F.lit("short"), 9, 10).alias("e"), truncate_at(F.lit(at_budget), 0, 10).alias("b"))
    assert (t.t.text, t.t.next, t.s.text, t.s.next, t.e.text) == ("a" * 30 + ". ", 32, "short", None, "")
    assert (t.b.text, t.b.next) == ("a" * 40 + ". ", 42)  # a separator may begin at the budget
    rows = [(1, 0, "article", 0, 10, "Art. 1 begins"), (1, 1, "unclassified", 12, 20, "goes on com"), (1, 2, "metadata", 21, 30, "page 2"), (1, 3, "unclassified", 9000, 9010, " far but unfinished, "), (1, 4, "unclassified", 9100, 9110, "the end."), (1, 5, "unclassified", 9200, 9210, "left out")]
    rows += [(2, 0, "unclassified", 0, 5, "lost"), (2, 1, "item", 10, 20, "I - x"), (2, 2, "letter", 21, 30, "a) y"), (2, 3, "unclassified", 31, 40, "  z  ")]
    b = spark.createDataFrame(rows, "document int, seq int, kind string, start int, stop int, text string")
    assert sorted((r.document, r.seq, r.text, r.stop) for r in merge_orphans(b).collect()) == [(1, 0, "Art. 1 begins\ngoes on com\nfar but unfinished,\nthe end.", 10), (2, 1, "I - x", 20), (2, 2, "a) y\nz", 30)]


def test_child_offsets(spark):
    text = "Art. 1 the cat. The cat sat; concat cats  here."
    cases = [("the cat", 0, 47, None, 7, 14), ("", 0, 47, "EMPTY_TEXT", None, None), ("x", 9, 9, "INVALID_PARENT_RANGE", None, None), ("dog", 0, 47, "NOT_FOUND", None, None), ("cats here.", 0, 47, "NOT_FOUND_WHITESPACE_MISMATCH", None, None), ("cat", 0, 47, "AMBIGUOUS_MULTIPLE_MATCHES", None, None), (" sat; ", 15, 47, None, 24, 28), ("cat.", 0, 47, None, 11, 15)]
    df = spark.createDataFrame([(i, text, *c[:3]) for i, c in enumerate(cases)], "i int, text string, child string, a int, b int").orderBy("i")
    assert [(r.reason, r.child_start, r.child_stop) for r in child_offsets(df, "text", "a", "b", "child").orderBy("i").collect()] == [c[3:] for c in cases]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_percentiles_equal_the_sorted_ones(spark, seed):
    r = random.Random(seed)
    rows = [(g, r.choice([None, r.randrange(-50, 50), r.randrange(5)])) for g in (None, 1, 2) for _ in range(r.randrange(1, 60))] + [(3, 7)]
    out = {x.g: x.p for x in percentiles(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", [0.05, 0.25, 0.5, 1.0]).collect()}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        if own:
            want = [own[int(s * (len(own) - 1))] + (s * (len(own) - 1) % 1) * (own[min(len(own) - 1, int(s * (len(own) - 1)) + 1)] - own[int(s * (len(own) - 1))]) for s in (0.05, 0.25, 0.5, 1.0)]
            assert all(abs(a - b) < 1e-9 for a, b in zip(out[g], want, strict=True))


def test_nearest_with_missing_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0, 0.1, 9.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(2)
    out = [(r.query, r.vec_id) for r in nearest_to_each(df, df.where("vec_id in (1, 3, 4, 5)"), "vec_id", "embedding", 1).orderBy("query").collect()]
    assert out == [(1, 5), (5, 1)]


def test_references_against_an_empty_catalogue(spark):
    refs = spark.createDataFrame([("lei-1-2020",), (None,)], "slug string")
    assert sorted(str(r.norm) for r in resolve_references(refs, spark.createDataFrame([], "norm string"), "slug", "norm").collect()) == ["None", "lei-1-2020"]


def test_checks(spark):
    o = spark.createDataFrame([("r", "Official  text")], "ref string, official string")
    c = spark.createDataFrame([("r", "Official text\n"), ("r", "other"), ("x", "y"), (None, "z")], "ref string, quote string")
    assert sorted(str(r.reason) for r in audit_citations(c, o, "ref", "quote", "official").collect()) == ["None", "no reference", "reference not found", "text differs"]
    a = spark.createDataFrame([("Acórdão 1.234/2023 diz",), ("nada",)], "t string")
    got = spark.createDataFrame([("Acórdão 1234/2023-Plenário",), ("Acórdão 9/2020",)], "label string")
    assert [r.label for r in grounded(a, got, "t", "label").collect()] == ["Acórdão 1234/2023-Plenário"]
    calls = spark.createDataFrame([("m", 1_000_000, 0), ("q", 5, 5)], "model string, tokens_in long, tokens_out long")
    out = {r.model: r.cost_micro for r in cost_rollup(calls, spark.createDataFrame([("m", 0.075, 0.3)], "model string, price_in double, price_out double")).collect()}
    assert out == {"m": 75_000, "q": 0, None: 75_000}
    assert one(spark, missing_items(F.lit(0), F.lit("short")).alias("m")).m == ["contract value", "description of at least 50 characters"]
