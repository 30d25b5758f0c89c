"""Queries and operators on fixtures where a part of the job would go missing."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from vellum import registry
from vellum.operators.parsing import citations, citations_of, own_references_of
from vellum.operators.sequence import packed_chunks
from vellum.operators.vector import nearest_to_each


def stored(spark, path, **tables):
    """The folder of small tables, each given as (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_citations_are_found_in_the_whole_text(spark, tmp_path):
    texts = ["curto", "x" * 90 + " segundo a Lei 8.666/1993" + " y" * 900 + " e a LC 123/2006", "palavra " * 5000 + "art. 9 da MP 7/2001 fim", None]
    sf = stored(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = Counter((r.doc_id, r.document) for r in registry.QUERIES["extract_citations"](spark, sf).collect())
    added = lambda i: f". Conforme o art. {i % 30 + 1} da Lei nº 14.{i:03}/2021 e do Decreto 99.{i:03}, de 1990."
    assert got == Counter((i, c[0]) for i, t in enumerate(texts) if t is not None for c in citations_of(t + added(i)))
    assert {(1, "LEI-8.666-1993"), (1, "LC-123-2006"), (2, "MP-07-2001")} <= set(got) and len(got) == 9


def test_parts_are_read_before_and_behind_a_citation(spark):
    parts = lambda text: [(c[0], c[3], *c[5:]) for c in citations_of(text)]
    assert parts("Lei 14.133/2021, art. 5, par. 2, inciso I") == [("LEI-14.133-2021", 5, "2", "I", None)]
    assert parts("Lei 14.133/2021, artigo 5º, § 2º, inciso iv, alínea 'b'.") == [("LEI-14.133-2021", 5, "2", "IV", "b")]
    assert parts("nos termos do art. 6º, parágrafo único, inciso II, alínea c, da Lei 14.133/2021") == [("LEI-14.133-2021", 6, "unico", "II", "c")]
    assert parts("arts. 3 e 4 da Lei 8.666/1993") == [("LEI-8.666-1993", 3, None, None, None)]
    assert parts("art. 37, inciso XXI, da Constituição Federal") == [("CF-1988", 37, None, "XXI", None)]
    assert parts("Lei 14.133/2021, art. 5, inciso I, e Decreto 99.000/1990") == [("LEI-14.133-2021", 5, None, "I", None), ("DECRETO-99.000-1990", None, None, None, None)]
    assert parts("art. 1 da Lei 1/2020" + " x" * 60 + " Lei 2/2020" + " y" * 50 + " art. 2")[1] == ("LEI-02-2020", None, None, None, None)
    docs = spark.createDataFrame([(1, "Lei 14.133/2021, art. 5, § 2, inciso I, alínea a")], "d long, t string")
    r = citations(docs, "d", "t").first()
    assert (r.article, r.paragraph, r.item, r.letter) == (5, "2", "I", "a")


def test_norms_by_name_and_confidence():
    sure = lambda text: [(c[0], c[3], c[4]) for c in citations_of(text)]
    assert sure("art. 3 do Código Tributário Nacional, a Lei Kandir e a carta magna") == [("LEI-5.172-1966", 3, 0.3), ("LC-87-1996", 3, 0.3), ("CF-1988", None, 0.3)]
    assert sure("CTN") == [("LEI-5.172-1966", None, 0.3)] and sure("Lei 5") == [("LEI-05", None, 0.6)] and sure("Lei 5/2001") == [("LEI-05-2001", None, 0.95)]
    own = [r[6] for r in own_references_of("o art. 1º " + "y " * 30 + "e o art. 2º da portaria x", known=False)]
    assert own == [0.5, 0.6] and [r[6] for r in own_references_of("o art. 1º")] == [0.9]


def test_passages_against_brute_force(spark, tmp_path):
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("ab bcd efg hij kl mnop q".split()) + str(r.randrange(3)) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 4, 12, 40]))) for i in range(90)] + [(90, ""), (91, None), (None, "ab0"), (92, "x " * 60)]
    docs = [(i, f"{say(5)}{r.choice([' ', ''])}{items[r.randrange(90)][1]}{r.choice([' ', 's'])}{say(9)}") for i in range(60)]
    docs += [(60, "  " + items[70][1].replace(" ", "\n ")), (61, items[89][1]), (61, say(30)), (62, None), (None, "-" + items[70][1]), (63, "x " * 60), (63, "x " * 60)]
    sf = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    form = lambda t: " ".join(t.split())
    want = Counter((d, i, "equal" if form(t) == form(o) else "contained") for d, t in docs for i, o in items if t and i is not None and o and form(o) in form(t))
    got = Counter((x.doc_id, x.item_id, x.relation) for x in registry.QUERIES["audit_passages"](spark, sf).collect())
    assert got == want and {k[2] for k in got} == {"equal", "contained"} and any(k[1] >= 50 for k in got) and got[63, 92, "equal"] == 2


def test_a_whole_text_can_be_the_literal_quote(spark, tmp_path):
    item = "word " * 30 + "end"
    sf = stored(spark, tmp_path, documents=([(1, item), (2, item + " more")], "doc_id long, text string"), benchmark=([(1, item), (2, item)], "item_id long, text string"))
    assert {(r.doc_id, r.status) for r in registry.QUERIES["audit_literal_match"](spark, sf).collect()} == {(1, "APROVADA"), (2, "REJEITADA")}


def test_nearest_to_any_number_of_queries(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(12_000, 2))
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(12_000), "v": v.tolist()}))
    few = rows.where("id < 40")
    got = {(x.query, x.id): (x.score, x["rank"]) for x in nearest_to_each(few, rows, "id", "v", 3).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit @ unit[:40].T, 6)
    score[np.arange(40), np.arange(40)] = -2
    order = np.lexsort((np.broadcast_to(np.arange(40), score.shape), -score), axis=1)[:, :3]
    assert got == {(q, int(i)): (score[q, i], n + 1) for q in range(12_000) for n, i in enumerate(order[q])}
    all_at_once = sorted(map(tuple, nearest_to_each(rows, few, "id", "v", 3).collect()))
    assert sorted(map(tuple, nearest_to_each(rows, few, "id", "v", 3, 7, 50).collect())) == all_at_once and len(all_at_once) == 120
    assert nearest_to_each(rows, rows.limit(0), "id", "v", 3).count() == 0


def test_chunks_of_a_long_document_pass_as_a_stream(spark):
    pages = spark.range(30_000).selectExpr("if(id % 3 = 0, 1L, id % 7) d", "id p", "concat('a', id, '\n\n', repeat('b', int(id % 50)))  t")
    chunks = packed_chunks(pages, "d", "p", "t", 200)
    want = {}
    for d, p, t in sorted(map(tuple, pages.collect())):
        for b in filter(None, t.split("\n\n")):
            own = want.setdefault(d, [])
            if not own or sum(len(x) + 2 for _, x in own[-1]) + len(b) + 2 > 200:
                own.append([])
            own[-1].append((p, b))
    got = sorted(map(tuple, chunks.collect()))
    assert got == [(d, i, "\n\n".join(b for _, b in c), c[0][0], c[-1][0]) for d in sorted(want) for i, c in enumerate(want[d])]
    assert "collect_list" not in chunks._jdf.queryExecution().toString()
