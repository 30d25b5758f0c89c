import random

import pytest

from vellum.llm.queries import piece_model
from vellum.llm.sentencepiece_codec import encode_decode

sentencepiece = pytest.importorskip("sentencepiece")


def cases():
    r = random.Random(1)
    fixed = [None, "", " ", "  a", "a ", "a  b\n c\t", "▁x", "é́ ﬁ①", "<s> </s> <unk>", "<0x0A>", "a\0b", "日本語 🎉🎉", "▁▁", " ▁ a", "a" + " " * 40 + "b", "x" * 20_000, "word " * 20_000]
    return fixed + ["".join(r.choice(" ▁ab\n\tthe éü🎉​<0x0A>") for _ in range(r.randrange(60))) for _ in range(2000)]


@pytest.mark.parametrize("limit", [500_000, 7])
def test_equals_the_library(spark, limit):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = cases()
    df = spark.createDataFrame([(i % 1900 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "doc_id as decoded", "1 as ids")
    out = encode_decode(df, piece_model(), limit=limit).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(r.text or "")
        assert r.piece_ids == ids and r.decoded == library.decode(ids), r.text


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), piece_model()).count() == 0
