from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import queries, tokenization
from tastegrid.sources.tables import table

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not Path(tokenization.DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(tokenization.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokenization.BytePairEncoder(Path(tokenization.DEFAULT_VOCABULARY).read_text(encoding="utf-8"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinorst  .'\n0123", max_size=80), st.text("abAB", max_size=40)))
def test_exact(encoder, other, text):
    assert encoder.encode(text) == other(text)


def test_long_and_special(encoder, other):
    for text in ("a" * 20_000, " " * 5_000, "<|endoftext|> x", "ab" * 9_000, "é☕‍中\r\n" * 500, "it's we'LL don't"):
        assert encoder.encode(text) == other(text)


def test_corpus(spark, data, other):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {r.doc_id: list(r.ids) for r in queries.p7_ids(spark, data).collect()}
    assert got == {i: other(t) if t else [] for i, t in texts.items()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (4, "y" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(9), "ids": F.lit("clash")})
    got = sorted(((r.doc_id or 0), len(r.ids)) for r in tokenization.encode_corpus(df).collect())
    assert [g for g in got if g[0] != 4] == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)] and got[-1][1] > 1000
    assert tokenization.encode_corpus(df.limit(0)).count() == 0
    assert dict(tokenization.encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
