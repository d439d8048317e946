"""Every query that SQL can express against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, tables, name):
    df = entry.queries()[name](spark, data)
    relation = tables.sql(SQL[name])
    columns = relation.columns
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(x) for x in r) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_lazy_explore(spark):
    from pyspark.sql import functions as F

    from tastegrid.operators import explore, textfeatures

    empty = spark.createDataFrame([], "k string, v double")
    assert explore.histogram(empty, "v").count() == explore.kernel_density(empty, "v").count() == explore.sample_per_group(empty, "k", 2, 1, "v").count() == 0
    same = spark.createDataFrame([("a", 1.0)] * 3, "k string, v double")
    assert explore.histogram(same, "v", 4).agg(F.sum("n")).first()[0] == 3 and explore.sample_per_group(same, "k", 2, 1, "v").count() == 2
    texts = spark.createDataFrame([(1, "Roasting roasts the roasted"), (2, None), (3, "")], "id int, t string")
    got = {r.term for r in textfeatures.tf_idf(texts, "id", "t", textfeatures.porter).collect()}
    assert got == {"roast"}
    vectors = spark.createDataFrame([([3.0, 0.0],), ([0.0, 4.0],), (None,)], "e array<double>")
    values = [r.singular_value for r in textfeatures.truncated_svd(vectors, "e", 2).orderBy("component").collect()]
    assert values == pytest.approx([4.0, 3.0])


def test_drawing_with_replacement(spark):
    from tastegrid.operators import explore

    df = spark.createDataFrame([("a", k) for k in range(3)] + [("b", 9), (None, 1)], "k string, v int")
    got = sorted(map(tuple, explore.sample_per_group(df, "k", 20, 7, "v", replace=True).collect()))
    assert got == sorted(map(tuple, explore.sample_per_group(df, "k", 20, 7, "v", replace=True).collect()))
    assert len(got) == 40 and got.count(("b", 9)) == 20 and {v for k, v in got if k == "a"} == {0, 1, 2}


@pytest.mark.parametrize("values", [[float(x * x % 97) for x in range(200)], [1.0] * 50 + [2.0], [3.0]])
def test_automatic_bins(spark, values):
    import numpy as np

    from tastegrid.operators import explore

    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert explore.automatic_bins(df, "v") == len(np.histogram_bin_edges(values, "auto")) - 1
    assert [r.n for r in explore.histogram(df, "v", None).orderBy("bin").collect()] == np.histogram(values, "auto")[0].tolist()


def test_analyzers(spark):
    from pyspark.sql import functions as F

    from tastegrid.operators import textfeatures as t

    lemmas = {("cups", "n"): "cup", ("was", "v"): "be"}
    tags = {"was": "VBD", "very": "RB"}
    df = spark.createDataFrame([("The cups, it was very",), (None,), ("",)], "x string").select(t.words(F.col("x")).alias("w"))
    out = lambda a: [r[0] for r in df.select(a(F.col("w"))).collect()]
    assert out(t.analyzer(lemmas)) == [["the", "cup", "it", "was", "very"], None, []]
    assert out(t.lexicon(lemmas, lambda ws: [tags.get(w, "NN") for w in ws], adverbs=False)) == [["the", "cup", "it", "be"], None, []]
    assert t.analyzer("porter") is t.porter and t.analyzer(t.identity) is t.identity and [t.word_class(x) for x in ("JJ", "VBZ", "NNS", "RBR", "DT", None)] == ["a", "v", "n", "r", "n", "n"]
    with pytest.raises(TypeError):
        t.analyzer("other")


def test_quantiles_of_many_values(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from tastegrid.operators import explore

    rows = [("ab"[k % 3 == 0], float(k * 37 % 101) if k % 7 else None) for k in range(500)] + [(None, 1.0), ("c", 4.0), ("d", None)]
    df, at = spark.createDataFrame(rows, "k string, v double"), (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    few, many = ({r.k: r.q for r in explore.quantiles(df, "v", at, "k", most).collect()} for most in (10**6, 0))
    for k in "abc":
        expected = np.quantile([v for key, v in rows if key == k and v is not None], at)
        assert few[k] == pytest.approx(expected) and many[k] == pytest.approx(expected)
    assert set(few) == set(many) == set("abc")
    whole = explore.quantiles(df, "v", at, None, 0).first().q
    assert whole == pytest.approx(explore.quantiles(df, "v", at).first().q) and whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], at))
    some = {r.stat: r.v for r in explore.describe(df, "v").collect()}
    monkeypatch.setattr(explore, "QUANTILE_VALUES", 0)
    assert {r.stat: r.v for r in explore.describe(df, "v").collect()} == pytest.approx(some)
    assert [r.v for r in explore.describe(df.where(F.col("v") < 0), "v").collect()] == [0.0] + [None] * 7
