import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastegrid.functions import blanks, numeric, strings
from tastegrid.functions.porter import stem


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "blank"), [(None, True), ("", True), ("  ", True), (" NR ", True), ("N/A", True), ("NA", True), ("na", True), ("nr", False), ("0", False)])
def test_blanks(spark, text, blank):
    assert one(spark, text, blanks.is_blank) is blank
    assert (one(spark, text, blanks.unblank) is None) is blank


def test_long_runs_of_spaces_are_read_once(spark):
    text = "\u00a0a" + " " * 300_000 + "b \u200b\n"
    assert one(spark, text, blanks.utrim) == text[1:-3] and one(spark, text, numeric.lenient_double) is None
    assert one(spark, " " * 300_000, blanks.is_blank) is True


@pytest.mark.parametrize(("text", "value"), [("9", 9.0), (" 9.5 ", 9.5), (".5", 0.5), ("1e2", 100.0), ("9d", None), ("9f", None), ("Very Low", None), ("", None), (None, None), ("1,5", None)])
def test_lenient_double(spark, text, value):
    assert one(spark, text, numeric.lenient_double) == value


@pytest.mark.parametrize(("value", "rounded"), [(0.575, 0.57), (0.125, 0.12), (0.375, 0.38), (-0.125, -0.12), (None, None)])
def test_rounding(spark, value, rounded):
    assert one(spark, value, numeric.round_half_even, "double") == rounded


def test_ranks_without_one_task(spark):
    df = spark.range(1000).withColumn("v", F.hash("id"))
    got = numeric.ranked(df, F.desc("v"), "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)
    assert numeric.ranked(df.limit(0), "id").count() == 0


def test_column_names(spark):
    assert strings.clean_names([" Est. Price ", "Review Date", "acidity/structure"]) == ["est_price", "review_date", "acidity/structure"]
    assert strings.clean_names(["half 1:"], drop=":") == ["half_1"]
    with pytest.raises(ValueError, match="clash"):
        strings.clean_columns(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_string_cells(spark):
    df = spark.createDataFrame([(" NR ", "NR", 1), ("x ", None, 2)], "a string, b string, n int")
    got = strings.strip_strings(strings.null_sentinels(df)).collect()
    assert [tuple(r) for r in got] == [("NR", None, 1), ("x", None, 2)]
    assert [r.a for r in strings.replace_values(df, {"x ": "y"}).collect()] == [" NR ", "y"]
    with pytest.raises(KeyError):
        strings.drop_columns(df, "c")
    assert one(spark, "Café Ｘ", strings.strip_accents) == "Cafe X"
    row = spark.createDataFrame([("https://a.b/c/", "../d", "k", "z")], "base string, href string, k string, z string").select(
        strings.url_join("base", "href"), strings.lookup({"k": 1}, F.col("k")), strings.lookup({"k": "v"}, F.col("z"), keep=True)
    )
    assert tuple(row.first()) == ("https://a.b/d", 1, "z")


# Pairs of the published vocabulary of the algorithm.
@pytest.mark.parametrize(("word", "expected"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("predication", "predic"),
    ("hopefulness", "hope"), ("sensitiviti", "sensit"), ("triplicate", "triplic"), ("formalize", "formal"), ("goodness", "good"), ("revival", "reviv"),
    ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"),
])
def test_stems(word, expected):
    assert stem(word) == expected


@settings(max_examples=200, deadline=None)
@given(st.text("aeioubcdstlyz", max_size=12))
def test_stems_never_grow_much(word):
    assert len(stem(word)) <= len(word) + 1


def test_months(spark):
    from tastegrid.operators.cleaning import month

    assert one(spark, "November 2016", month) == datetime.date(2016, 11, 1)
    with pytest.raises(Exception, match="(?i)parse|cannot"):
        one(spark, "2016-11", month)
