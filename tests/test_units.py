import datetime

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import units
from tastegrid.operators.units import Conversion, UnitGraph
from tastegrid.plans import core

DAY = datetime.date(2020, 3, 1)
QUOTES = "quote_id bigint, review_date date, est_price string, quantity_value double, quantity_unit string, price_value double, price_currency string"
RATES = "review_date date, price_currency string, rate double"


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(DAY, "USD", 1.0), (DAY, "EUR", 0.8), (DAY, "IDR", 15000.0), (DAY, "JPY", 100.0), (DAY, "CAD", None)]
    return spark.createDataFrame(rows, RATES)


def found(spark, rates, rows):
    return {r.quote_id: (r.grams, r.usd_cents) for r in units.common_quantities(spark.createDataFrame(rows, QUOTES), rates).collect()}


WRITTEN = [
    ("$15.00/12 ounces", 340, 1500), ("PRICE: US $15/12 oz.", 340, 1500), ("$20/pound", 454, 2000), ("$20/1 ½ lb", 680, 2000),
    ("$20/1/2 pound", 227, 2000), ("$20/half a lb", 227, 2000), ("$20/two 8oz", None, None), ("$20/2 x 8 oz", 454, 2000),
    ("$20/1 lb 4 oz", 567, 2000), ("8,00 euros/0,25 kg", 250, 1000), ("1,250.00 yen/250g", 250, 1250), ("1500 cents/250-g bag", 250, 1500),
    ("Rp 150,000/1 kilo", 1000, 1000), ("$18/12 ounces; $30/2 lb", 340, 1800), ("£8/12 oz", None, None), ("CAD $8/12 oz", None, None),
    ("$10/10 K-cups", None, None), ("$10/12 fl oz", None, None), ("$10/200 ml", None, None), ("$10", None, None), ("NR", None, None),
    ("", None, None), ("$0/12 oz", None, None), ("$5/8 oz (227 g)", 227, 500), ("$5/twelve oz", 340, 500), ("E4/100 g", 100, 500),
]


def test_written_prices(spark, rates):
    got = found(spark, rates, [(i, DAY, text, None, None, None, None) for i, (text, _, _) in enumerate(WRITTEN)])
    assert got == {i: (g, c) for i, (_, g, c) in enumerate(WRITTEN) if g is not None}


def test_split_fields_and_nulls(spark, rates):
    rows = [
        (1, DAY, None, 12.0, "OZ", 15.0, "$"), (2, DAY, "NR", 2.27, "hundred grams", 8.0, "€"), (3, DAY, None, 3.0, "x 100 g", 150.0, "thousand IDR"),
        (4, DAY, None, None, "8-ounce tin", 1036.0, "¢"), (5, DAY, None, 6.0, "K-cups", 5.0, "USD"), (6, DAY, None, 12.0, None, 5.0, "USD"),
        (7, DAY, None, 12.0, "oz", None, "USD"), (8, DAY, None, 12.0, "oz", 5.0, None), (9, None, "$5/8 oz", None, None, None, None),
        (None, DAY, "$5/8 oz", None, None, None, None), (10, datetime.date(2020, 4, 1), "$5/8 oz", None, None, None, None),
    ]
    assert found(spark, rates, rows) == {1: (340, 1500), 2: (227, 1000), 3: (300, 1000), 4: (227, 1036)}


def test_repeated_rows_empty_tables_and_extra_columns(spark, rates):
    row = (1, DAY, "$15/12 oz", 12.0, "oz", 15.0, "USD")
    twice = spark.createDataFrame([row, row], QUOTES).withColumns({"month": F.lit(1), "rate": F.lit(2.0), "grams": F.lit("x"), "spelling": F.lit("oz")})
    assert [tuple(r) for r in units.common_quantities(twice, rates.withColumn("quote_id", F.lit(5))).collect()] == [(1, 340, 1500)]
    assert units.common_quantities(spark.createDataFrame([], QUOTES), rates).count() == 0
    assert units.common_quantities(spark.createDataFrame([row], QUOTES), spark.createDataFrame([], RATES)).count() == 0
    long = spark.createDataFrame([(1, DAY, "$15/12 oz" + " very" * 20_000, None, None, None, None)], QUOTES)
    assert units.common_quantities(long, rates).first().grams == 340


def test_compositions_and_cycles():
    graph = UnitGraph([Conversion("C", "K", 1.0, 273.15), Conversion("F", "C", 5 / 9, -160 / 9)])
    path = graph.to_canonical(["K"])["F"]
    assert path.scale * 212 + path.offset == pytest.approx(373.15)
    with pytest.raises(ValueError, match="contradict"):
        UnitGraph([Conversion("a", "b", 2.0), Conversion("b", "c", 2.0), Conversion("a", "c", 5.0)])
    with pytest.raises(ValueError, match="two canonical"):
        graph.to_canonical(["K", "F"])


def test_both_readings_agree(spark, data):
    from tastegrid.sources.tables import table

    both = table(spark, data, "price_quotes").where("est_price is not null and quantity_unit is not null")
    rates = table(spark, data, "exchange_rates")
    written = units.common_quantities(both.withColumn("quantity_unit", F.lit(None).cast("string")), rates)
    split = units.common_quantities(both.withColumn("est_price", F.lit(None).cast("string")), rates)
    assert {tuple(r) for r in written.collect()} == {tuple(r) for r in split.collect()}
    assert core.p4_found(spark, data).count() > 0
