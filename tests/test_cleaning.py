import datetime

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import cleaning, enrich

# The cases of the fixtures: text, value, unit, pounds.
CASES = [
    ("$15.00/12 ounces", 12, "ounces", 0.75), ("$15.00/12 oz.", 12, "ounces", 0.75), ("$15.00/12.5 oz", 12.5, "ounces", 0.78), ("NT $500/250 g", 250, "grams", 0.55),
    ("NT $500/250g", 25, "grams", 0.06), ("$20/1 kg", 1, "grams", 0.0), ("$20/1 kilogram", 1, "kilograms", 2.2), ("$20/1 kilograms", 1, "kilogramss", None),
    ("$20/pound", 1, "pounds", 1.0), ("$20/1 pound", 1, "pounds", 1.0), ("£8.00/16 oz (454g)", 16, "ounces", 1.0), ("$18/12 ounces; $30/2", 12, "ounces", 0.75),
    ("$18/8 oz (online)", 8, "ounces", 0.5), ("$10/12 oz bag", 12, "ounces b grams", None), ("$1,250.00/8 ounces", 8, "ounces", 0.5),
    ("$10/10 K-cups", None, None, None), ("$5/can", None, None, None), ("$9/6 pods", None, None, None), ("$10", None, None, None), (None, None, None, None), ("", None, None, None),
]


def test_price_split_keeps_its_quirks(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, est_price string")
    got = {r.i: r for r in cleaning.to_pounds(cleaning.split_price(df)).collect()}
    for i, (text, value, unit, pounds) in enumerate(CASES):
        if text == "$15.00/12 oz.":
            unit = "ounces"
        assert (got[i].quantity_value, got[i].quantity_unit, got[i].quantity_in_lbs) == (value, unit, pounds), text
    assert got[14].price_value == 1250.0 and got[10].price_currency == "£"


@pytest.mark.parametrize(("mark", "code"), [("$", "USD"), ("US $", "USD"), ("NT $", "TWD"), ("HK $", "HKD"), ("RMB ", "CNY"), ("RM ", "MYR"), ("£", "GBP"), ("#", "GBP"), ("¥", "JPY"), ("€", "EUR"), ("E", "EUR"), ("PESOS", "MXN"), ("CAD", "CAD"), (None, None)])
def test_currencies(spark, mark, code):
    assert cleaning.currency_codes(spark.createDataFrame([(mark,)], "price_currency string")).first().price_currency == code


RAW = "review_date string, title string, with_milk string, acidity string, acidity_structure string, agtron string, rating string, aroma string, body string, flavor string, aftertaste string"


def test_typed_reviews(spark):
    rows = [
        ("May 2020", "Espresso Blend", None, None, "9", "58/77", "94", "8", "8", "8", "8"), ("May 2020", None, "NR", "NR", "9", "0/60", " 90 ", "NR", "Low", None, ""),
        ("May 2020", "Kenya", None, "Very Low", "7", "105/80", "1", "1", "1", "1", "1"), ("May 2020", "Kenya", "", "8", None, "58", "1", "1", "1", "1", "1"), ("May 2020", "Kenya", None, None, None, None, None, None, None, None, None),
    ]
    got = cleaning.typed_reviews(spark.createDataFrame(rows, RAW)).collect()
    assert [(r.acidity, r.agtron_external, r.agtron_ground, r.is_espresso, r.rating) for r in got] == [
        (9.0, 58.0, 77.0, True, 94.0), (None, 0.0, 60.0, True, 90.0), (8.0, 58.0, None, True, 1.0), (None, None, None, False, None),
    ]
    assert got[0].review_date == datetime.date(2020, 5, 1) and cleaning.typed_reviews(spark.createDataFrame([], RAW)).count() == 0


def test_lookups(spark):
    day = datetime.date(2020, 5, 1)
    rates = spark.createDataFrame([("2020-05-01", "EUR", 0.8)], "d string, c string, r double")
    nested = rates.select(F.create_map("d", F.create_map("c", "r")).alias("rates")).union(spark.createDataFrame([({"2020-06-01": {}},)], "rates map<string,map<string,double>>"))
    long = enrich.rates_table(nested)
    assert {tuple(r) for r in long.collect()} == {(day, "EUR", 0.8), (datetime.date(2020, 6, 1), None, None)}
    prices = spark.createDataFrame([(day, "EUR", 10.0, 0.5), (day, "XXX", 1.0, 0.0), (None, None, None, None)], "review_date date, price_currency string, price_value double, quantity_in_lbs double")
    usd = enrich.in_dollars(prices, long)
    assert sorted((r.price_usd or 0) for r in usd.collect()) == [0, 0, 12.5]
    with pytest.raises(Exception, match="repeats a key"):
        enrich.in_dollars(prices, long.union(long)).collect()
    cpi = enrich.cpi_table(spark.createDataFrame([(2020, 100.0, None, None, None)], "Year int, May double, Jun double, HALF1 double, HALF2 double"))
    assert {tuple(r) for r in cpi.collect()} == {(100.0, day), (None, datetime.date(2020, 6, 1))}
    adjusted = enrich.per_pound(enrich.at_baseline_prices(usd, cpi, "2020-05-01"))
    assert sorted((r.price_usd_adj_per_lb or 0) for r in adjusted.collect()) == [0, 0, 25.0]
    with pytest.raises(ValueError, match="baseline"):
        enrich.at_baseline_prices(usd, cpi, "2020-06-01")
    failed = {r.check: r.failed for r in enrich.violations(adjusted.withColumn("rating", F.lit(101))).collect()}
    assert failed == {"rating between 0 and 100": 3, "quantity above 0": 1, "finite price per pound": 0}


def test_origins(spark):
    names = enrich.iso_countries(spark)
    assert len(names) > 200 and "kenya" in enrich.origin_names(names) and "guinea" not in enrich.origin_names(names)
    texts = [("Yirgacheffe, Ethiopia; Kenya",), ("Guatemala, Kenya and Kenya",), ("Somewhere",), (None,), ("",)]
    got = enrich.origin_country(spark.createDataFrame(texts, "coffee_origin string"), names).collect()
    assert [r.origin_country for r in got] == ["ethiopia;kenya", "guatemala;kenya", "somewhere", "", ""]
