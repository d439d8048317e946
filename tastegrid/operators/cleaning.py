"""Raw reviews to typed ones: sentinels, scores, agtron readings, and the split of written prices.

The split keeps the known quirks of the rules it reproduces (``250g`` loses its last digit, ``1 kg`` becomes grams),
because results must agree; :mod:`tastegrid.operators.units` reads the same texts without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.blanks import utrim
from tastegrid.functions.numeric import lenient_double, round_half_even
from tastegrid.functions.strings import drop_columns, lookup, null_sentinels, strip_strings

MAX_AGTRON = 100.0
SCORES = ("acidity", "rating", "aroma", "body", "flavor", "aftertaste")

# Offers in these forms are no bagged coffee. Each is searched as a pattern, also within words.
DROP_TERMS = (
    "can", "box", "capsules", "K-", "cups", "bags", "concentrate", "discs", "bottle", "pods", "ml", "pouch", "packet|tin",
    "instant", "sachet", "vue", "single-serve", "fluid", "capsultes",
)

# Rewrites of a quantity in this order, pattern and replacement.
QUANTITY_REWRITES = (
    (r"\(.*?\)", ""),
    (r";.*", ""),
    (r".g$", " grams"),
    (r"\sg$", "grams"),
    (r"\bgram$", "grams"),
    (r"pound$", "1 pounds"),
    (r"oz|onces|ouncues|ounce$|ounces\*", "ounces"),
    (r"kilogram", "kilograms"),
    (r"kg", "kilograms"),
    (r"online", ""),
)

# Pounds in one unit.
POUNDS = {"ounces": 1 / 16, "pounds": 1.0, "kilograms": 2.20462, "grams": 0.00220462}

# Currencies by what is left of a price without digits and dollar sign.
CURRENCIES = {
    "": "USD", "US": "USD", "PRICE:": "USD", "#": "GBP", "£": "GBP", "POUND": "GBP", "¥": "JPY", "€": "EUR", "E": "EUR",
    "EUROS": "EUR", "PESOS": "MXN", "RMB": "CNY", "RM": "MYR", "NT": "TWD", "NTD": "TWD", "HK": "HKD",
}


def month(text: Column) -> Column:
    """``November 2016`` as the first of that month; another form raises."""
    return F.to_date(text, "MMMM yyyy")


def split_agtron(df: DataFrame) -> DataFrame:
    """agtron_external and agtron_ground of ``58/77``; what is no number is null."""
    parts = F.split("agtron", "/")
    return df.withColumns({
        "agtron_external": lenient_double(F.get(parts, F.lit(0))),
        "agtron_ground": lenient_double(F.get(parts, F.lit(1))),
    })


def plausible_agtron(df: DataFrame) -> DataFrame:
    """Rows with a reading above 100 are typos and dropped; missing readings stay."""
    above = (F.col("agtron_external") > MAX_AGTRON) | (F.col("agtron_ground") > MAX_AGTRON)
    return df.where(~F.coalesce(above, F.lit(False)))


def typed_reviews(df: DataFrame) -> DataFrame:
    """Raw reviews (all text) with one acidity, two agtron readings, espresso flag, month and numeric scores.

    In this order: acidity is filled from acidity_structure and espresso is told by title or any with_milk value
    before sentinels become null; sentinels are compared before cells are stripped. Null and empty cells give null.
    One projection over the scan, no shuffle; further columns are kept, stripped.
    """
    espresso = F.coalesce(F.col("title").ilike("%espresso%"), F.lit(False)) | F.col("with_milk").isNotNull()
    df = df.withColumns({"acidity": F.coalesce("acidity", "acidity_structure"), "is_espresso": espresso, "review_date": month(F.col("review_date"))})
    df = plausible_agtron(split_agtron(df))
    df = drop_columns(strip_strings(null_sentinels(df)), "acidity_structure", "agtron")
    return df.withColumns({c: lenient_double(F.col(c)) for c in SCORES})


def split_price(df: DataFrame, column: str = "est_price") -> DataFrame:
    """Adds quantity_value, quantity_unit, price_value, price_currency; null where the price gives no usable pair.

    A projection: rows that the rules reject keep their other columns, and nothing is joined back.
    """
    halves = F.split(column, "/", 2)
    quantity = utrim(F.lower(F.replace(F.get(halves, F.lit(1)), F.lit(","), F.lit(""))))
    for pattern, replacement in QUANTITY_REWRITES:
        quantity = F.regexp_replace(quantity, pattern, replacement)
    df = df.withColumns({
        "_price": F.replace(F.replace(F.get(halves, F.lit(0)), F.lit(","), F.lit("")), F.lit(".."), F.lit(".")),
        "_quantity": utrim(quantity),
    })
    unit = utrim(F.regexp_replace(F.regexp_replace("_quantity", r"\d+", ""), r"\.", ""))
    unit = lookup({"g": "grams", "kilo": "kilograms"}, unit, keep=True)
    df = df.withColumn("_unit", unit)
    valid = (
        F.col("_price").isNotNull()
        & F.col("_quantity").isNotNull()
        & ~F.col("_quantity").rlike("(?i)" + "|".join(DROP_TERMS))
        & ~F.col("_unit").contains("(")
    )
    price = r"(\d+\.\d+|\d+)"
    return df.withColumns({
        "quantity_value": F.when(valid, F.regexp_substr("_quantity", F.lit(r"\d+(?:\.\d+)?")).cast("double")),
        "quantity_unit": F.when(valid, F.col("_unit")),
        "price_value": F.when(valid, F.regexp_substr("_price", F.lit(price)).cast("double")),
        "price_currency": F.when(valid, utrim(F.regexp_replace("_price", price, ""))),
    }).drop("_price", "_quantity", "_unit")


def to_pounds(df: DataFrame) -> DataFrame:
    """Adds quantity_in_lbs, two digits; null for unknown units."""
    return df.withColumn("quantity_in_lbs", round_half_even(F.col("quantity_value") * lookup(POUNDS, F.col("quantity_unit"))))


def currency_codes(df: DataFrame) -> DataFrame:
    """price_currency as ISO code; unknown spellings pass through."""
    code = utrim(F.replace(F.upper("price_currency"), F.lit("$"), F.lit("")))
    return df.withColumn("price_currency", lookup(CURRENCIES, code, keep=True))
