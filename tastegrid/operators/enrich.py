"""Enrichment by lookup: exchange rates, price level, price per pound, countries of origin."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.numeric import round_half_even

CPI_BASELINE = "2024-06-01"

# Names left out of the list of countries, and the one put in.
NO_ORIGINS = (
    "american samoa", "united states minor outlying islands", "south sudan", "south georgia and the south sandwich islands",
    "british indian ocean territory", "congo, the democratic republic of the", "taiwan, province of china", "guinea",
)
MORE_ORIGINS = ("taiwan",)


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises when evaluated if a key repeats, since a lookup with such keys would multiply rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in keys])
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"the lookup repeats a key of {keys}"))).otherwise(F.lit(True))
    return counted.where(checked).select(*df.columns)


def rates_table(df: DataFrame, column: str = "rates") -> DataFrame:
    """review_date, price_currency, rate of a nested MAP<date, MAP<currency, rate>>; a date without rates keeps one null row."""
    days = df.select(F.explode(column).alias("review_date", "_by_currency"))
    return days.select(F.to_date("review_date").alias("review_date"), F.explode_outer("_by_currency").alias("price_currency", "rate"))


def in_dollars(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds price_usd by the rate of the month; null without one. The lookup is small and joins without a shuffle of ``df``."""
    known = unique_keys(rates.where("price_currency is not null").select("review_date", "price_currency", "rate"), "review_date", "price_currency")
    joined = df.join(known, ["review_date", "price_currency"], "left")
    return joined.withColumn("price_usd", round_half_even(F.try_divide(F.col("price_value"), F.col("rate")))).drop("rate")


def cpi_table(wide: DataFrame) -> DataFrame:
    """cpi, cpi_month of a wide table of years, months and half-years; blank months stay as nulls."""
    wide = wide.toDF(*[c.strip().lower().replace(" ", "_") for c in wide.columns]).drop("half1", "half2")
    months = [c for c in wide.columns if c != "year"]
    tall = wide.unpivot("year", months, "month", "cpi")
    day = F.to_date(F.concat_ws(" ", F.col("year").cast("string"), F.initcap("month"), F.lit("1")), "yyyy MMM d")
    return tall.select(F.col("cpi").cast("double").alias("cpi"), day.alias("cpi_month"))


def at_baseline_prices(df: DataFrame, cpi: DataFrame, baseline: str = CPI_BASELINE) -> DataFrame:
    """Adds price_usd_adj in dollars of the baseline month; the raw price where the month has no index."""
    base = cpi.where((F.col("cpi_month") == F.lit(baseline).cast("date")) & F.col("cpi").isNotNull()).select("cpi").limit(2).collect()
    if len(base) != 1:
        raise ValueError(f"{len(base)} index values for the baseline {baseline}")
    joined = df.join(unique_keys(cpi.select("cpi_month", "cpi"), "cpi_month"), df["review_date"] == F.col("cpi_month"), "left")
    adjusted = round_half_even(F.col("price_usd") * F.lit(base[0]["cpi"]) / F.col("cpi"))
    return joined.withColumn("price_usd_adj", F.when(F.col("cpi").isNull(), F.col("price_usd")).otherwise(adjusted)).drop("cpi", "cpi_month")


def per_pound(df: DataFrame) -> DataFrame:
    """Adds price_usd_adj_per_lb; null for a weight of zero."""
    return df.withColumn("price_usd_adj_per_lb", round_half_even(F.try_divide("price_usd_adj", "quantity_in_lbs")))


def iso_countries(spark: SparkSession) -> list[str]:
    """English names of the ISO countries, lower case, as the JVM's locale data has them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted({locale("", code).getDisplayCountry(locale.ENGLISH).lower() for code in locale.getISOCountries()})


def origin_names(countries: Iterable[str]) -> list[str]:
    """Countries as origins: some left out, text after a comma cut, longest first."""
    kept = {c.lower().split(",")[0] for c in countries if c.lower() not in NO_ORIGINS} | set(MORE_ORIGINS)
    return sorted(kept, key=lambda c: (-len(c), c))


def origin_country(df: DataFrame, countries: Iterable[str], column: str = "coffee_origin") -> DataFrame:
    """Adds origin_country: the countries that the lower-cased text names, sorted, joined by ``;``.

    The lower-cased text itself where it names none; empty for null and empty text.
    """
    pattern = r"\b(" + "|".join(map(re.escape, origin_names(countries))) + r")\b"
    df = df.withColumn(column, F.lower(column))
    found = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), 1))), ";")
    named = F.when(F.col(column).isNull() | (F.col(column) == ""), F.lit("")).when(found == "", F.col(column)).otherwise(found)
    return df.withColumn("origin_country", named)


def violations(df: DataFrame) -> DataFrame:
    """check, failed: how many rows break each invariant of enriched reviews; nulls break none."""
    checks = {
        "rating between 0 and 100": ~F.col("rating").between(0, 100),
        "quantity above 0": ~(F.col("quantity_in_lbs") > 0),
        "finite price per pound": F.isnan("price_usd_adj_per_lb") | F.abs("price_usd_adj_per_lb").isin(float("inf")),
    }
    counts = df.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in checks.items()])
    return counts.unpivot([], list(checks), "check", "failed")
