"""Quantities recorded in different units, brought to common ones.

Conversions are edges of a graph: ``target = scale * source + offset``. The shortest composition from every
unit to the canonical unit of its dimension is computed once on the driver (the graph is a parameter, so its
size is known), every cycle is checked for consistency, and the data meets the result in an equi-join on the
source unit. Rates that change with time are edges too: they are joined on month and currency.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions.blanks import is_blank


@dataclass(frozen=True)
class Conversion:
    """``target = scale * source + offset``"""

    source: str
    target: str
    scale: float
    offset: float = 0.0

    def inverse(self) -> Conversion:
        return Conversion(self.target, self.source, 1.0 / self.scale, -self.offset / self.scale)

    def then(self, other: Conversion) -> Conversion:
        return Conversion(
            self.source, other.target, self.scale * other.scale, other.scale * self.offset + other.offset
        )


class UnitGraph:
    """Units as nodes, conversions as edges in both directions."""

    def __init__(self, conversions: Iterable[Conversion], tolerance: float = 1e-9) -> None:
        self.edges: dict[str, list[Conversion]] = {}
        self._all = list(conversions)
        for c in self._all:
            if c.scale == 0:
                raise ValueError(f"the conversion {c.source} to {c.target} cannot be inverted")
            self.edges.setdefault(c.source, []).append(c)
            self.edges.setdefault(c.target, []).append(c.inverse())
        self._check_cycles(tolerance)

    def compositions_from(self, start: str) -> dict[str, Conversion]:
        """The shortest composition from ``start`` to each unit that can be reached."""
        found = {start: Conversion(start, start, 1.0)}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            for edge in self.edges.get(at, []):
                if edge.target not in found:
                    found[edge.target] = found[at].then(edge)
                    queue.append(edge.target)
        return found

    def to_canonical(self, canonical: Iterable[str]) -> dict[str, Conversion]:
        """Each unit's composition to the one canonical unit of its dimension."""
        result: dict[str, Conversion] = {}
        for target in canonical:
            for unit, conversion in self.compositions_from(target).items():
                if unit in result:
                    raise ValueError(f"{unit} reaches two canonical units: {result[unit].target} and {target}")
                result[unit] = conversion.inverse()
        return result

    def _check_cycles(self, tolerance: float) -> None:
        """Every edge must agree with the compositions along a spanning tree; then all cycles do."""
        seen: set[str] = set()
        for start in self.edges:
            if start in seen:
                continue
            tree = self.compositions_from(start)
            seen |= set(tree)
            for c in self._all:
                if c.source in tree:
                    there, direct = tree[c.target], tree[c.source].then(c)
                    gap = abs(there.scale - direct.scale) / max(abs(there.scale), abs(direct.scale))
                    shift = abs(there.offset - direct.offset) / max(1.0, abs(there.offset))
                    if gap > tolerance or shift > tolerance:
                        raise ValueError(f"the conversions of {c.source} and {c.target} contradict each other")


# Avoirdupois weights in grams, and money within one currency.
CONVERSIONS = (
    Conversion("lb", "oz", 16.0),
    Conversion("oz", "g", 28.349523125),
    Conversion("lb", "g", 453.59237),
    Conversion("kg", "g", 1000.0),
    Conversion("mg", "g", 0.001),
    Conversion("USD_CENT", "USD", 0.01),
    Conversion("IDR_THOUSAND", "IDR", 1000.0),
)

# How the units of weight are written, without final dots and asterisks, lower case.
WEIGHT_SPELLINGS = {
    "mg": ("mg", "milligram", "milligrams"),
    "g": ("g", "gr", "grs", "gram", "grams", "gramm", "gramms", "gms"),
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramm"),
    "oz": ("oz", "ozs", "ounce", "ounces", "once", "onces", "ouncues"),
    "lb": ("lb", "lbs", "pound", "pounds"),
}

# How currencies are written, upper case, without blanks, final dots and the dollar sign.
CURRENCY_SPELLINGS = {
    "USD": ("", "US", "USD", "PRICE:", "DOLLAR", "DOLLARS"),
    "USD_CENT": ("¢", "CENT", "CENTS", "USCENTS", "USCENT", "US¢"),
    "GBP": ("#", "£", "POUND", "GBP"),
    "JPY": ("¥", "JPY", "YEN"),
    "EUR": ("€", "E", "EUR", "EURO", "EUROS"),
    "MXN": ("PESO", "PESOS", "MXN"),
    "CNY": ("RMB", "CNY", "YUAN"),
    "MYR": ("RM", "MYR"),
    "TWD": ("NT", "NTD", "TWD"),
    "HKD": ("HK", "HKD"),
    "KRW": ("₩", "KRW", "WON"),
    "IDR": ("RP", "IDR"),
    "IDR_THOUSAND": ("THOUSANDIDR", "IDR(THOUSANDS)", "IDRTHOUSANDS", "IDRTHOUSAND"),
    "CAD": ("CAD", "CA", "C"),
    "AUD": ("AUD", "AU", "A"),
    "CHF": ("CHF",),
    "SEK": ("SEK",),
    "THB": ("THB", "฿"),
}

# Numbers written as words or as vulgar fractions.
NUMBER_WORDS = {
    "a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0,
    "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0, "sixteen": 16.0,
    "twenty": 20.0, "hundred": 100.0, "half": 0.5, "half a": 0.5, "half an": 0.5, "quarter": 0.25,
    "a quarter": 0.25, "quarter of a": 0.25, "three quarters of a": 0.75, "½": 0.5, "¼": 0.25, "¾": 0.75,
    "⅓": 1 / 3, "⅔": 2 / 3,
}

_DIGITS = r"\d+(?:[.,]\d+)*"
_WORDS = "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
_NUMBER = rf"(?:{_DIGITS}\s*/\s*{_DIGITS}|{_DIGITS}\s*[½¼¾⅓⅔]|{_DIGITS}|(?:{_WORDS})(?![a-z]))"
_UNITS = "|".join(sorted((s for words in WEIGHT_SPELLINGS.values() for s in words), key=lambda w: (-len(w), w)))
_UNIT = rf"(?:{_UNITS})(?![a-z])"
_WEIGHT = rf"^(?:({_NUMBER})?\s*[x×]\s*)?({_NUMBER})?[\s-]*({_UNIT})[.*]*(?:\s*(?:and\s+)?({_NUMBER})\s*({_UNIT})[.*]*)?(?:[\s-].*)?$"
#: Stands between the groups of a pattern; in a text it counts as a blank.
_MARK = "\x01"
_PRICE = rf"^([^0-9]*?)\s*({_DIGITS})\s*([^0-9]*)$"


def number(text: Column) -> Column:
    """A written number as DOUBLE: thousands in groups of three after commas, else a comma is the decimal mark;
    words, fractions and ``1 ½`` are read too; null where it is none."""
    plain = (
        F.when(text.rlike(r"^[1-9]\d{0,2}(,\d{3})+(\.\d+)?$"), F.replace(text, F.lit(","), F.lit("")))
        .when(text.rlike(r"^[1-9]\d{0,2}(\.\d{3})+,\d+$"), F.translate(text, ",.", "."))
        .otherwise(F.replace(text, F.lit(","), F.lit(".")))
    )
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    top = F.regexp_extract(text, r"^([\d.]+)\s*/", 1).try_cast("double")
    low = F.regexp_extract(text, r"/\s*([\d.]+)$", 1).try_cast("double")
    whole = F.regexp_extract(text, r"^(\d+)", 1).try_cast("double")
    part = F.try_element_at(words, F.regexp_extract(text, r"([½¼¾⅓⅔])$", 1))
    return (
        F.when(text.rlike(r"^[\d.]+\s*/\s*[\d.]+$"), F.try_divide(top, low))
        .when(text.rlike(r"^\d+\s*[½¼¾⅓⅔]$"), whole + part)
        .when(text.rlike(r"^\d"), plain.try_cast("double"))
        .otherwise(F.try_element_at(words, text))
    )


def numbers(*texts: Column) -> Column:
    """ARRAY<DOUBLE> of written numbers: one lambda for all, so that generated code stays small."""
    return F.transform(F.array(*texts), number)


def tidy(text: Column) -> Column:
    """Lower case, single plain blanks, no parenthesised remarks."""
    text = F.regexp_replace(F.lower(text), r"\([^)]*\)?", " ")
    return F.trim(F.regexp_replace(text, r"(?U)[\s\p{Z}]+", " "))


def currency_key(text: Column) -> Column:
    """The spelling of a currency as the table of spellings has it."""
    return F.regexp_replace(F.upper(F.replace(text, F.lit("$"), F.lit(""))), r"(?U)[\s\p{Z}]+|(?<!\.)\.++$", "")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that matches the whole text, as an array, '' for groups that took no part; an
    empty array where it doesn't match. The pattern is run once for all groups."""
    plain = F.translate(text, _MARK, " ")
    marked = F.regexp_replace(plain, pattern, _MARK + _MARK.join(f"${g}" for g in range(1, n + 1)))
    return F.when(F.startswith(marked, F.lit(_MARK)), F.split(F.substr(marked, F.lit(2)), _MARK)).otherwise(F.array().cast("array<string>"))


def _group(groups: str, g: int) -> Column:
    return F.nullif(F.get(groups, F.lit(g - 1)), F.lit(""))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are worked out once: filters on them are not pushed below them with a copy of
    the expression, as they are below a projection."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_weight(df: DataFrame, text: str) -> DataFrame:
    """Adds amount, spelt_unit, more, spelt_more: what the written weight in the column ``text`` says.

    ``2 x 12 oz`` gives 24 oz, ``1 lb 4 oz`` has 4 oz more. A text that is no weight (pieces, volumes, nothing)
    gives null units.
    """
    volume = F.col(text).rlike(r"\bfl(uid|\.)?\b|\bmls?\b|\bliters?\b|\blitres?\b")
    df = _settled(df, **{text: tidy(F.col(text))})
    df = _settled(df, w_groups=_groups(F.col(text), _WEIGHT, 5), w_volume=volume)
    df = _settled(
        df, w_numbers=numbers(*[_group("w_groups", g) for g in (1, 2, 4)]), spelt_unit=F.when(~F.col("w_volume"), _group("w_groups", 3)),
        spelt_more=_group("w_groups", 5), w_bare=_group("w_groups", 2).isNull(),
    )
    times = F.coalesce(F.get("w_numbers", F.lit(0)), F.lit(1.0))
    return df.withColumns({
        "amount": times * F.when(F.col("w_bare"), F.lit(1.0)).otherwise(F.get("w_numbers", F.lit(1))),
        "more": times * F.get("w_numbers", F.lit(2)),
    }).drop("w_groups", "w_volume", "w_numbers", "w_bare")


def readings(quotes: DataFrame) -> DataFrame:
    """quote_id, month, reading, price, spelt_currency, amount, spelt_unit, more, spelt_more.

    Reading 0 is the first offer of the written price, reading 1 the split fields.
    """
    first = F.get(F.split(F.regexp_replace(F.lower("est_price"), r"(?U)[\s\p{Z}]+", " "), ";", 2), F.lit(0))
    both = quotes.where("quote_id is not null and review_date is not null").select(
        "quote_id",
        F.trunc("review_date", "month").alias("month"),
        F.when(~is_blank(F.col("est_price")), F.split(F.regexp_replace(F.trim(first), r"^price\s*:\s*", ""), "/", 2)).alias("halves"),
        "quantity_value", "quantity_unit", "price_value", "price_currency",
    )
    written = F.struct(
        F.lit(0).alias("reading"), F.trim(F.get("halves", F.lit(0))).alias("price_text"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("currency_text"), F.lit(1.0).alias("times"), F.get("halves", F.lit(1)).alias("weight_text"),
    )
    split = F.struct(
        F.lit(1).alias("reading"), F.lit(None).cast("string").alias("price_text"), F.col("price_value").cast("double").alias("value"),
        F.when(~is_blank(F.col("price_currency")), F.col("price_currency")).alias("currency_text"),
        F.coalesce(F.col("quantity_value").cast("double"), F.lit(1.0)).alias("times"), F.col("quantity_unit").alias("weight_text"),
    )
    rows = both.select("quote_id", "month", F.inline(F.array(written, split))).where("weight_text is not null")
    rows = _settled(rows, p_groups=F.when(F.col("reading") == 0, _groups(F.col("price_text"), _PRICE, 3)))
    written_money = F.when(_group("p_groups", 2).isNotNull(), F.concat_ws(" ", F.get("p_groups", F.lit(0)), F.get("p_groups", F.lit(2))))
    rows = _settled(
        rows, price=F.when(F.col("reading") == 0, F.get(numbers(_group("p_groups", 2)), F.lit(0))).otherwise(F.col("value")),
        spelt_currency=currency_key(F.when(F.col("reading") == 1, F.col("currency_text")).otherwise(written_money)),
    )
    rows = with_weight(rows.where("price > 0 and spelt_currency is not null"), "weight_text")
    return rows.select(
        "quote_id", "month", "reading", "price", "spelt_currency", (F.col("times") * F.col("amount")).alias("amount"),
        "spelt_unit", (F.col("times") * F.col("more")).alias("more"), "spelt_more",
    ).where("amount > 0 and spelt_unit is not null")


def conversion_table(
    spark: SparkSession, spellings: dict[str, tuple[str, ...]], canonical: Iterable[str], conversions=CONVERSIONS
) -> DataFrame:
    """spelling, source, canonical, scale, offset: one row per known spelling, so its size is that of the parameter."""
    wanted = list(canonical)
    graph = UnitGraph(c for c in conversions if c.source in spellings)
    paths = graph.to_canonical(w for w in wanted if w in graph.edges)
    rows = []
    for unit, written in spellings.items():
        path = paths.get(unit, Conversion(unit, unit, 1.0) if unit in wanted else None)
        if path is None:
            raise ValueError(f"no conversion of {unit} to a canonical unit")
        rows += [(w, unit, path.target, path.scale, path.offset) for w in written]
    schema = "spelling string, source string, canonical string, scale double, offset double"
    return spark.createDataFrame(rows, schema)


def _converted(df: DataFrame, key: str, table: DataFrame, prefix: str) -> DataFrame:
    """``df`` with the columns <prefix>_scale, <prefix>_offset, <prefix>_canonical of the spelling in ``key``."""
    right = table.select(
        F.col("spelling").alias(key),
        F.col("scale").alias(f"{prefix}_scale"),
        F.col("offset").alias(f"{prefix}_offset"),
        F.col("canonical").alias(f"{prefix}_canonical"),
    )
    return df.join(F.broadcast(right), key, "left")


def common_quantities(quotes: DataFrame, rates: DataFrame) -> DataFrame:
    """quote_id, grams BIGINT, usd_cents BIGINT: each quote that states price, currency and weight in common units.

    ``quotes``: quote_id, review_date, est_price and the split fields quantity_value, quantity_unit, price_value,
    price_currency. ``rates``: review_date, price_currency, rate (units per US dollar). The written price goes
    first; where it gives no price, currency and weight, the split fields are read. Rows without a quote_id, a
    month, a rate, or with a weight or price that is not above zero give no row; whole-row duplicates give one;
    further columns are ignored. Both results are rounded half up.
    """
    spark = quotes.sparkSession
    money = [u for u in CURRENCY_SPELLINGS if u not in ("USD_CENT", "IDR_THOUSAND")]
    weights = conversion_table(spark, WEIGHT_SPELLINGS, ["g"])
    currencies = conversion_table(spark, CURRENCY_SPELLINGS, money)
    common = _converted(readings(quotes), "spelt_unit", weights, "unit")
    common = _converted(common, "spelt_more", weights, "more")
    common = _converted(common, "spelt_currency", currencies, "money")
    grams = F.col("amount") * F.col("unit_scale") + F.col("unit_offset")
    added = F.coalesce(F.col("more") * F.col("more_scale") + F.col("more_offset"), F.lit(0.0))
    dollars = (F.col("price") * F.col("money_scale") + F.col("money_offset")) / F.col("rate")
    known = (
        rates.where("rate > 0")
        .groupBy(F.trunc("review_date", "month").alias("month"), F.col("price_currency").alias("money_canonical"))
        .agg(F.max("rate").alias("rate"))
    )
    cases = common.join(known, ["month", "money_canonical"]).select(
        "quote_id", "reading", half_up(grams + added).alias("grams"), half_up(dollars * 100).alias("usd_cents")
    )
    best = cases.groupBy("quote_id").agg(F.min(F.struct("reading", "grams", "usd_cents")).alias("best"))
    return best.select("quote_id", "best.grams", "best.usd_cents")


def half_up(value: Column) -> Column:
    """Rounded half up to BIGINT; noise of the last bits of a double does not decide a tie."""
    return F.floor(F.round(value, 7) + F.lit(0.5)).cast(T.LongType())
