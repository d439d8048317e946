"""String primitives that Spark has not built in, or not with the semantics of scraped text."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions.blanks import utrim


def clean_names(names: list[str], drop: str = ".") -> list[str]:
    """Column names stripped, in lower case, with underscores for blanks and without the characters of ``drop``."""
    out = []
    for name in names:
        name = name.strip().lower().replace(" ", "_")
        out.append("".join(c for c in name if c not in drop))
    return out


def clean_columns(df: DataFrame, drop: str = ".") -> DataFrame:
    """``df`` under cleaned column names; two names that become one raise ValueError."""
    names = clean_names(df.columns, drop)
    if len(set(names)) < len(names):
        raise ValueError(f"cleaned column names clash: {names}")
    return df.toDF(*names)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def on_strings(df: DataFrame, change) -> DataFrame:
    """``df`` with ``change`` applied to each string column."""
    return df.withColumns({c: change(F.col(f"`{c}`")) for c in string_columns(df)})


def null_sentinels(df: DataFrame, sentinels: tuple[str, ...] = ("", "NR", "N/A", "na")) -> DataFrame:
    """Whole cells that equal a sentinel become null; padded ones don't."""
    return on_strings(df, lambda c: F.when(~c.isin(*sentinels), c))


def strip_strings(df: DataFrame) -> DataFrame:
    return on_strings(df, utrim)


def replace_values(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Whole cells replaced by a mapping; others stay."""
    mapping = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return on_strings(df, lambda c: F.coalesce(F.try_element_at(mapping, c), c))


def lookup(values: dict, column: Column, keep: bool = False) -> Column:
    """The value of a mapping; null, or with ``keep`` the key itself, where it has none."""
    mapping = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(mapping, column)
    return F.coalesce(found, column) if keep else found


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df.drop`` that raises on a column that is not there."""
    missing = set(names) - set(df.columns)
    if missing:
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


@F.pandas_udf(T.StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Letters without combining marks: compatibility decomposition, then marks dropped."""
    known: dict[str, str] = {}

    def one(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        if text not in known:
            known[text] = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return known[text]

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def url_join(bases: pd.Series, links: pd.Series) -> pd.Series:
    """Absolute form of a link on a page."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)
