"""Missing markers of scraped reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole-cell markers of a missing value, compared after trimming.
BLANK_MARKERS = ("", "NR", "N/A", "NA", "na")

_SPACE = r"[\s\p{Z}\x{200B}\x{FEFF}]"
#: What ends a text begins after something else, so that a long run of spaces within it is read once.
_EDGES = rf"(?U)^{_SPACE}++|(?<!{_SPACE}){_SPACE}++$"


def utrim(text: Column) -> Column:
    """Trim every kind of Unicode white space, as scraped HTML needs it."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    """True for null, empty or all-space text and for padded or bare missing markers; never null."""
    return F.coalesce(utrim(text).isin(*BLANK_MARKERS), F.lit(True))


def unblank(text: Column) -> Column:
    """Null instead of a blank, else the trimmed text."""
    trimmed = utrim(text)
    return F.when(trimmed.isin(*BLANK_MARKERS), F.lit(None)).otherwise(trimmed)
