"""Numbers as scraped data and its float arithmetic need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastegrid.functions.runtime import checkpointed

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def lenient_double(text: Column) -> Column:
    """A number written in a text as DOUBLE, null for everything else (also for suffixes such as ``9d``)."""
    trimmed = F.regexp_replace(text, r"(?U)^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$", "")
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Rounded as ``rint(x * 10^d) / 10^d``: ties of the scaled double go to the even neighbour."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in a total order, without one task seeing all rows.

    The rows are range-partitioned and numbered within their partitions; each partition is shifted by the sizes of
    those before it. ``order`` should have no ties, or places among them are arbitrary.
    """
    local = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    numbered = checkpointed(local.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    joined = numbered.join(F.broadcast(shifts), "_part")
    return joined.withColumn(name, F.col("_shift") + F.col("_local")).drop("_part", "_local", "_shift")
