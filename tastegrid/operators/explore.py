"""Exploratory aggregates: the frames behind tables and plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tastegrid.functions.runtime import checkpointed

# Roast levels from light to dark.
ROAST_LEVELS = ("Light", "Medium-Light", "Medium", "Medium-Dark", "Dark", "Very Dark")

#: Quantiles of more different values are not counted in one task.
QUANTILE_VALUES = 1_000_000
QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type; no booleans, no dates."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """column, n: how often each value occurs, most frequent first, ties by value; nulls are not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), column)
    return counts.limit(top) if top else counts


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the number of distinct values of each column; nulls are not counted."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def null_counts(df: DataFrame) -> DataFrame:
    """column_name, nulls: most nulls first, ties by name; one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls").orderBy(F.desc("nulls"), "column_name")


def group_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mean: rows with a null key are left out, null values don't count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"))


def group_mean_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, stat, value: mean and max of each group in long form."""
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return stats.unpivot(key, ["mean", "max"], "stat", value)


def sample_per_group(df: DataFrame, key: str, n: int, seed: int, *identity: str, replace: bool = False) -> DataFrame:
    """Up to ``n`` rows of each group, the same ones for the same seed; rows with a null key are left out.

    Each task keeps the n least of a hash of ``identity`` in each of its groups before anything is shuffled, so that a
    hot group is no single task. Rows with equal identities are ordered by the whole row. With ``replace``, n rows are
    drawn from each group, each from all of it: the least of a hash of its own.
    """
    if replace:
        draws = df.where(F.col(key).isNotNull()).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_draw"))
        row = F.struct(F.xxhash64(*identity, F.lit(seed), "_draw").alias("_h"), *[F.col(f"`{c}`") for c in df.columns])
        return draws.groupBy(F.col(key).alias("_key"), "_draw").agg(F.min(row).alias("_row")).select("_row.*").drop("_h")
    rows = F.struct(F.xxhash64(*identity, F.lit(seed)).alias("_h"), *[F.col(f"`{c}`") for c in df.columns])
    salted = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.spark_partition_id().alias("_part"), rows.alias("_row"))
    least = lambda d, *by: d.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("_row")), 1, n).alias("_rows"))
    partial = least(salted, "_key", "_part", F.pmod("_row._h", F.lit(64))).select("_key", F.explode("_rows").alias("_row"))
    return least(partial, "_key").select(F.inline("_rows")).drop("_h")


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], key: str | None = None, most_values: int = QUANTILE_VALUES) -> DataFrame:
    """One row (for each ``key`` that is not null) with q ARRAY<DOUBLE>: exact quantiles with linear interpolation.

    Up to ``most_values`` different values are counted in the buffer of one aggregate. Beyond that, the counts of the
    values are range-partitioned, summed up where they lie and shifted by what earlier partitions hold, and those at the
    places looked for are taken. Both ways give the same. Nulls don't count; without values q is null, with a key there is no row.
    """
    by = [key] if key else []
    x = F.col(value).cast("double")
    known = df.where(F.col(value).isNotNull() & (F.col(key).isNotNull() if key else F.lit(True))).select(*by, x.alias("v"))
    if known.agg(F.approx_count_distinct(F.struct(*by, "v")).alias("n")).first()["n"] <= most_values:
        return known.groupBy(*by).agg(F.percentile("v", list(at)).alias("q"))
    counts = known.groupBy(*by, "v").agg(F.count("*").alias("n")).repartitionByRange(*by, "v").withColumn("_part", F.spark_partition_id())
    counts = checkpointed(counts)
    sizes = counts.groupBy(*by, "_part").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy(*by).orderBy("_part")  # one row a partition
    sizes = sizes.select(*by, "_part", (F.sum("size").over(earlier) - F.col("size")).alias("shift"), F.sum("size").over(Window.partitionBy(*by)).alias("all"))
    upto = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy("v")) + F.col("shift")
    placed = counts.join(sizes, [*by, "_part"]).withColumn("upto", upto)
    holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
    found = []
    for q in at:
        place = F.lit(q) * (F.col("all") - 1)
        low, high = F.max(F.when(holds(F.floor(place)), F.col("v"))), F.max(F.when(holds(F.ceil(place)), F.col("v")))
        found.append((low + (high - low) * F.max(place - F.floor(place))))
    return placed.groupBy(*by).agg(F.when(F.count("*") > 0, F.array(*found)).alias("q"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """stat and one column each: count, mean, std (n - 1), min, exact quartiles with linear interpolation, max."""
    different = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    many = {c: quantiles(df, c, QUARTILES).first()["q"] for c in columns if different[c] > QUANTILE_VALUES}
    quartile = lambda c, k: F.lit(many[c][k]) if c in many else F.percentile(c, QUARTILES[k])
    stats: dict[str, object] = {
        "count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
        "25%": lambda c: quartile(c, 0), "50%": lambda c: quartile(c, 1), "75%": lambda c: quartile(c, 2), "max": lambda c: F.max(c).cast("double"),
    }
    row = df.agg(*[f(c).alias(f"{s}|{c}") for s, f in stats.items() for c in columns])
    cells = [F.struct(F.lit(s).alias("stat"), *[F.col(f"`{s}|{c}`").alias(c) for c in columns]) for s in stats]
    return row.select(F.inline(F.array(*cells)))


def automatic_bins(df: DataFrame, value: str) -> int:
    """Number of equal bins from the narrower of the widths by Freedman and Diaconis, but no narrower than half that by
    the square root, and by Sturges; whole numbers get none narrower than 1. One bin for no values or one value."""
    x = F.col(value).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not s["n"] or s["lo"] == s["hi"]:
        return 1
    span = s["hi"] - s["lo"]
    low, high = quantiles(df, value, (0.25, 0.75)).first()["q"]
    width = min(span / (math.log2(s["n"]) + 1), max(2 * (high - low) / s["n"] ** (1 / 3), span / math.sqrt(s["n"]) / 2))
    if isinstance(df.schema[value].dataType, T.IntegralType):
        width = max(width, 1.0)
    return max(1, math.ceil(span / width))


def histogram(df: DataFrame, value: str, bins: int | None = 100, density: bool = False) -> DataFrame:
    """bin, low, high and n (or density): equal bins from min to max, the max in the last one; empty bins too.

    Two passes: the bounds are one row, the counts as many rows as there are bins. None: ``automatic_bins``.
    """
    bins = automatic_bins(df, value) if bins is None else bins
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    bounds = known.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("all")).first()
    if not bounds["all"]:
        return df.sparkSession.createDataFrame([], f"bin int, low double, high double, {'density double' if density else 'n bigint'}")
    lo, hi = bounds["lo"], bounds["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = known.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.lit(0))
    shown = (n / F.lit(bounds["all"] * width)).alias("density") if density else n.alias("n")
    edge = lambda k: F.lit(lo) + k * F.lit(width)
    return grid.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), shown)


def kernel_density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """x, density: Gaussian kernels with Scott's bandwidth on a grid from min to max.

    Equal values are counted first; then each task sums the kernels of its values at every point of the grid.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    s = known.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = s["sd"] * s["n"] ** -0.2
    step = (s["hi"] - s["lo"]) / (points - 1)
    counted = known.groupBy("v").agg(F.count("*").alias("c"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(s["lo"]) + k * F.lit(step))
    kernels = counted.select("c", "v", F.posexplode(grid).alias("k", "x"))
    each = F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.lit(width), F.lit(2.0)))
    scale = s["n"] * width * math.sqrt(2 * math.pi)
    return kernels.groupBy("k").agg(F.first("x").alias("x"), (F.sum(each) / F.lit(scale)).alias("density")).select("x", "density")


def pairwise_regression(df: DataFrame, *columns: str) -> DataFrame:
    """x, y, slope, intercept, r2, n of every ordered pair of columns, over rows that have both; one pass."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    stats = lambda y, x: F.struct(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(*[stats(y, x).alias(f"p{k}") for k, (x, y) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[f"p{k}" for k in range(len(pairs))])))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, q1, median, q3, low, high, outliers: quartiles, whiskers at the last values within 1.5 quartile ranges."""
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    quarters = quantiles(known, "v", QUARTILES, key).select(key, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return known.join(quarters, key).groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("outliers")
    )


def category_place(column: str, order: tuple[str, ...] = ROAST_LEVELS) -> Column:
    """1-based place of a category in a fixed order, 0 for others."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))


def matching(column: str, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a text contains a pattern; false for null."""
    return F.coalesce(F.col(column).rlike(f"(?i){pattern}" if ignore_case else pattern), F.lit(False))
