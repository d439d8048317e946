"""Files of scraped reviews: CSV with missing markers, JSON, nested rates, price index; dispatch by suffix; sinks."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.strings import on_strings
from tastegrid.operators.enrich import cpi_table, rates_table

# Cells that a CSV scan takes for missing before anything else sees them.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted line breaks and doubled quotes; without a schema all columns are text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    return on_strings((reader.schema(schema) if schema else reader).csv(path), lambda c: F.when(~c.isin(*MISSING), c))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file: an array of records, or one record."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


READERS = {".csv": read_csv, ".json": read_json}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; ValueError for an unknown one, FileNotFoundError for a local path that is not there."""
    suffix = Path(path).suffix
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path!r}; known are {', '.join(READERS)}")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return READERS[suffix](spark, path)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """review_date, price_currency, rate of a JSON file of days with rates by currency."""
    text = spark.read.text(path, wholetext=True)
    return rates_table(text.select(F.from_json("value", "map<string,map<string,double>>").alias("rates")))


def read_cpi(spark: SparkSession, path: str) -> DataFrame:
    """cpi, cpi_month of a CSV file of years and months."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"the file of the price index is not there: {path}")
    return cpi_table(read_csv(spark, path)).withColumn("cpi", F.col("cpi").cast("double"))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files with headers; ``one_file`` brings all rows to one task and is for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    df.write.mode("overwrite").json(path)


def write_rates(rates: DataFrame, path: str) -> None:
    """Nested JSON of a table of rates, one object for each day and line: ``{"2024-01-01": {"EUR": 0.9}}``."""
    days = rates.groupBy("review_date").agg(F.map_from_entries(F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("price_currency", "rate")))).alias("m"))
    line = F.to_json(F.create_map(F.date_format("review_date", "yyyy-MM-dd"), F.col("m")))
    days.select(line.alias("value")).write.mode("overwrite").text(path)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Write CSV only if there are rows; whether it was written."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def dated_name(name: str, suffix: str, day: datetime.date | None = None) -> str:
    return f"{day or datetime.date.today():%Y-%m-%d}_{name}.{suffix.lstrip('.')}"


def csv_path_for(json_path: str, folder: str) -> str:
    """Where the CSV form of a JSON file goes."""
    return str(Path(folder) / (Path(json_path).stem + ".csv"))
