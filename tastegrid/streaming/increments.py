"""New spellings as they arrive: a stream of names against a stored crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegrid.operators.matching import new_names


def watch_new_names(spark: SparkSession, incoming: str, schema: str, column: str, crosswalk: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each new file's names that neither the crosswalk nor earlier files have to the Parquet folder ``out``.

    A batch that is run again after a failure writes to its own subfolder again, so nothing is appended twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = new_names(batch, column, spark.read.parquet(crosswalk))
        earlier = spark.read.schema("raw_name string, batch bigint").parquet(out) if number else None
        if earlier is not None:
            fresh = fresh.join(earlier.where(F.col("batch") < number).select("raw_name"), "raw_name", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts(stream: DataFrame, time_column: str, lateness: str = "30 days") -> DataFrame:
    """window, n: rows of each window of 30 days of a stream; rows later than ``lateness`` are no longer counted."""
    return stream.withWatermark(time_column, lateness).groupBy(F.window(time_column, "30 days")).agg(F.count("*").alias("n"))
