"""Per-variant sums kept up to date over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_sums(calls: DataFrame) -> DataFrame:
    """The sums behind variant statistics; the state is one row for each variant, whatever the stream's length."""
    d = F.col("dosage")
    return calls.groupBy("variant_id").agg(
        F.coalesce(F.sum(d), F.lit(0)).alias("dosage_sum"), F.coalesce(F.sum(d * d), F.lit(0)).alias("dosage_squares"),
        F.count_if(d > 0).alias("support"), F.count_if(d.isNull()).alias("n_missing"),
    )


def start(calls: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return running_sums(calls).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
