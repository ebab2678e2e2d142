"""Structured Streaming jobs: decimation of arriving samples and the alert feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoflux.operators.serve import valid_forecasts
from chronoflux.operators.skill import alert_level


def sample_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decimated(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling means; rows later than the watermark are dropped and closed windows leave the state."""
    sums = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.sum(value).alias("__sum"), F.count(value).alias("n"))
    return sums.select(*keys, F.unix_seconds("window.start").alias("bin_t"), F.try_divide("__sum", "n").alias(value), "n")


def run_decimation(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet and stop when the input is used up."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def open_windows(spark: SparkSession, checkpoint: str, keys: list[str], value: str) -> DataFrame:
    """The windows that a stopped decimation still holds, as its output would show them."""
    state = spark.read.format("statestore").load(checkpoint)
    start, total, n = F.unix_seconds("key.window.start"), F.col("value.sum"), F.col("value.count")
    return state.select(*[F.col(f"key.{k}").alias(k) for k in keys], start.alias("bin_t"), F.try_divide(total, n).alias(value), n.alias("n"))


def decimate_all(stream: DataFrame, keys: list[str], value: str, out: str, tail: str, checkpoint: str) -> DataFrame:
    """Run a decimation to the end of its input: all windows, each once.

    Closed windows are appended to ``out``. Those still open are read from the state and
    replace ``tail``; the state keeps them, so a later run with more input goes on with
    them, appends them when they close, and replaces ``tail`` again.
    """
    run_decimation(stream, out, checkpoint).awaitTermination()
    spark = stream.sparkSession
    open_windows(spark, checkpoint, keys, value).write.mode("overwrite").parquet(tail)
    return spark.read.schema(stream.schema).parquet(out).unionByName(spark.read.schema(stream.schema).parquet(tail))


def run_alert_feed(stream: DataFrame, accepted: str, rejected: str, checkpoint: str, watch: float, warning: float) -> StreamingQuery:
    """Validate forecast records, map them to an alert level, append; rejects go to a side table.

    Each batch writes under its own batch number, so a replayed batch replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        good, bad = valid_forecasts(batch)
        good = good.withColumn("alert_level", alert_level("probability_15m", watch, warning))
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
