"""Streams of results: windows of metrics, and the latest delivery of each reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a path (a file, or a folder of them), at most so many a batch, with the schema of a batch read; ``ts`` becomes an event time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, sum of hundredths and maximum of ``value`` in windows of ``ts`` and by ``event_type``. In ``append`` and ``update`` mode windows older than the watermark leave the state, and rows later than it are left out."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("hundredths"), F.max("value").alias("most"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "hundredths", "most")
    )


def run_once(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its table; state and result are in the shared folder.

    In ``update`` mode each batch gives the rows that it changed, so of each key the row of the latest batch counts; in
    ``append`` mode a window comes once, when the watermark has passed it. Each batch writes a folder of its own, so a
    batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession
    root = shared_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/result/{number:09d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{root}/result/*")
    latest = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_at", F.row_number().over(latest)).filter("_at = 1").drop("_at", "_batch")
