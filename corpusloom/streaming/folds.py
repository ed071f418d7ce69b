"""The folds of the crawl's logs as streams; over the same rows they give what the batch forms give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, kind, n): counts by tumbling window, final once the watermark has passed."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """(key, state, n_events): a running fold, for update or complete output."""
    return events.groupBy(key).agg(F.max_by(event, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Everything that has arrived, into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Each arriving batch as its own partition with the latest row of each key; readers take the
    greatest batch of a key. A batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
