"""Streaming form of the daily roll-up, and the audit of whole micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barweave.functions.calendar import utc_day
from barweave.operators.quality import block_aggregates, block_failures
from barweave.operators.sentiment import daily_aggregates
from barweave.session import scratch_path


def daily_sentiment_stream(scored: DataFrame, watermark: str = "1 day", entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Daily roll-up of a scored stream; state for a day is released once the watermark passes it."""
    timed = scored.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    daily = timed.groupBy(F.window(ts, "1 day").alias("_w"), entity).agg(*daily_aggregates())
    return daily.select(
        entity, F.to_date("_w.start").alias("date"), "avg_composite", "avg_positive", "avg_negative", "avg_neutral",
        "article_count", ((F.col("avg_composite") + 1.0) / 2.0).alias("scaled_sentiment"))


def audit_batch(batch: DataFrame, batch_id: int) -> DataFrame:
    return block_failures(batch.agg(*block_aggregates())).withColumn("batch_id", F.lit(batch_id))


def audit_micro_batches(scored: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Audit every micro-batch as one block and write its findings; replays overwrite their own folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        audit_batch(batch, batch_id).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return scored.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming result over everything available and return the written table.

    ``append`` goes to a file sink and keeps state only for days the watermark has not passed; ``complete`` rewrites the whole
    result per micro-batch and keeps all of it as state, so it is for bounded histories. Data and
    progress live in the shared folder, so a lost executor or driver restart resumes from there.
    """
    spark = stream.sparkSession
    sink, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink))
    else:
        writer = writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
