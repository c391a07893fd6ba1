"""Document intake as a stream: new files are parsed once, the same content counts once, failures go to their own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fresh(stream: DataFrame, content: str, event_time: str | None = None, within: str = "30 days") -> DataFrame:
    """Rows whose content wasn't there before; with an event time, within a bounded past, else in all of it (the state then grows with distinct contents)."""
    keyed = stream.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    if event_time:
        return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["digest"])
    return keyed.dropDuplicates(["digest"])


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt: 1, 2, 4 ... and 60 at most."""
    return F.least(F.lit(60), F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("int")


def route(batch: DataFrame, most_attempts: int = 3) -> DataFrame:
    """What becomes of parsed rows(status, failure, attempts): needs_review, retry with a delay, or failed."""
    permanent = F.col("failure").isin("ExtractionLimitError", "UnsupportedDocumentError") | (F.col("attempts") >= most_attempts)
    outcome = F.when(F.col("status") != "failed", "needs_review").when(permanent, "failed").otherwise("retry")
    return batch.withColumn("outcome", outcome).withColumn("delay", F.when(F.col("outcome") == "retry", retry_delay(F.col("attempts"))))


def run(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write what there is and end; the checkpoint is the claim on input, so a run after a crash goes on where it was."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def queue_depth(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each state and window, late ones held off after the watermark (an extension: counts of a live feed)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
