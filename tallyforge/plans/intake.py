"""Queries of streams and their state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tallyforge.operators import relations as R
from tallyforge.plans.registry import query
from tallyforge.streaming import intake as I


def _shared(spark) -> str:
    """A folder of its own below spark.checkpoint.dir; a local master may do without that setting, others must have it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/intake-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    """A table as a stream of its files, whether it is one file or a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = R.read(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{d}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_content_dedupe", "SELECT sha256(text) AS digest, 1 AS seen FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stream_content_dedupe(spark, d):
    at = _shared(spark)
    fresh = I.fresh(_stream(spark, d, "documents").where("text is not null").select("text"), "text").select("digest", F.lit(1).alias("seen"))
    I.run(fresh, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("digest string, seen int").parquet(f"{at}/out")


@query("retry_routing", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'needs_review' WHEN event_id % 3 = 0 OR event_id % 9 >= 3 THEN 'failed' ELSE 'retry' END AS outcome, CASE WHEN event_type = 'error' AND NOT (event_id % 3 = 0 OR event_id % 9 >= 3) THEN CAST(least(60, pow(2, greatest(event_id % 9 - 1, 0))) AS INTEGER) END AS delay FROM events")
def retry_routing(spark, d):
    e = F.col("event_id")
    rows = R.read(spark, d, "events").select(e, F.when(F.col("event_type") == "error", "failed").otherwise("parsed").alias("status"), F.when(e % 3 == 0, "ExtractionLimitError").otherwise("DocumentExtractionError").alias("failure"), (e % 9).alias("attempts"))
    return I.route(rows).select("event_id", "outcome", "delay")


@query("hourly_event_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_event_counts(spark, d):
    return R.read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
