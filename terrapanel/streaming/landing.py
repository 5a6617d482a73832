"""Incremental landing of series payload files with Structured Streaming.

The original fetches payloads and lands them as raw tables in a batch
run. Here new payload files dropped into a folder are picked up by a
file-source stream and flattened with the same operator as the batch reader.
Every micro-batch is settled within itself, compared with the landed rows of
the years that it touches (an anti join against those year partitions only)
and what is new is appended to a Parquet table partitioned by year. So a
re-delivered file, or a micro-batch that is run again after a failure, adds
nothing, and the stream keeps no state that grows. Its checkpoint lives in the
shared checkpoint folder, so a restarted job resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.feeds import dedupe_series, flatten_payload_text

KEY = ["localidade_id", "ano", "variavel_id"]


def payload_stream(spark: SparkSession, folder: str, level: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming tidy rows from payload files (one JSON document per file)."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(folder).select(F.col("value").alias("payload"))
    return flatten_payload_text(raw, "payload", level)


def append_new(batch: DataFrame, target: str) -> None:
    """Append the observations of ``batch`` that ``target`` doesn't have.
    Only the partitions of the batch's years are read (a year or two of a
    series per file; their list is what comes to the driver)."""
    spark = batch.sparkSession
    new = dedupe_series(batch).persist()
    try:
        years = [r.ano for r in new.select("ano").distinct().collect()]
        if not years:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            there = spark.read.schema(new.schema).parquet(target).where(F.col("ano").isin([y for y in years if y is not None]) | F.col("ano").isNull())
            known = there.select(*(F.col(c).alias(f"_{c}") for c in KEY))
            rows = new.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_anti")
        else:
            rows = new
        rows.write.mode("append").partitionBy("ano").parquet(target)
    finally:
        new.unpersist()


def land(spark: SparkSession, folder: str, target: str, *, level: str | None = None, name: str = "landing",
         checkpoint: str | None = None, available_now: bool = True):
    """Start (and, with ``available_now``, drain) the landing stream.

    Returns the ``StreamingQuery``; with ``available_now`` it has already
    processed every file present when it started.
    """
    base = ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{base}/terrapanel/streams/{name}"
    q = (
        payload_stream(spark, folder, level)
        .writeStream.foreachBatch(lambda batch, _: append_new(batch, target))
        .option("checkpointLocation", ckpt)
    )
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle
