"""Log operators on Structured Streaming.

Log lines arrive over time, so the stateless operators (render E1, style
E2, parse E4) and the status tally (E5, a streaming aggregate in update
mode) run on ``readStream`` DataFrames unchanged. Each run writes through
a checkpoint in the shared checkpoint folder, so a lost executor or a
restarted driver resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LOG_STATUSES
from ..operators import logs as E
from ..session import scratch_path
from ..sources.fixtures import log_records_from_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table of a folder as a stream (only ``events.parquet``)."""
    reader = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(sf_dir)


def log_record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records_from_events(events_stream(spark, sf_dir))


def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, output_mode: str = "append") -> str:
    """Run a streaming DataFrame over everything available now into a
    parquet folder under the checkpoint folder; returns the folder."""
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_updates_to_parquet(stream: DataFrame, spark: SparkSession, name: str) -> str:
    """Run a streaming aggregate in update mode: a micro-batch writes only
    the rows it changed, to a folder of its own number, which a retried
    batch overwrites. Returns the folder; :func:`latest_counts` reads it."""
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each deployment in the batches of a folder."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("deployment_id", "batch")]
    newest = rows.groupBy("deployment_id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return newest.select("deployment_id", "r.*")


def formatted_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on a stream of log records."""
    return E.format_log(log_record_stream(spark, sf_dir))


def parsed_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 then E4 on a stream: the round trip of every record."""
    return E.parse_log(E.format_log(log_record_stream(spark, sf_dir)))


def styled_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 on a stream of log records."""
    return E.style_log(log_record_stream(spark, sf_dir))


def status_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 on a stream: a stateful aggregate, emitted in update mode."""
    return E.status_counts(log_record_stream(spark, sf_dir))


# -- E5 by time window -------------------------------------------------------------------

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def window_counts(records: DataFrame, width: str, delay: str) -> DataFrame:
    """E5 per deployment and time window ``(deployment_id, window_start,
    <counts>)`` on a stream, for append mode: a window is given once, when the
    watermark (the greatest ``ts`` of earlier batches less ``delay``) has
    reached its end. Its state goes then, so the state holds open windows
    only, not every deployment for ever. A record is late, and not counted,
    if its window's end is not after the watermark; :func:`late_window_counts`
    counts those."""
    # Watermarks are on instants: times without a zone are read as UTC, whatever the session's zone.
    at = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, ts))")
    counted = (records.withColumn("at", at).withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "deployment_id")
               .agg(*[F.count_if(F.col("status") == s).alias(s) for s in LOG_STATUSES]))
    start = F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {EPOCH})")
    return counted.select("deployment_id", start.alias("window_start"), *LOG_STATUSES)


def start_window_counts(records: DataFrame, path: str, checkpoint: str, width: str, delay: str):
    """Start (or restart) :func:`window_counts` over everything available now."""
    return (window_counts(records, width, delay).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


WATERMARKS = "seen timestamp_ntz, batch bigint"


def start_late_counts(records: DataFrame, path: str, checkpoint: str, width: str, delay: str):
    """Count what :func:`window_counts` leaves out, in a query of its own over
    the same records: late records per batch, deployment and window. The
    greatest ``ts`` seen is carried in a table, one row a batch; a batch
    that is tried again replaces its folders."""
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = (spark.read.schema(WATERMARKS).parquet(f"{path}/seen").where(F.col("batch") == batch_id - 1) if batch_id
                  else spark.createDataFrame([], WATERMARKS)).agg(F.max("seen").alias("seen"))  # one row
        told = batch.select("deployment_id", F.window("ts", width).alias("w")).join(F.broadcast(before), how="cross")
        late = told.where(F.col("w.end") <= F.col("seen") - F.expr(f"INTERVAL {delay}"))
        late.groupBy("deployment_id", F.col("w.start").alias("window_start")).agg(F.count("*").alias("late")).write.mode("overwrite").parquet(
            f"{path}/late/batch={batch_id}")
        now = batch.agg(F.max("ts").alias("seen")).unionByName(before).agg(F.max("seen").alias("seen"))
        now.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_window_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(deployment_id, window_start, late)`` over all batches."""
    rows = spark.read.schema("deployment_id bigint, window_start timestamp_ntz, late bigint, batch bigint").parquet(f"{path}/late")
    return rows.groupBy("deployment_id", "window_start").agg(F.sum("late").alias("late"))
