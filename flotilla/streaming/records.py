"""E3 on a stream: records put together from lines that arrive in batches.

The last record of a deployment stays open until a later header closes it, so
each micro-batch needs what the one before left open. That is carried in a
table, one folder a batch, written in one job with the batch's closed records
and late lines:

    <path>/batch=<n>/kind=closed   records that are complete
    <path>/batch=<n>/kind=open     a row a deployment: its record count, the
                                   last line seen, and the text still open
    <path>/batch=<n>/kind=late     lines that came too late

A batch reads the open rows of the batch before and writes its own folder
anew, so a batch that is tried again, after a lost executor or a restart of
the query, leaves the same rows once.

Late lines: a line whose (seq, sub_no) is not after the last line of its
deployment in an earlier batch is not put into a record any more; it is kept
as a row of kind ``late`` with the reason ``order``. Lines inside a batch are
ordered first. With ``idle_batches``, a deployment without lines for so many
batches has its open record closed; lines that would have continued it are
late with the reason ``closed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as E

ROWS = ("deployment_id bigint, rec bigint, first_seq bigint, text string, last_seq bigint, last_sub int, idle int, "
        "reason string, kind string, batch bigint")
COLUMNS = ["deployment_id", "rec", "first_seq", "text", "last_seq", "last_sub", "idle", "reason", "kind"]


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(path).where(F.col("kind") == kind)


def carry(lines: DataFrame, state: DataFrame, idle_batches: int | None = None) -> DataFrame:
    """Rows (COLUMNS) of one batch from its lines and the open rows before.
    Joins are from lines and records to a row a deployment, so that a
    deployment with very many lines can be split."""
    before = state.select("deployment_id", F.col("rec").alias("recs"), F.col("first_seq").alias("open_seq"),
                          F.col("text").alias("open_text"), "last_seq", "last_sub", F.col("idle").alias("waited"))
    seen = (lines.select("deployment_id", "seq", "sub_no", "line")
            .join(before.select("deployment_id", "last_seq", "last_sub"), "deployment_id", "left")
            .withColumn("fresh", F.expr("last_seq IS NULL OR seq > last_seq OR (seq = last_seq AND sub_no > last_sub)")))
    fresh = seen.where("fresh").select("deployment_id", "seq", "sub_no", "line")

    pieces = E.assemble_records(fresh).withColumnsRenamed({"rec": "local", "text": "new_text", "first_seq": "new_seq"})
    heads = fresh.groupBy("deployment_id").agg(F.sum(E.is_header(F.col("line")).cast("bigint")).alias("heads"),
                                               F.max(F.struct("seq", "sub_no")).alias("last"))
    # A row a deployment: its records before (recs) and after this batch (top).
    zero = F.lit(0).cast("bigint")
    now = before.join(heads, "deployment_id", "full").select(
        "deployment_id", F.col("recs").isNotNull().alias("known"), F.coalesce("recs", zero).alias("recs"), "open_seq", "open_text",
        (F.coalesce("recs", zero) + F.coalesce("heads", zero)).alias("top"),
        F.coalesce(F.col("last.seq"), "last_seq").alias("last_seq"), F.coalesce(F.col("last.sub_no"), "last_sub").alias("last_sub"),
        F.when(F.col("heads").isNotNull(), 0).otherwise(F.col("waited") + 1).alias("idle"))

    # Lines before the batch's first header (local record 0) go on with what was open,
    # unless that was closed for idleness.
    on = F.col("local") == 0
    gone = on & F.col("known") & F.col("open_text").isNull()
    told = pieces.join(now, "deployment_id").select(
        "deployment_id", (F.col("recs") + F.col("local")).alias("rec"), "top",
        F.when(on, F.coalesce("open_seq", "new_seq")).otherwise(F.col("new_seq")).alias("first_seq"),
        F.when(on, F.concat_ws("\n", "open_text", "new_text")).otherwise(F.col("new_text")).alias("text"),
        "last_seq", "last_sub", "idle", gone.alias("gone"))
    left = now.where("known").join(pieces.where(on).select("deployment_id"), "deployment_id", "left_anti").select(
        "deployment_id", F.col("recs").alias("rec"), "top", F.col("open_seq").alias("first_seq"), F.col("open_text").alias("text"),
        "last_seq", "last_sub", "idle", F.lit(False).alias("gone"))

    last = F.col("rec") == F.col("top")
    over = last & (F.col("idle") >= idle_batches) if idle_batches else F.lit(False)
    kept = ~over & ~F.col("gone")

    def row(kind: str, reason: str | None = None, rec=F.col("rec"), seq=F.col("first_seq"), text=F.col("text"), carried: bool = False):
        own = [F.col(c) if carried else F.lit(None).cast(t) for c, t in (("last_seq", "bigint"), ("last_sub", "int"), ("idle", "int"))]
        return F.struct(*[v.alias(n) for v, n in zip([rec, seq, text, *own, F.lit(reason).cast("string"), F.lit(kind)], COLUMNS[1:])])

    out = F.array_compact(F.array(
        F.when(F.col("gone"), row("late", "closed", rec=F.lit(None).cast("bigint"))),
        F.when(~F.col("gone") & F.col("text").isNotNull() & (~last | over), row("closed")),
        F.when(last, row("open", seq=F.when(kept, F.col("first_seq")), text=F.when(kept, F.col("text")), carried=True))))
    old = row("late", "order", rec=F.lit(None).cast("bigint"), seq=F.col("seq"), text=F.col("line"))
    return (told.unionByName(left).select("deployment_id", F.inline(out))
            .unionByName(seen.where("not fresh").select("deployment_id", F.inline(F.array(old)))))


def start(lines: DataFrame, path: str, checkpoint: str, idle_batches: int | None = None):
    """Start (or restart) the stream over everything available now; lines are
    ``(deployment_id, seq, sub_no, line)``. Returns the running query."""
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _table(spark, path, "open").where(F.col("batch") == batch_id - 1) if batch_id else spark.createDataFrame([], ROWS)
        carry(batch, state, idle_batches).select(*COLUMNS).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, path: str, ended: bool = True) -> DataFrame:
    """``(deployment_id, rec, first_seq, text)`` as E3 gives them: all closed
    records and, if the stream has ``ended``, those its last batch left open."""
    columns = ["deployment_id", "rec", "first_seq", "text"]
    closed = _table(spark, path, "closed").select(*columns)
    if not ended:
        return closed
    rows = _table(spark, path, "open")
    last = rows.agg(F.max("batch").alias("batch"))
    left = rows.join(F.broadcast(last), "batch").where(F.col("text").isNotNull())
    return closed.unionByName(left.select(*columns))


def late_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(deployment_id, seq, text, reason)`` of what came too late."""
    return _table(spark, path, "late").select("deployment_id", F.col("first_seq").alias("seq"), "text", "reason")
