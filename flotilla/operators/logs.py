"""Log operators (E1-E5): render, style, reassemble, parse and count
deployment log records.

E1, E2 and E4 are row-local expressions and run unchanged on streaming
DataFrames. E3 needs the line order: a record is a header line plus the
continuation lines after it, so its number is a running count of headers.
A single running window per deployment would put a busy deployment in one
task; instead the count is split in two levels:

* per ``(deployment_id, chunk)``, with ``chunk = seq div chunk_span``, a
  header count (partial aggregate) and an exclusive prefix sum over the
  chunks of a deployment (a window over one row per chunk);
* inside each ``(deployment_id, chunk)`` a local running count.

A line's record number is the chunk offset plus the local count, so the
widest window partition holds one chunk of lines, however many lines a
deployment has. The lines of a record inside a chunk are then grouped in
place, and one regrouping by record joins the pieces of the few records that
reach into further chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LOG_HEADER_START, LOG_STATUSES, LOG_STYLES, LOG_TIME_COLOR
from ..functions.columns import iso_time

DEFAULT_CHUNK_SPAN = 1 << 16
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# -- E1, E2 ---------------------------------------------------------------------------

def log_line(ts: Column, status: Column, message: Column) -> Column:
    """``[iso time] status: message`` (the non-terminal form)."""
    return F.concat(F.lit("["), iso_time(ts), F.lit("] "), status, F.lit(": "), message)


def format_log(records: DataFrame) -> DataFrame:
    """One rendered line per record; works on streams."""
    return records.select("deployment_id", "seq",
                          log_line(F.col("ts"), F.col("status"), F.col("message")).alias("line"))


def _style_case(status: Column, field: int) -> Column:
    expr = None
    for row in LOG_STYLES:
        v = F.lit(row[field])
        expr = F.when(status == row[0], v) if expr is None else expr.when(status == row[0], v)
    return expr


def style_log(records: DataFrame) -> DataFrame:
    """Terminal style of each record: the time is always yellow bold; a
    known status adds a label and the message colours; another status
    prints the time only (nulls). A CASE over five literals, no join."""
    s = F.col("status")
    return records.select(
        "deployment_id", "seq", F.lit(LOG_TIME_COLOR).alias("time_color"),
        _style_case(s, 1).alias("label"), _style_case(s, 2).alias("fg"),
        _style_case(s, 3).cast("string").alias("bg"), _style_case(s, 4).alias("bold"),
    )


# -- E4 ---------------------------------------------------------------------------------

def parse_text(text: Column) -> dict[str, Column]:
    """E4 on a text column: prompt text glued before the header, time,
    status and message (which may span lines); nulls when the text has no
    header. The regex runs once (a common subexpression); the parts are cut
    from what it matched, ``prompt[time] status: ``."""
    head = F.regexp_extract(text, LOG_HEADER_START, 0)
    tail = F.substring_index(head, "[", -1)  # the time and the status hold no bracket
    status = F.substring_index(tail, "] ", -1)
    parts = {
        "prompt": F.left(head, F.length(head) - F.length(tail) - 1),
        "ts": F.substring_index(tail, "]", 1).try_cast("timestamp_ntz"),
        "status": F.left(status, F.length(status) - 2),
        "message": F.substr(text, F.length(head) + 1),
    }
    return {k: F.when(head != "", v) for k, v in parts.items()}


def parse_log(df: DataFrame, text_col: str = "line", keep=("deployment_id", "seq")) -> DataFrame:
    """``(.., prompt, ts, status, message)`` parsed from text."""
    p = parse_text(F.col(text_col))
    return df.select(*keep, *[v.alias(k) for k, v in p.items()])


# -- E3 -----------------------------------------------------------------------------------

def is_header(line: Column) -> Column:
    return F.coalesce(line.rlike(LOG_HEADER_START), F.lit(False))


def number_records(lines: DataFrame, chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Each physical line with its record number ``rec`` within the
    deployment (lines before the first header get record 0) and its
    ``chunk``."""
    marked = lines.select("deployment_id", "seq", "sub_no", "line",
                          F.expr(f"seq div {int(chunk_span)}").alias("chunk"),
                          is_header(F.col("line")).cast("int").alias("h"))
    per_chunk = marked.groupBy("deployment_id", "chunk").agg(F.sum("h").alias("hc"))
    before = Window.partitionBy("deployment_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("deployment_id", "chunk",
                               F.coalesce(F.sum("hc").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("deployment_id", "chunk").orderBy("seq", "sub_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumn("local", F.sum("h").over(running))
    return (local.join(offsets, ["deployment_id", "chunk"])
            .select("deployment_id", "chunk", "seq", "sub_no", "line",
                    (F.col("offset") + F.col("local")).alias("rec")))


def assemble_records(lines: DataFrame, chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """``(deployment_id, rec, first_seq, text)``: the physical lines of
    each record joined by newlines, in ``(seq, sub_no)`` order.

    The lines of a record in one chunk are grouped where they already are
    (partitioned by deployment and chunk: no shuffle); one regrouping by
    record then joins the pieces of records that cross a chunk edge. Each
    group is one record, i.e. one output value."""
    pieces = number_records(lines, chunk_span).groupBy("deployment_id", "chunk", "rec").agg(
        F.sort_array(F.collect_list(F.struct("seq", "sub_no", "line"))).alias("ls"))
    pieces = pieces.select("deployment_id", "rec", F.struct(
        "chunk", F.col("ls")[0]["seq"].alias("seq"), F.array_join(F.col("ls")["line"], "\n").alias("text")).alias("piece"))
    whole = pieces.groupBy("deployment_id", "rec").agg(F.sort_array(F.collect_list("piece")).alias("ps"))
    return whole.select("deployment_id", "rec", F.col("ps")[0]["seq"].alias("first_seq"),
                        F.array_join(F.col("ps")["text"], "\n").alias("text"))


# -- E3 on raw files ----------------------------------------------------------------------

#: What names a split of a log file, and the order of splits in a deployment's log.
SPLIT = ["deployment_id", "file", "block"]


def number_lines(raw: DataFrame) -> DataFrame:
    """Raw lines of :func:`sources.log_files.read_log_files` with ``line_no``
    and the record number ``rec`` (both counted through the deployment's files).

    A prefix sum in two passes. The first counts lines and headers per split
    of a file and sums them over the splits before, in file and block order:
    one row a split, so the window over a deployment's splits is small. The
    second numbers lines inside their split and adds those sums. No task holds
    more lines than one split has."""
    marked = raw.withColumn("h", is_header(F.col("line")).cast("int"))
    per_split = marked.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.sum("h").alias("hc"))
    before = Window.partitionBy("deployment_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = per_split.select(*SPLIT, F.coalesce(F.sum("n").over(before), zero).alias("lines_before"),
                               F.coalesce(F.sum("hc").over(before), zero).alias("recs_before"))
    inside = Window.partitionBy(*SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.select(*SPLIT, "line", F.count("*").over(inside).alias("no"), F.sum("h").over(inside).alias("rn"))
    return local.join(offsets, SPLIT).select(
        *SPLIT, (F.col("lines_before") + F.col("no")).alias("line_no"), (F.col("recs_before") + F.col("rn")).alias("rec"), "line")


def assemble_files(raw: DataFrame) -> DataFrame:
    """E3 on raw log files: ``(deployment_id, rec, first_line, text)``, lines
    counted from 1 in each deployment's log. Lines are joined where their
    split was numbered; one regrouping joins the pieces of records that go on
    in the next split or file."""
    pieces = number_lines(raw).groupBy(*SPLIT, "rec").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    pieces = pieces.select("deployment_id", "rec", F.struct(
        F.col("ls")[0]["line_no"].alias("line_no"), F.array_join(F.col("ls")["line"], "\n").alias("text")).alias("piece"))
    whole = pieces.groupBy("deployment_id", "rec").agg(F.sort_array(F.collect_list("piece")).alias("ps"))
    return whole.select("deployment_id", "rec", F.col("ps")[0]["line_no"].alias("first_line"),
                        F.array_join(F.col("ps")["text"], "\n").alias("text"))


# -- E5 -------------------------------------------------------------------------------------

def status_counts(records: DataFrame) -> DataFrame:
    """E5: records per deployment and status, one column per known status.
    A pivot over the fixed status list written as conditional counts: one
    aggregate (one shuffle, partial counts map-side) instead of the two a
    ``pivot`` plans, and valid as a single stateful operator on a stream."""
    return records.groupBy("deployment_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in LOG_STATUSES])


def ts_text(ts: Column) -> Column:
    """A timestamp as fixed-width text, for comparisons across engines."""
    return F.date_format(ts, TS_TEXT_FORMAT)
