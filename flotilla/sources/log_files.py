"""Captured logs as plain text files: a folder a deployment, its files in
the order of their names (a rotated log), lines without numbers."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import record_files
from .record_files import STAGING, drop, filesystem, finish, publish

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(record_files)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The only line end: a carriage return is part of a message.
LINE_END = "\n"


#: The folder name of lines without a deployment, as Spark reads and writes it.
NO_DEPLOYMENT = "__HIVE_DEFAULT_PARTITION__"


def written_by_tasks(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow's filesystems reach ``path`` as Spark does."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    if "://" not in path and not path.startswith("file:"):
        return default.startswith("file:")
    try:
        filesystem(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return False
    return True


def _write_attempt(path: str, job: str, lines_per_file: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a task's lines into a folder of its own attempt and report the folder."""
    files, base = filesystem(path)
    mine, task = posixpath.join(base, STAGING, job, uuid.uuid4().hex), TaskContext.get().partitionId()
    files.create_dir(mine, recursive=True)
    out, deployment, number, held = None, None, 0, 0
    for batch in batches:
        ids, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(ids):
            same = out is not None and ids[at] == deployment
            if not same or held == lines_per_file:
                if out is not None:
                    out.close()
                deployment, number, held = ids[at], number + 1 if same else 0, 0
                folder = posixpath.join(mine, f"deployment_id={NO_DEPLOYMENT if deployment is None else deployment}")
                if not same:
                    files.create_dir(folder)
                out = files.open_output_stream(posixpath.join(folder, f"part-{task:06d}-{number:09d}.txt"))
            end, most = at, len(ids) if lines_per_file is None else min(len(ids), at + lines_per_file - held)
            while end < most and ids[end] == deployment:
                end += 1
            out.write("".join(f"{x or ''}{LINE_END}" for x in lines[at:end]).encode("utf-8", "surrogatepass"))
            at, held = end, held + end - at
    if out is not None:
        out.close()
    yield pa.RecordBatch.from_pydict({"attempt": [posixpath.basename(mine)]})


def _publish_attempt(path: str, job: str, attempt: str) -> None:
    """Move an attempt's files to their places; those moved before stay there."""
    from pyarrow import fs
    files, base = filesystem(path)
    mine = posixpath.join(base, STAGING, job, attempt)
    found = files.get_file_info(fs.FileSelector(mine, recursive=True))
    for f in found:
        if f.type == fs.FileType.Directory:
            files.create_dir(posixpath.join(base, f.base_name))
    publish(files, mine, base, [posixpath.relpath(f.path, mine) for f in found if f.type == fs.FileType.File], 0)


def write_log_files(lines: DataFrame, path: str, lines_per_file: int | None = None) -> str:
    """Lines ``(deployment_id, seq, sub_no, line)`` as text files under
    ``path/deployment_id=<id>/``, in order. Lines are dealt by ranges of their
    whole order, so a deployment with very many lines is written by several
    tasks, whose files follow each other by name. ``lines_per_file`` starts a
    new file after so many lines.

    A deployment has many small files, and Spark's text sink starts several
    processes of the system for each file of a local folder. Tasks therefore
    write the files themselves, each attempt into a folder of its own under
    ``_staging``; when all are done, a second job moves the files of the
    attempts that were reported (as in ``record_files``). The driver sees one
    short text an attempt. A path that only Spark reaches is left to its sink."""
    order = ["deployment_id", "seq", "sub_no"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("deployment_id", F.col("line").alias("value"))
    spark = lines.sparkSession
    if not written_by_tasks(spark, path):
        writer = dealt.write.partitionBy("deployment_id").option("lineSep", LINE_END)
        if lines_per_file:
            writer = writer.option("maxRecordsPerFile", lines_per_file)
        writer.text(path)
        return path
    files, base = filesystem(path)
    if files.get_file_info(base).is_file or files.get_file_info(posixpath.join(base, "_SUCCESS")).is_file:
        raise FileExistsError(f"log files are there already: {path}")
    job, per_file = uuid.uuid4().hex, lines_per_file or None
    try:
        done = [r.attempt for r in dealt.mapInArrow(lambda b: _write_attempt(path, job, per_file, b), "attempt string").collect()]
        if done:
            spark.sparkContext.parallelize(done, len(done)).foreach(lambda a: _publish_attempt(path, job, a))
    except BaseException:
        drop(path, job)
        raise
    files.create_dir(base, recursive=True)
    finish(path, job)
    return path


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines ``(deployment_id, file, block, place, line)``: the file and
    the split of it that a line was read in, and its place among the lines of
    that split. ``place`` grows along a split and has gaps between splits;
    ``operators.logs.number_lines`` makes line numbers of it. Large files are
    read split by split (compressed ones can't be); blank lines are lines."""
    raw = spark.read.schema("value string, deployment_id bigint").option("lineSep", LINE_END).text(path)
    return raw.select("deployment_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
