"""A store of changes (``operators.changes``): runs are appended, records are
read by folding, and compaction writes the fold of everything so far.

    <path>/changes/run=<n>/    the changes of a run
    <path>/base/upto=<n>/      the last change of every key in runs 0 .. n,
                               removals included

A reader takes the newest base and the runs after it. Nothing is ever
changed in place: a run or a compaction that is tried again replaces its own
folder, and a reader of an older base sees what it saw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import changes as G

SCHEMA = "deployment_id bigint, change_no bigint, state_key string, op string, state_value string"


def append_run(changes: DataFrame, path: str, run: int) -> str:
    """Write the changes of run ``run``."""
    changes.select(*G.COLUMNS).write.mode("overwrite").parquet(f"{path}/changes/run={int(run)}")
    return path


def _read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All folders of a kind, or None if there is none yet."""
    try:
        return spark.read.schema(f"{SCHEMA}, {name} int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """What folds to the store's records: the newest base and the runs after
    it. Runs the base holds are not read (their folders are pruned)."""
    runs, bases = _read(spark, f"{path}/changes", "run"), _read(spark, f"{path}/base", "upto")
    newest = bases.agg(F.max("upto")).first()[0] if bases is not None else None
    if newest is None:
        return runs.select(*G.COLUMNS)
    return (runs.where(F.col("run") > newest).select(*G.COLUMNS)
            .unionByName(bases.where(F.col("upto") == newest).select(*G.COLUMNS)))


def read_records(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """A1 from the store: ``(deployment_id, state_key, state_value)``."""
    return G.fold_changes(read_changes(spark, path), upto)


def compact(spark: SparkSession, path: str) -> int:
    """Write the fold of all runs as a new base; returns its last run. Reads
    the base before and the runs since, never the whole history. Removals stay
    in it, since a record may be told apart from no record, and a change that
    arrives late must still lose against them."""
    upto = _read(spark, f"{path}/changes", "run").agg(F.max("run")).first()[0]
    G.latest_changes(read_changes(spark, path)).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    return upto
