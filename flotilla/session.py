"""Session helpers: a tuned local session for tests and the bench, and the
shared scratch folder taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "flotilla", cpus: int | str = "*", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session with the settings this library is tuned for.

    On a cluster, create the session with the cluster's own launcher; the
    operators only rely on AQE being on and on a session time zone of UTC
    for text rendering of timestamps.
    """
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in {**JOIN_POLICY, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Join policy. Static size estimates do not see the row fan-out of a
# generator (one request row becomes tens of machine or key rows), so a
# broadcast chosen from them is unchecked. Broadcasts are therefore left to
# AQE, which converts a sort-merge join only after the smaller side's shuffle
# stage has run and its measured size is under the threshold.
JOIN_POLICY = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def apply_join_policy(spark: SparkSession) -> None:
    """Set :data:`JOIN_POLICY` on the session (idempotent)."""
    for k, v in JOIN_POLICY.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; this helper
    only sets one of its own when none is set and the master is local (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="flotilla-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written table."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names a local folder; a cluster needs a shared one")
    return f"{base.rstrip('/')}/flotilla/{name}-{uuid.uuid4().hex}"
