"""Tables stored in buckets of ``deployment_id``.

State, outcomes and requests are joined and grouped by deployment over and
over. Written once into the same number of buckets, their rows for a
deployment lie in buckets of the same number, and Spark reads bucket by bucket:
aggregates and joins on the key then need no exchange (see
``copartitioned`` in ``operators.state`` and ``sources.state_io``).

A bucket is read by one task, so choose the count for about 128 MB a bucket
at the size the table will grow to, and the same count for all tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

KEY = "deployment_id"
#: Rows that a bucket holds at most on average, and the least buckets of a table.
BUCKET_ROWS, LEAST_BUCKETS = 1_500_000, 16


def bucket_count(rows: int) -> int:
    """Buckets for a table of so many rows: a power of two, so that tables of
    other sizes can be read in the same buckets, and enough that the memory
    of the task that writes or reads a bucket does not grow with the table."""
    n = LEAST_BUCKETS
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def write_bucketed(df: DataFrame, path: str, buckets: int, name: str | None = None) -> DataFrame:
    """Write ``df`` under ``path`` as an external table in ``buckets`` buckets
    of the key, sorted by it, and return the table. Rows are dealt by the key
    before the write, so a bucket is one file and not one of every task.
    ``name`` is the table's name in the session's catalog, which must keep it
    for later sessions to find the buckets (a metastore); without a name it
    gets one of its own."""
    name = name or f"flotilla_{uuid.uuid4().hex}"
    (df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path)
     .mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)
