"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Separators of words before A-Z are lower-cased.
NOT_ALNUM = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(data: bytes, boundary: re.Pattern, size: int = PIECE) -> Iterator[bytes]:
    """``data`` cut at separators into pieces of about ``size`` bytes, so that
    the words of a very long text are never all in memory. No word is cut."""
    start = 0
    while len(data) - start > size and (m := boundary.search(data, start + size)):
        yield data[start:m.start()]
        start = m.end()
    yield data[start:] if start else data


def alnum_words(data: bytes) -> Iterator[list[bytes]]:
    """Words of lower-cased (A-Z) text in consecutive lists."""
    for piece in pieces(data, NOT_ALNUM):
        yield ALNUM.findall(piece.lower())


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it
    back: the lineage ends there and lost executors cost no recomputation of
    what came before."""
    path = scratch_path(spark, f"llm-{name}")  # refuses a machine-local folder on a cluster
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a task holds few texts as
    Python objects at a time."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose Python workers find this package under the path
    it was imported from, wherever the session was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns an operator is about to add (names clash without case)."""
    mine = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in mine])


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, column: str, fields: T.StructType,
                compute: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """``df`` with ``fields`` added, computed from the values of ``column``
    (texts as UTF-8 bytes, null as None) one Arrow batch at a time.

    ``compute`` is called once a task and gives the function for a batch. All
    other columns pass through as Arrow arrays. A column of ``df`` whose name
    clashes with one of ``fields`` is replaced.
    """
    src = spare(df, "__src")
    kind = df.schema[column].dataType
    value = quoted(column) if isinstance(kind, T.StringType) else quoted(column).cast("string")
    rest = without(df, *fields.names)
    joined = df.select(*[quoted(c) for c in rest.columns], value.alias(src))
    out = T.StructType(rest.schema.fields + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        fn = compute()
        kinds = [to_arrow_type(f.dataType) for f in fields.fields]
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            new = fn(texts)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], k)
                       for f, k in zip(fields.fields, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return mapped(joined, run, out)
