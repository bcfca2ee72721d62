"""Cleaning a corpus: quality rules, line dedup, near-duplicates, benchmark
decontamination, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of their input; where a stage edits ``text``, an
``n_chars`` column follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flotilla.llm import decontaminate, line_dedup, quality, simhash, spm
from flotilla.llm.common import quoted, read, spare, written
from flotilla.llm.queries import PIECE_MODEL


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there is such a column, brought up to date."""
    return docs.select(*[F.length(quoted("text")).cast("long").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.clean_documents(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator's own columns are dropped; columns of ``docs`` that bear
    their names are carried under spare ones meanwhile."""
    held = {c: spare(docs, f"__held_{i}") for i, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(held))
    out = out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in held.items()})
    return _counted(out.select(*[quoted(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.round_trip(docs, PIECE_MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_ids),
]

#: Fingerprints (XXH64) and BPE ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
