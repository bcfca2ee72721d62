"""Reading the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SOURCE_TABLES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table as it is stored; naming the columns keeps the parquet
    ReadSchema narrow. Parallelism follows the scan's splits."""
    reader = spark.read.schema(SOURCE_TABLES[name]) if name in SOURCE_TABLES else spark.read
    df = reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df
