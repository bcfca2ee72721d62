"""Reproducible shuffle into shards: a Feistel permutation with cycle walking
over global row numbers.

Everything is DataFrame functions. Rows get gapless global numbers, ordered
by a fixed hash bucket and then by their values, so the number depends on the
rows alone and not on files or partitions. The permutation sends the number
``g`` to a place ``p``; the shard is ``p mod shards`` and the slot ``p div
shards``, so both follow from ``g``, the row count and the seed without
looking at other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, spare, without

#: Rows are numbered bucket by bucket. The table of bucket sizes has at most
#: this many rows, which bounds what is broadcast.
BUCKETS = 8192
ROUNDS = 6
#: Steps of the cycle walk. Out of a*b numbers fewer than a are no row number
#: (a is about the root of the row count), so 24 steps outside in a row do not
#: happen; a row that did would stop the job instead of getting a wrong place.
WALK = 24
#: Copies of one row that one task lays out at a time.
COPIES = 65_536


def feistel(number: Column, a: Column, b: Column, seed: int) -> Column:
    """Permute 0 .. a*b-1: the number is split as (l, r) with l < a and r < b,
    and each round adds a keyed hash of one half to the other, modulo."""
    start = F.struct((number / b).cast("long").alias("l"), F.pmod(number, b).alias("r"))
    keys = F.array(*[F.lit(seed * 1_000_003 + k).cast("long") for k in range(ROUNDS)])

    def turn(x: Column, key: Column) -> Column:
        left = F.pmod(x["l"] + F.pmod(F.xxhash64(x["r"], key), a), a)
        return F.struct(left.alias("l"), F.pmod(x["r"] + F.pmod(F.xxhash64(left, key, F.lit(1)), b), b).alias("r"))

    return F.aggregate(keys, start, turn, lambda x: x["l"] * b + x["r"])


def permuted(number: Column, total: Column, a: Column, b: Column, seed: int) -> Column:
    """The place of ``number`` in 0 .. total-1: cycle walking repeats the
    permutation of the larger domain until it lands below ``total``."""
    first = feistel(number, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first,
                         lambda p, _: F.when(p < total, p).otherwise(feistel(p, a, b, seed)))
    place = F.when(first < total, first).otherwise(walked)
    return F.when(place < total, place).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def number_rows(rows: DataFrame, name: str = "global_row", total: str = "total_rows") -> DataFrame:
    """``rows`` with gapless global numbers and the row count.

    Equal rows are counted before the shuffle and laid out again afterwards,
    so a row repeated very often is no hot key; which of the equal rows gets
    which of their numbers makes no difference. Columns must be groupable
    (no maps). An empty table gives an empty table.
    """
    rows = without(rows, name, total)
    cols = [quoted(c) for c in rows.columns]
    n, bucket, before, first = (spare(rows, x) for x in ("__n", "__bucket", "__before", "__first"))
    counted = (rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
               .withColumn(bucket, F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")))
    sizes = counted.groupBy(bucket).agg(F.sum(n).alias("__size"))
    above = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(bucket, F.coalesce(F.sum("__size").over(above), F.lit(0)).alias(before),
                         F.sum("__size").over(whole).alias(total))
    inside = Window.partitionBy(bucket).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.withColumn(first, F.coalesce(F.sum(n).over(inside), F.lit(0)))
              .join(F.broadcast(sizes), bucket)
              .withColumn(first, F.col(first) + F.col(before)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES).cast("long")))
    placed = placed.select(*cols, total, n, first, chunk.alias("__chunk"))
    low = F.col("__chunk") * COPIES
    copy = F.explode(F.sequence(low, F.least(low + COPIES, F.col(n)) - 1))
    return placed.select(*cols, total, first, copy.alias("__copy")).select(
        *cols, (F.col(first) + F.col("__copy")).alias(name), total)


def shard_rows(rows: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``global_row``, ``total_rows``, ``shard`` and ``slot``.

    Shard sizes differ by one row at most and slots of a shard are gapless
    from 0. Null values and repeated rows are ordinary rows; clashing column
    names are replaced by the operator's.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = number_rows(without(rows, "shard", "slot"))
    total = F.col("total_rows")
    root = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    a, b, p = spare(rows, "__a"), spare(rows, "__b"), spare(rows, "__p")
    rows = rows.withColumn(a, root).withColumn(b, F.ceil(total / F.col(a)).cast("long"))
    rows = rows.withColumn(p, permuted(F.col("global_row"), total, F.col(a), F.col(b), seed))
    return (rows.withColumn("shard", F.pmod(F.col(p), F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor(F.col(p) / shards).cast("long")).drop(a, b, p))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 42) -> None:
    """Write whole rows as one folder a shard, each file in slot order."""
    out = shard_rows(rows, shards, seed)
    (out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Digest of the placement of documents: identity, size and checksum take
    part in the shuffle, the texts do not. A null text has no bytes: size 1
    and checksum 0."""
    text = F.coalesce(quoted("text"), F.lit(""))
    thin = documents.select(quoted("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(thin, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "global_row")
