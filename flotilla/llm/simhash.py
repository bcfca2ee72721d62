"""SimHash near-duplicates through deletion-variant signatures.

A document's fingerprint has bit b set if over half of its shingle hashes
have it. Two fingerprints that differ in at most two bits are cut into two
segments of 32 bits, so in one of them they differ in at most one bit: with
that bit struck out the segments are equal. Every fingerprint is therefore
indexed under 64 variants (a segment with one bit struck out); an equality
join on the variants finds all links, and the bit count of the whole
fingerprints verifies them.

Only distinct fingerprints are joined, so copies cost nothing. A variant
shared by very many distinct fingerprints is not paired off. Its members are
linked through the points of Hamming distance at most one around them
instead: two fingerprints differ in at most two bits exactly if such points
coincide, so a star per point keeps every link with 65 rows a fingerprint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, add_columns, pieces, quoted, spare, written
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Members of a variant up to which pairs are verified one by one.
PAIRED = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint, as a signed long. Fewer words than a shingle: the
    whole sequence is the only shingle; no words (or null): 0."""
    from xxhash import xxh64_intdigest

    counts, total, carry = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or b"").translate(_LOWER), SPACE):
        words = carry + piece.split()
        if len(words) >= shingle:
            join = b" ".join
            hashes = np.array([xxh64_intdigest(join(s), seed) for s in zip(*[words[k:] for k in range(shingle)])], np.uint64)
            counts += _bit_counts(hashes)
            total += len(hashes)
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if not total and carry:
        counts, total = _bit_counts(np.array([xxh64_intdigest(b" ".join(carry), seed)], np.uint64)), 1
    bits = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
    return bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, column: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long column."""
    def compute():
        return lambda texts: {column: [fingerprint(t, shingle, seed) for t in texts]}
    return add_columns(docs, "text", T.StructType([T.StructField(column, T.LongType(), False)]), compute)


def variants(fps: DataFrame, segments: int) -> DataFrame:
    """One row for each bit struck out: (fp, slot, value); value is the segment
    of bit ``slot`` without that bit."""
    width = 64 // segments
    mask = F.lit(None).cast("long")
    for s in reversed(range(segments)):
        ones = ((1 << width) - 1) << (s * width)
        ones -= 1 << 64 if ones >> 63 else 0
        mask = F.when(F.col("slot") < (s + 1) * width, F.lit(ones)).otherwise(mask)
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
            .withColumn("value", F.col("fp").bitwiseAND(mask).bitwiseAND(F.expr("~shiftleft(1L, slot)"))))


def _stars(members: DataFrame, keys: list[str]) -> DataFrame:
    """Edges from every member of a key to its smallest member."""
    return (members.withColumn("c", F.min("fp").over(Window.partitionBy(*keys)))
            .filter("c <> fp").select(F.col("fp").alias("a"), F.col("c").alias("b")))


def links(spark: SparkSession, fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the same connections as
    all pairs that differ in ``max_bits`` bits or fewer.

    ``max_bits`` is 0, 1 or 2: that is what one bit struck out of one or two
    segments, and points one bit away, cover exactly.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    segments = max_bits // 2 + 1
    of_key = Window.partitionBy("slot", "value")
    shared = variants(fps, segments).withColumn("n", F.count(F.lit(1)).over(of_key)).filter("n > 1")
    if max_bits == 1:  # the one segment is the whole fingerprint: sharing a variant is the link
        return _stars(shared, ["slot", "value"])
    shared = written(spark, shared, "variants")
    few = shared.filter(F.col("n") <= paired)
    x, y = few.alias("x"), few.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    pairs = x.join(y, (F.col("x.slot") == F.col("y.slot")) & (F.col("x.value") == F.col("y.value"))
                   & (F.col("x.fp") < F.col("y.fp")) & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = shared.filter(F.col("n") > paired).select("fp").distinct()
    around = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        "fp", F.when(F.col("i") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, i)"))).alias("point"))
    return pairs.union(_stars(around, ["point"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, text_hash, fp, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable, itself included).

    Null texts and texts without words have fingerprint 0, linked like any
    other. Rows with a null doc_id take part and never are the smallest; a
    component of such rows only has a null component_id. Repeated rows each
    keep a row. An empty table gives an empty table; further columns are
    not read.
    """
    ids = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"),
                      F.xxhash64(quoted("text")).alias("text_hash"))
    known = written(spark, fingerprints(ids, "fp", shingle, seed).select("doc_id", "text_hash", "fp"), "fingerprints")
    least = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(spark, links(spark, known.select("fp").distinct(), max_bits))
    mapped = least.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    mapped = written(spark, mapped, "roots")
    smallest = mapped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = mapped.join(smallest, "root").select("fp", "component_id")
    return known.join(named, "fp").select(
        "doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the row of the smallest
    doc_id (of the smallest text hash if several rows have that id, of either
    if the rows are equal). All columns stay as they are."""
    found = near_duplicates(spark, docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    # null component ids only come from rows without doc_id: there the fingerprint tells components apart no better than
    # the root would, so such rows are grouped by fingerprint.
    key = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("own_fp")]
    first = found.groupBy(*key).agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    h, rank = spare(docs, "__text_hash"), spare(docs, "__rank")
    hashed = docs.withColumn(h, F.xxhash64(quoted("text")))
    kept = hashed.join(first, quoted("doc_id").eqNullSafe(F.col("__id")) & (F.col(h) == F.col("__hash")), "left_semi")
    same = Window.partitionBy(quoted("doc_id"), h).orderBy(F.lit(1))
    return kept.withColumn(rank, F.row_number().over(same)).filter(F.col(rank) == 1).drop(h, rank)
