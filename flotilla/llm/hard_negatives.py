"""Hard negatives for anchors among vectors, by exact integer scores.

Scores are inner products of integer components. A block of rows is
multiplied with a block of anchors once for each of several small primes:
matrices of residues in float32, whose products stay below 2**24 and are
therefore exact. The signed scores follow from the residues by Chinese
remaindering (mixed-radix digits around zero), so they are exact at the speed
of float32 products.

Two passes over the rows. The first keeps each anchor's best rows of its own
label (positives), the second, for every positive, the best rows of other
labels whose score lies in the window that the positive's score opens. A task
keeps only the best few for each anchor or window; one ranking over the
tasks' rows gives the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, quoted, slices, written

POSITIVES, NEGATIVES = 5, 5
#: Window of negative scores, in hundredths of the positive's score.
LEAST, MOST = 80, 100
#: Anchors in a block, which is broadcast, and rows in a batch.
ANCHORS, BATCH = 2_048, 1_024
SCALE = 256
#: Whole float32 numbers are exact below this.
EXACT = 1 << 24
#: Components multiplied at a time; longer vectors are summed chunk by chunk.
CHUNK = 1_024


def primes_for(dim: int, bound: int) -> list[int]:
    """Primes for vectors of ``dim`` components whose scores are at most
    ``bound`` in size: the largest whose residue products, summed over a chunk
    of components, stay exact, until their product covers -bound .. bound."""
    half = math.isqrt((EXACT - 1) // max(1, min(dim, CHUNK)))
    out, at, product = [], 2 * half + 1, 1
    while product <= 2 * bound:
        while not all(at % d for d in range(2, math.isqrt(at) + 1)):
            at -= 1
        out.append(at)
        product *= at
        at -= 1
    return out


def around_zero(values: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p between -(p-1)/2 and (p-1)/2."""
    r = np.mod(values, p)
    return np.where(r > (p - 1) // 2, r - p, r)


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [around_zero(values, p).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products of the rows of both sides, which are given
    by their residues."""
    digits: list[np.ndarray] = []
    for k, (a, b, p) in enumerate(zip(left, right, primes)):
        total = 0
        for at in range(0, a.shape[1], CHUNK):
            total = total + (a[:, at:at + CHUNK] @ b[:, at:at + CHUNK].T).astype(np.int64)
        rest = around_zero(total if a.shape[1] else np.zeros((len(a), len(b)), np.int64), p)
        for digit, q in zip(digits, primes):
            rest = around_zero((rest - digit) * pow(q, -1, p), p)
        digits.append(rest)
    return reduce(lambda value, k: value * primes[k] + digits[k], range(len(primes) - 2, -1, -1), digits[-1])


def whole_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: those whose vec_id,
    label, vector and components are all there and finite. Components are
    floor(256 * x); the label of every seventh vec_id is moved on by one."""
    vector = quoted("embedding").cast("array<double>")
    vec_id, label = quoted("vec_id").cast("long"), quoted("label").cast("long")
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.filter(vec_id.isNotNull() & label.isNotNull() & F.coalesce(good, F.lit(False)))
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return kept.select(vec_id.alias("vec_id"), moved.alias("label"), F.transform(vector, lambda v: F.floor(v * SCALE)).alias("vector"))


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` components; shorter ones end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.repeat(np.arange(len(vectors)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


NONE = np.iinfo(np.int64).min


class Best:
    """The ``k`` best (score, vec_id) of each of several searches so far, by
    descending score, then id. Scores under ``least`` are no hits."""

    def __init__(self, searches: int, k: int, least: np.ndarray | None = None):
        self.scores = np.full((searches, k), NONE, np.int64)
        self.ids = np.full((searches, k), NONE, np.int64)
        self.least = np.full(searches, NONE + 1) if least is None else least

    def take(self, scores: np.ndarray, ids: np.ndarray, start: int = 0) -> None:
        """Scores of a batch of rows (in ascending order of ids) for the
        searches from ``start`` on; NONE where a row is not eligible."""
        mine = slice(start, start + len(scores))
        worst = np.maximum(self.scores[mine, -1], self.least[mine])
        need = np.flatnonzero(scores.max(axis=1, initial=NONE) >= worst)
        if not len(need):
            return
        left, every, k = scores[need], np.arange(len(need)), self.scores.shape[1]
        found, found_ids = [self.scores[need + start]], [self.ids[need + start]]
        for _ in range(min(k, scores.shape[1])):
            at = left.argmax(axis=1)  # the first of equal scores, that is of the smallest id
            top = left[every, at]
            found.append(np.where(top >= self.least[need + start], top, NONE)[:, None])
            found_ids.append(ids[at][:, None])
            left[every, at] = NONE
        all_scores, all_ids = np.hstack(found), np.hstack(found_ids)
        # Negating a score would lose the smallest one; its complement keeps the order.
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        self.scores[need + start] = np.take_along_axis(all_scores, order, 1)
        self.ids[need + start] = np.take_along_axis(all_ids, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, vec_id, score) of all hits."""
        search, at = np.nonzero(self.scores > NONE)
        return search, self.ids[search, at], self.scores[search, at]


def _blocks(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors with a number of their own and the number of their block; a
    block is closed in the task that reads it."""
    thin = anchors.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "label", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            place = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            part = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((part << 32) + place // size), pa.array((part << 40) + place), *batch.columns[1:]],
                                             names=["block", "anchor_no", "vec_id", "label", "vector"])

    return mapped(thin, run, "block long, anchor_no long, vec_id long, label long, vector array<bigint>")


class Scorer:
    """A block of anchors, ready to be multiplied with batches of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, primes: list[int]):
        self.ids, self.labels, self.dim, self.primes = ids, labels, vectors.shape[1], primes
        self.residues = residues(vectors, primes)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, scores) of the rows by ascending id; scores has a
        row an anchor."""
        for batch in slices(batches, BATCH):
            order = np.argsort(ids := batch.column(0).to_numpy(), kind="stable")
            vectors = matrix(batch.column(2), self.dim)[order]
            yield ids[order], batch.column(1).to_numpy()[order], products(self.residues, residues(vectors, self.primes), self.primes)


def _task_hits(rows: DataFrame, search) -> DataFrame:
    """The hits of every task; ``search`` takes its batches and gives a Best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search(batches).rows()], names=["search", "vec_id", "score"])

    return mapped(rows, run, "search long, vec_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("search").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(spark: SparkSession, embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, anchors_a_block: int = ANCHORS) -> DataFrame:
    """Hard negatives (columns of RESULT) for the anchors among ``embeddings``
    (vec_id, embedding, label), the rows whose vec_id is divisible by ``every``.

    An anchor's positives are its ``positives`` best rows of the same label and
    another vec_id. For each, the ``negatives`` best rows of other labels with
    ``least * p <= 100 * score <= most * p`` are returned, p being the
    positive's score. Best means highest score, ties by smaller vec_id.

    Rows without vec_id, label or vector, or with a component that is null or
    not finite, take no part; neither do anchors without positives or windows
    without rows give any. Shorter vectors count as ending in zeros, empty ones
    score 0. Every row counts by itself: a repeated row may be drawn twice, and
    a repeated anchor has its lists twice. An empty table gives no rows. Other
    columns are not read. Vectors so large that a score could pass 2**62 are
    refused.

    Anchors, and then their positives, pass through the driver a block of
    ``anchors_a_block`` at a time (fewer if vectors are long); each block is
    two scans of all rows.
    """
    rows = written(spark, whole_rows(embeddings), "vectors")
    squares = F.aggregate(F.col("vector"), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    is_anchor = F.col("vec_id") % every == 0
    seen = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(squares).alias("square"), F.count_if(is_anchor).alias("anchors")).first()
    out = spark.createDataFrame([], RESULT)
    if seen["dim"] is None:
        return out
    dim, bound = seen["dim"], math.ceil(seen["square"] * (1 + 2.0 ** -30)) + 1
    if bound >= 1 << 62:
        raise ValueError("scores could pass 2**62")
    primes = primes_for(dim, bound)  # no score passes the product of two vectors' lengths
    size = max(1, min(anchors_a_block, (1 << 22) // max(1, dim)))
    dealt = rows.filter(is_anchor).repartition(max(1, -(-seen["anchors"] // size)))  # about a block a partition
    anchors = written(spark, _blocks(dealt, size), "anchors")
    for block in [r["block"] for r in anchors.select("block").distinct().orderBy("block").toLocalIterator()]:
        found = anchors.filter(F.col("block") == block).orderBy("anchor_no").toArrow()
        ids, labels = found["vec_id"].to_numpy(), found["label"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, labels, matrix(found["vector"].combine_chunks(), dim)))
        pairs = _ranked(_positives(rows, shared, primes, positives), positives).orderBy("search", "rank").toArrow()
        pairs = [(a, p, s, -(-least * s // 100), most * s // 100)
                 for a, p, s in zip(*(pairs[c].to_pylist() for c in ("search", "vec_id", "score")))]
        pairs = [p for p in pairs if p[3] <= p[4]]
        if not pairs:
            continue
        windows = spark.createDataFrame(pa.table([pa.array(range(len(pairs)), pa.int64()), pa.array([int(ids[p[0]]) for p in pairs], pa.int64()),
                                                  pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[2] for p in pairs], pa.int64())],
                                                 names=["search", "anchor_id", "positive_id", "positive_score"]))
        best = _ranked(_negatives(rows, shared, spark.sparkContext.broadcast(pairs), primes, negatives), negatives)
        out = out.unionByName(best.join(windows, "search").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def _positives(rows: DataFrame, shared, primes: list[int], k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Best:
        scorer = Scorer(*shared.value, primes)
        best = Best(len(scorer.ids), k)
        for ids, labels, scores in scorer.batches(batches):
            other = (scorer.labels[:, None] != labels) | (scorer.ids[:, None] == ids)
            scores[other] = NONE
            best.take(scores, ids)
        return best

    return _task_hits(rows, search)


def _negatives(rows: DataFrame, shared, pairs, primes: list[int], k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Best:
        scorer = Scorer(*shared.value, primes)
        anchor, _, _, low, high = (np.array(c, np.int64) for c in zip(*pairs.value))
        best = Best(len(anchor), k, low)
        for ids, labels, scores in scorer.batches(batches):
            scores[scorer.labels[:, None] == labels] = NONE
            for at in range(0, len(anchor), ANCHORS):
                mine = scores[anchor[at:at + ANCHORS]]
                mine[mine > high[at:at + ANCHORS, None]] = NONE
                best.take(mine, ids, at)
        return best

    return _task_hits(rows, search)
