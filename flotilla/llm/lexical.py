"""Ranked lexical search over hashed max-sketches.

The index has one row a document: its length, its distinct terms with their
occurrences, and a sketch, an array over hashed coordinates that holds the
largest occurrence count of the terms that fall on a coordinate. A term falls
on a few; the least of them bounds its count from above. A term's impact grows
with its count when the document is fixed, so the largest count of a
coordinate gives the coordinatewise maximum of the impacts.

A block of queries is looked up in the sketches of a batch of documents at
once: gathered coordinates, turned into impacts, times the matrix of query
weights are upper bounds of all scores. Each query then takes documents by
descending bound and scores them exactly until its next bound cannot reach
its worst hit so far. Hits are kept through a whole task; one ranking a query
over the tasks' hits gives the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, mapped, quoted, slices, written

TOP = 10
#: Coordinates of a sketch: the power of two that is at least this often the distinct terms, and not less than the second value.
SPREAD, NARROWEST = 16, 64
#: Where in its hash the coordinates of a term begin.
SHIFTS = (0, 20, 40)
#: A count of 255 stands for any count from there on; its impact is bounded by ONE / 1000.
FULL = 255
ONE = 1_000_000_000
#: Distinct terms of the queries in a block, and queries in it (a query of more terms is a block of its own).
BLOCK_TERMS, BLOCK_QUERIES = 20_000, 1_000
#: Query terms that are gathered at a time, and documents in a batch.
GATHER, BATCH = 4_096, 256

INDEX = "doc_id long, n long, terms binary, counts binary, sketch binary"


def hashed(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def packed(sketch: np.ndarray) -> bytes:
    """A sketch as bytes: the exponent of its width, a bit a coordinate, then
    the counts of the coordinates that have one."""
    return bytes([len(sketch).bit_length() - 1]) + np.packbits(sketch > 0).tobytes() + sketch[sketch > 0].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros(1 << data[0], np.uint8)
    raw = np.frombuffer(data, np.uint8, offset=1)
    out[np.unpackbits(raw[:len(out) // 8]).view(bool)] = raw[len(out) // 8:]
    return out


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of every term of a text, read piece by piece."""
    counts: Counter = Counter()
    for words in alnum_words(text or b""):
        counts.update(words)
    return counts


def coordinates(hashes: np.ndarray, width: int) -> np.ndarray:
    """The coordinates of each term (a row a shift) in a sketch of ``width``."""
    return np.stack([(hashes >> np.uint64(s) & np.uint64(width - 1)).astype(np.int64) for s in SHIFTS])


def sketch_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest count, up to FULL, of the terms that fall on a coordinate."""
    width = max(NARROWEST, 1 << (SPREAD * len(hashes) - 1).bit_length()) if len(hashes) else NARROWEST
    out = np.zeros(width, np.uint8)
    out[coordinates(hashes, width)] = 1
    often = np.flatnonzero(counts > 1)
    often = often[np.argsort(counts[often], kind="stable")]  # of equal coordinates, the last is assigned
    for row in coordinates(hashes[often], width):
        np.maximum(out[row], values := np.minimum(counts[often], FULL).astype(np.uint8), out=values)
        out[row] = values
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs``: doc_id, n (terms with repeats), terms (distinct,
    joined by line ends), counts (little-endian 32-bit) and sketch.

    A null or empty text has no terms. Every row is a document of its own,
    repeated rows too. doc_id must be of an integer type; other types are
    refused, null ids are kept. Other columns are not read. A very long text
    is cut into words piece by piece; its distinct terms are held together.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError("doc_id must be an integer column")
    thin = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in slices(batches, BATCH):
            texts = batch.column(1).cast(pa.binary())
            rows: tuple[list, ...] = ([], [], [], [])
            for text in texts:
                counts = term_counts(text.as_py())
                if len(memory) > 100_000:
                    memory.clear()
                memory.update((t, hashed(t)) for t in counts if t not in memory)
                hashes = np.fromiter(map(memory.__getitem__, counts), np.uint64, len(counts))
                tf = np.fromiter(counts.values(), "<i4", len(counts))
                for column, value in zip(rows, (int(tf.sum()), b"\n".join(counts), tf.tobytes(), packed(sketch_of(hashes, tf)))):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)],
                                             names=["doc_id", "n", "terms", "counts", "sketch"])

    return mapped(thin, run, INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, m):
    """Impact of a term that occurs tf times in a document of norm m."""
    return ONE * tf // (1000 * tf + 8 * m)


def norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 75 + 75 * n * n_docs // n_terms


def query_terms(items: DataFrame) -> DataFrame:
    """(block, item_no, item_id, terms, counts): every row of ``items`` is a
    query; blocks are closed in the task that reads them, by their distinct
    terms and queries, so that a block has a bounded size whatever the ids
    and texts are."""
    thin = items.select(F.spark_partition_id().cast("long").alias("part"), quoted("item_id").alias("item_id"),
                        quoted("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("item_no", T.LongType()),
                           T.StructField("item_id", items.schema["item_id"].dataType),
                           T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, queries, number = 0, set(), 0, 0
        for batch in slices(batches, BATCH):
            found = [term_counts(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            blocks, numbers = [], []
            for part, counts in zip(batch.column(0).to_pylist(), found):
                if queries and (queries >= BLOCK_QUERIES or len(held | counts.keys()) > BLOCK_TERMS):
                    block, held, queries = block + 1, set(), 0
                held |= counts.keys()
                queries, number = queries + 1, number + 1
                blocks.append((part << 32) + block)
                numbers.append((part << 40) + number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()), batch.column(1),
                 pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=schema.names)

    return mapped(thin, run, schema)


def document_frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of ``terms`` occurs: counted in the tasks,
    one row a term and task, then summed."""
    shared = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for data in batch.column(0):
                counts.update(shared.value.intersection(data.as_py().split(b"\n")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

    partial = mapped(index.filter("n > 0").select("terms"), run, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Queries:
    """A block of queries as matrices, and the best documents of each so far."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, n_docs: int, n_terms: int, top: int = TOP):
        self.terms, self.top = terms, top
        #: Scores of whole numbers below 2**53 are exact as floats, which are faster to multiply.
        safe = weights.sum(axis=0, dtype=float).max(initial=0) * (ONE // 1000) < 2 ** 53
        self.weights, self.floats = weights.astype(float) if safe else weights, weights.astype(float)
        self.place = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([hashed(t) for t in terms], np.uint64)
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        self.n_docs, self.n_terms = n_docs, n_terms
        self.hits: list[list[tuple[int, tuple[bool, int], int | None]]] = [[] for _ in range(weights.shape[1])]

    def bounds(self, sketches: list[bytes], norms: np.ndarray) -> np.ndarray:
        """Upper bound of every document's score for every query, raised by
        more than float products can lose."""
        out = np.zeros((len(sketches), self.weights.shape[1]))
        tables = [unpacked(s) for s in sketches]
        for at in range(0, len(self.terms), GATHER):
            for width in {len(t) for t in tables} - {w for w, a in self.cells if a == at}:
                self.cells[width, at] = coordinates(self.hashes[at:at + GATHER], width)
            tf = np.stack([t[self.cells[len(t), at]].min(axis=0) for t in tables])
            row, column = np.nonzero(tf)
            count = tf[row, column].astype(np.int64)
            impacts = np.zeros(tf.shape)
            impacts[row, column] = np.where(count == FULL, ONE // 1000, impact(count, norms[row]))
            out += impacts @ self.floats[at:at + GATHER]
        return out * (1 + 2.0 ** -40)

    def exact(self, terms: bytes, counts: bytes, m: int) -> np.ndarray:
        """The document's score for every query, from its own terms."""
        tf = np.frombuffer(counts, "<i4").astype(np.int64)
        place = self.place
        found = [(place[t], i) for i, t in enumerate(terms.split(b"\n")) if t in place]
        if not found:
            return np.zeros(self.weights.shape[1])
        at, of = np.array(found).T
        return impact(tf[of], m).astype(self.weights.dtype) @ self.weights[at]

    def search(self, ids: list[int | None], n: list[int], terms, counts, sketches: list[bytes]) -> None:
        """Take a batch of documents; ``terms`` and ``counts`` give a
        document's forward lists by place."""
        norms = np.array([norm(x, self.n_docs, self.n_terms) for x in n], np.int64)
        bounds = self.bounds(sketches, norms)
        scored: dict[int, np.ndarray] = {}
        for q, hits in enumerate(self.hits):
            column = bounds[:, q]
            least = hits[-1][0] if len(hits) == self.top else 1
            candidates = np.flatnonzero(column >= least)
            for d in candidates[np.argsort(-column[candidates], kind="stable")].tolist():
                if len(hits) == self.top and column[d] < hits[-1][0]:
                    break  # no later bound reaches the worst hit
                if d not in scored:
                    scored[d] = self.exact(terms[d].as_py(), counts[d].as_py(), int(norms[d]))
                score = int(scored[d][q])
                if score > 0:
                    self.add(hits, (score, (ids[d] is None, ids[d] or 0), ids[d]))

    def add(self, hits: list, new: tuple) -> None:
        """Insert by descending score, then id, and keep the best."""
        at = len(hits)
        while at and (hits[at - 1][0] < new[0] or hits[at - 1][0] == new[0] and hits[at - 1][1] > new[1]):
            at -= 1
        if at < self.top:
            hits.insert(at, new)
            del hits[self.top:]


def search(spark: SparkSession, index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of a written ``index`` for every row of
    ``items``: item_no, item_id, rank, doc_id, score. Equal scores go by
    ascending doc_id, documents without an id last; scores of 0 are no hits.

    Every row of ``items`` is a query of its own with an item_no of its own:
    rows that share an item_id, copies too, give a list each. Items without
    terms (null, empty, punctuation) have no hits, nor has any item if no
    document has a term. A null item_id stays null. Other columns are not read.

    Queries pass through the driver a block at a time (BLOCK_TERMS,
    BLOCK_QUERIES); each block is one scan of the index. Documents never do.
    """
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    dealt = items.repartition(max(1, -(-items.count() // BLOCK_QUERIES)))  # about a block a partition
    queries = written(spark, query_terms(dealt), "queries")
    item = queries.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_no", T.LongType()), T.StructField("item_id", item),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    blocks = [r["block"] for r in queries.select("block").distinct().orderBy("block").toLocalIterator()] if n_terms else []
    for block in blocks:
        rows = queries.filter(F.col("block") == block).collect()
        terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        if not terms:
            continue
        df = document_frequencies(index, set(terms))
        terms = [t for t in terms if t in df]
        place = {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(terms), len(rows)), np.int64)
        for q, r in enumerate(rows):
            for t, c in zip(r["terms"], r["counts"]):
                if bytes(t) in place:
                    weights[place[bytes(t)], q] = c * weight(n_docs, df[bytes(t)])
        shared = spark.sparkContext.broadcast((terms, weights, [(r["item_no"], r["item_id"]) for r in rows]))
        found = found.unionByName(_hits(index, shared, n_docs, n_terms, top, schema))
    best = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_no", "item_id", "rank", "doc_id", "score")


def _hits(index: DataFrame, shared, n_docs: int, n_terms: int, top: int, schema: T.StructType) -> DataFrame:
    """Each task's best documents for every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        terms, weights, names = shared.value
        queries = Queries(terms, weights, n_docs, n_terms, top)
        for batch in slices(batches, BATCH):
            if batch.num_rows:
                ids, n, words, counts, sketches = batch.columns
                queries.search(ids.to_pylist(), n.to_pylist(), words, counts, sketches.to_pylist())
        rows = [(no, item, doc, score) for (no, item), hits in zip(names, queries.hits) for score, _, doc in hits]
        kinds = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=schema.names)

    return mapped(index.filter("n > 0").select("doc_id", "n", "terms", "counts", "sketch"), run, schema)


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs``, write the index, and :func:`search` it."""
    return search(spark, written(spark, build_index(docs), "lexical-index"), items, top)
