"""Line dedup by passages of words: winnowing, with matches grown by words.

A text is the sequence of its words, across line ends. A *window* is a run of
``min_words`` words; it selects as fingerprint the smallest hash among its
runs of half as many words (the first of equal ones). A place emits its few
selected fingerprints, each with the *extent* of the windows that select it
(their first and number, and a hash of all their words).

Positions are joined on the fingerprint, as equal windows select equal ones.
An extent that occurs at an earlier place repeats as a whole. Of the others
one place each is left; where a fingerprint has two or more different extents,
a shared run ends between them, and their windows are compared one by one
(128-bit hash of the words) with the earliest place of the same words.
Repeated windows that overlap run together, so a match grows both ways, word
by word, to the full shared run, also where it begins and ends inside lines.

A line is deleted exactly if all its words lie in runs of at least
``min_words`` words that also occur at an earlier place (places are ordered by
doc_id, null first, hash of the text and word number). A line without words
goes if the words next to it on both sides do. Lines of which a part repeats
stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, quoted, slices, spare, without
from .line_dedup import MIN_WORDS


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def select(texts: list[bytes], min_words: int) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, extent, first window, number of windows) of every
    place that the windows of the texts select."""
    from xxhash import xxh64_intdigest
    hashes, sizes = [], []
    for text in texts:
        words = text.split()
        sizes.append(len(words) if len(words) >= min_words else 0)
        if sizes[-1]:
            hashes.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
    if not hashes:
        return (np.empty(0, np.int64),) * 5
    size, sizes = (min_words + 1) // 2, np.array(sizes)
    flat = np.concatenate(hashes)
    # Sums of hash * base ** place: the difference of two, moved back to place 0, is the hash of the words between.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * _powers(_BASE, len(flat)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(flat))
    grams = _mixed((sums[size:] - sums[:-size]) * back[:len(flat) - size + 1])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - min_words + 1, 0) * (sizes > 0))
    held = sizes > 0
    at = np.concatenate([np.arange(b, b + n - min_words + 1) for b, n in zip(begin[held].tolist(), sizes[held].tolist())])
    least = at + np.lib.stride_tricks.sliding_window_view(grams, min_words - size + 1).argmin(axis=1)[at]
    first = np.flatnonzero(np.diff(least, prepend=-1))
    n = np.diff(first, append=len(least))
    start = at[first]
    extents = _mixed((sums[start + n - 1 + min_words] - sums[start]) * back[start] + n.astype(np.uint64))
    return owner[first], grams[least[first]].view(np.int64), extents.view(np.int64), start - begin[owner[first]], n


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(quoted("doc_id").cast("long").alias("doc_id"), F.xxhash64(quoted("text")).alias("text_hash"),
                       quoted("text").alias("text")).filter("text is not null")


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every selected fingerprint of every document, with the extent of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            owner, prints, extents, first, n = select(batch.column(2).cast(pa.binary()).to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(prints),
                 pa.array(extents), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                names=["doc_id", "text_hash", "fingerprint", "extent", "first", "n"])

    return mapped(_thin(docs), run, "doc_id long, text_hash long, fingerprint long, extent long, first int, n int")


def window_hashes(docs: DataFrame, extents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every window of the extents (doc_id, text_hash, first, n) with its hash."""
    held = extents.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))
    held = held.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "ranges")
    joined = _thin(docs).join(held, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("window_hash", pa.binary()), ("start", pa.int32())])
        for batch in slices(batches, 64):
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text_hash, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                    batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                for r in ranges:
                    for k in range(r["first"], r["first"] + r["n"]):
                        for column, value in zip(out, (doc, text_hash, xxh3_128_digest(b" ".join(words[k:k + min_words])), k)):
                            column.append(value)
                    if len(out[0]) > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return mapped(joined.select("doc_id", "text_hash", "text", "ranges"), run,
                  "doc_id long, text_hash long, window_hash binary, start int")


def _later(at: DataFrame, keys: list[str], start: str) -> tuple[DataFrame, DataFrame]:
    """The earliest place of each key, and the rows of ``at`` at later places."""
    place = F.struct("doc_id", "text_hash", start)
    first = at.groupBy(*keys).agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times"))
    later = at.join(first.filter("times > 1").select(*keys, "place"), keys).filter(
        ~place.eqNullSafe(F.struct(*[F.col(f"place.{c}").alias(c) for c in ("doc_id", "text_hash", start)])))
    return first, later


def repeated_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): word ranges [start, stop) that repeat an earlier place."""
    first, later = _later(positions(docs, min_words), ["fingerprint", "extent", "n"], "first")
    whole = later.select("doc_id", "text_hash", F.col("first").alias("start"),
                         (F.col("first") + F.col("n") - 1 + min_words).alias("stop"))
    several = first.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("extents")).filter("extents > 1").select("fingerprint")
    edges = first.join(several, "fingerprint").select("place.doc_id", "place.text_hash", "place.first", "n")
    _, later = _later(window_hashes(docs, edges, min_words), ["window_hash"], "start")
    single = later.select("doc_id", "text_hash", "start", (F.col("start") + min_words).alias("stop"))
    return whole.union(single).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def cut(text: bytes, runs: list[dict]) -> tuple[bytes, int]:
    """The text without the lines whose words lie in the runs, and their number."""
    lines = text.split(b"\n")
    ends = np.cumsum([0] + [len(x.split()) for x in lines])
    total = int(ends[-1])
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, [r["start"] for r in runs], 1)
    np.add.at(step, [r["stop"] for r in runs], -1)
    gone = np.concatenate([[0], np.cumsum(np.cumsum(step[:total]) > 0)])
    kept = []
    for line, a, z in zip(lines, ends[:-1].tolist(), ends[1:].tolist()):
        if a == z:  # no words: the neighbours decide
            a, z = max(a - 1, 0), min(z + 1, total)
        if gone[z] - gone[a] < z - a:
            kept.append(line)
    return b"\n".join(kept), len(lines) - len(kept)


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated passages cut out of ``text``,
    and the columns n_lines and n_removed.

    No row is dropped; a text that repeats earlier passages throughout becomes
    empty. Null texts stay null (0 lines), an empty text is one empty line.
    Rows that agree in doc_id and text are one place and get the same result.
    An ``n_chars`` column is left as it was; clashing names are replaced.
    """
    docs = without(docs, "n_lines", "n_removed")
    found = repeated_words(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "runs")
    h, at = spare(docs, "__text_hash"), spare(docs, "__runs")
    marked = docs.withColumn(h, F.xxhash64(quoted("text"))).join(
        found.withColumnRenamed("runs", at),
        quoted("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(h) == F.col("__hash")), "left")
    marked = marked.select(*[quoted(c) for c in docs.columns], quoted(at))
    width, place = len(docs.columns), docs.columns.index("text")
    names = [*docs.columns, "n_lines", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_removed = batch.column(place).cast(pa.binary()).to_pylist(), [], []
            for k, runs in enumerate(batch.column(width).to_pylist()):
                n_lines.append(0 if texts[k] is None else texts[k].count(b"\n") + 1)
                n_removed.append(0)
                if runs:
                    texts[k], n_removed[k] = cut(texts[k], runs)
            arrays = [batch.column(k) for k in range(width)]
            arrays[place] = pa.array(texts, pa.binary()).cast(arrays[place].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    schema = docs.select(*[quoted(c) for c in docs.columns], F.lit(0).cast("long").alias("n_lines"),
                         F.lit(0).cast("long").alias("n_removed")).schema
    return mapped(marked, run, schema)
