"""Line dedup by winnowing over line hashes.

A *window* is the shortest run of whole lines, read forwards from a line or
backwards from a line, that holds at least ``min_words`` words. Each window
selects its smallest line hash as fingerprint (the first of equal ones). A
*position* is a line that windows select: as windows move on, the selection
moves seldom, so a text has few positions. A position carries its *extent*,
the lines that the windows selecting it cover, by range and by hash.

Positions are joined on the fingerprint. Any run of at least ``min_words``
words that two places share contains such windows whole, and equal windows
select equal fingerprints, so no repeated run is missed. Matches are extended
to both sides of the fingerprint: an extent that occurs at an earlier place
repeats as a whole. Of the others one place each is left; only where a
fingerprint has several different extents can a shared run end inside them, and
there their windows are compared one by one with the earliest place of the same
lines. Repeated windows that overlap run together to the full shared run. Every
run but the earliest goes.

So a line is deleted exactly if it lies in a run of consecutive lines with at
least ``min_words`` words that also occurs at an earlier place, where places
are ordered by doc_id (null first) and line number. Shorter repeated lines
(headings, license notes) stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, quoted, slices, spare, without, written

#: Words a repeated run must hold.
MIN_WORDS = 50
#: Bases of the two polynomial hashes of a run of lines (odd, so that they have inverses).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _minimal(held: np.ndarray, begin: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of all minimal windows in order, from the words before
    each line (``held``) and the first and next-to-last line of its text."""
    n = len(begin)
    every = np.arange(n)
    to = np.searchsorted(held, held[:-1] + min_words)  # forwards from a line
    fore = to <= end
    since = np.searchsorted(held, held[1:] - min_words, "right") - 1  # backwards from a line
    back = since >= begin
    pairs = np.unique(np.concatenate([every[fore] * n + to[fore] - 1, since[back] * n + every[back]]))
    return pairs // max(n, 1), pairs % max(n, 1)


def windows(lines: list[bytes], min_words: int) -> list[tuple[int, int]]:
    """Distinct (first, last) line numbers of all minimal windows."""
    held = np.cumsum([0] + [len(x.split()) for x in lines])
    n = len(lines)
    first, last = _minimal(held, np.zeros(n, np.int64), np.full(n, n), min_words)
    return list(zip(first.tolist(), last.tolist()))


def least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the smallest value in each range, the first of equal ones: by
    a table of the places for all ranges of 1, 2, 4, .. values."""
    table = [np.arange(len(values))]
    span = last - first + 1
    level = np.frompyfunc(int.bit_length, 1, 1)(span).astype(np.int64) - 1
    for k in range(1, int(level.max(initial=0)) + 1):
        a, b = table[-1][:-(1 << k - 1)], table[-1][1 << k - 1:]
        table.append(np.where(values[a] <= values[b], a, b))
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        mine = level == k
        a, b = table[k][first[mine]], table[k][last[mine] + 1 - (1 << k)]
        out[mine] = np.where(values[a] <= values[b], a, b)
    return out


class Runs:
    """Hashes of runs of lines by prefix sums: no line is hashed twice."""

    def __init__(self, hashes: np.ndarray):
        """``hashes`` has two 64-bit hashes a line."""
        n = len(hashes)
        self.sums, self.back = [], []
        for column, base in zip(hashes.T, BASES):
            powers = self.powers(base, n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(column * powers, dtype=np.uint64)]))
            self.back.append(self.powers(pow(base, -1, 1 << 64), n))

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def of(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Two hashes of the lines first .. last; the number of lines counts."""
        out = []
        for sums, back in zip(self.sums, self.back):
            x = (sums[last + 1] - sums[first]) * back[first] + (last - first + 1).astype(np.uint64)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x ^ (x >> np.uint64(32))).view(np.int64))
        return out


def select(texts: list[bytes], min_words: int):
    """The positions of some texts: (text, fingerprint, extent's two hashes,
    start, stop, windows), windows being the list array of each extent's
    windows (start, stop and two hashes, lines counted from the extent's)."""
    from xxhash import xxh3_128_digest
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [x for text in lines for x in text]
    hashes = np.frombuffer(b"".join(map(xxh3_128_digest, flat)), "<u8").reshape(-1, 2)
    held = np.cumsum(np.concatenate([[0], np.fromiter((len(x.split()) for x in flat), np.int64, len(flat))]))
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = (ends - counts)[owner]
    first, last = _minimal(held, begin, ends[owner], min_words)
    chosen = least(hashes[:, 0], first, last)
    head = np.flatnonzero(np.diff(chosen, prepend=-1))  # where the selection moves
    tail = np.append(head[1:], len(chosen))[:len(head)] - 1
    runs = Runs(hashes)
    start, stop = first[head], last[tail] + 1
    from_start = np.repeat(start, tail - head + 1)
    fields = [pa.array((first - from_start).astype(np.int32)), pa.array((last + 1 - from_start).astype(np.int32)), *map(pa.array, runs.of(first, last))]
    parts = pa.ListArray.from_arrays(pa.array(np.append(head, len(chosen)).astype(np.int32)),
                                     pa.StructArray.from_arrays(fields, names=["start", "stop", "w1", "w2"]))
    return (owner[start], hashes[chosen[head], 0].view(np.int64), *runs.of(start, stop - 1),
            (start - begin[start]).astype(np.int32), (stop - begin[start]).astype(np.int32), parts)


POSITIONS = ("doc_id long, text_hash long, fingerprint long, x1 long, x2 long, start int, stop int, "
             "windows array<struct<start:int,stop:int,w1:long,w2:long>>")


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every position of every document."""
    thin = docs.select(quoted("doc_id").cast("long").alias("doc_id"), F.xxhash64(quoted("text")).alias("text_hash"),
                       quoted("text").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            owner, prints, x1, x2, start, stop, parts = select(batch.column(2).cast(pa.binary()).to_pylist(), min_words)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *map(pa.array, (prints, x1, x2, start, stop)), parts],
                names=["doc_id", "text_hash", "fingerprint", "x1", "x2", "start", "stop", "windows"])

    return mapped(thin, run, POSITIONS)


PLACE = ["doc_id", "text_hash", "start"]


def _later(rows: DataFrame, keys: list[str], first: DataFrame) -> DataFrame:
    """Rows of a key at other places than its earliest, ``first`` (keys, place)."""
    at = rows.join(first.filter("times > 1").select(*keys, "place"), keys)
    return at.filter(~F.struct(*PLACE).eqNullSafe(F.struct(*[F.col(f"place.{c}").alias(c) for c in PLACE])))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): per document the line ranges [start, stop)
    that repeat an earlier place."""
    extent, window = ["fingerprint", "x1", "x2"], ["w1", "w2"]
    place, times = F.min(F.struct(*PLACE)).alias("place"), F.count(F.lit(1)).alias("times")
    at = written(docs.sparkSession, positions(docs, min_words), "line-positions")  # read several times
    first = at.groupBy(*extent).agg(place, times, F.first("windows").alias("windows"))
    whole = _later(at.drop("windows"), extent, at.groupBy(*extent).agg(place, times)).select("doc_id", "text_hash", "start", "stop")
    # Different extents of one fingerprint: their windows, at the first place of each extent.
    several = first.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("extents")).filter("extents > 1").select("fingerprint")
    edges = first.join(several, "fingerprint", "left_semi").select("place", F.explode("windows").alias("w"))
    edges = edges.select("place.doc_id", "place.text_hash", (F.col("place.start") + F.col("w.start")).alias("start"),
                         (F.col("place.start") + F.col("w.stop")).alias("stop"), "w.w1", "w.w2")
    single = _later(edges, window, edges.groupBy(*window).agg(place, times)).select("doc_id", "text_hash", "start", "stop")
    return whole.union(single).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and the columns
    n_lines and n_removed. No row is dropped; a text that repeats earlier
    lines throughout becomes empty.

    Null texts stay null (0 lines), an empty text is one empty line. Rows that
    agree in doc_id and text are one place and get the same result. An
    ``n_chars`` column is left as it was; clashing names are replaced.
    """
    docs = without(docs, "n_lines", "n_removed")
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "runs")
    h, cut = spare(docs, "__text_hash"), spare(docs, "__runs")
    marked = docs.withColumn(h, F.xxhash64(quoted("text"))).join(
        runs.withColumnRenamed("runs", cut),
        quoted("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(h) == F.col("__hash")), "left").drop("__id", "__hash", h)
    lines = F.split(quoted("text"), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(F.col(cut), lambda r: (r["start"] <= i) & (i < r["stop"])))
    kept = F.when(F.col(cut).isNull(), lines).otherwise(kept)
    n = spare(docs, "__kept")
    out = marked.withColumn(n, kept).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(quoted("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_removed", F.when(quoted("text").isNull(), 0).otherwise(F.col("n_lines") - F.size(n)).cast("long"))
    texts = F.when(quoted("text").isNull(), None).when(F.col("n_removed") == 0, quoted("text")).otherwise(F.array_join(n, "\n"))
    order = [texts.alias("text") if c == "text" else quoted(c) for c in docs.columns]
    return out.select(*order, "n_lines", "n_removed")
