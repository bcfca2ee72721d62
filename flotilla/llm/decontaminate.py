"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ten consecutive benchmark words (an item of
fewer words is one window). For each window length, a shift table over blocks
of two words tells how far the search may skip from the block it looks at; a
block that ends some window is looked up in the bucket of that suffix, whose
entries are told apart by their first word and confirmed word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, alnum_words, mapped, quoted, slices, spare, without

WINDOW = 10
#: Windows that one scan of the documents searches for; a larger benchmark is
#: searched in as many scans as it takes. Bounds what a task holds.
BLOCK = 200_000


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_id) for all windows of all items. Null texts have none; a
    null item_id counts as the empty string."""
    thin = items.select(F.coalesce(quoted("item_id").cast("string"), F.lit("")).alias("item_id"),
                        quoted("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                tail: list[bytes] = []
                whole = False
                for words in alnum_words(text or b""):
                    tail += words
                    found = {b" ".join(tail[k:k + window]) for k in range(len(tail) - window + 1)}
                    if found:
                        whole, tail = True, tail[len(tail) - window + 1:]
                        yield rows(item, found)
                if tail and not whole:
                    yield rows(item, {b" ".join(tail)})

    def rows(item: str, found: set[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found]), pa.array([item] * len(found))],
                                          names=["window", "item_id"])

    return mapped(thin, run, "window string, item_id string").distinct()


class Table(NamedTuple):
    """Search table for the windows of one length."""

    length: int
    shift: dict[tuple[bytes, bytes], int]
    buckets: dict[tuple[bytes, bytes], dict[bytes, dict[tuple[bytes, ...], set[str]]]]


def build(patterns: Iterable[tuple[str, str]]) -> list[Table]:
    """Tables for (window, item_id) pairs, by window length."""
    tables: dict[int, Table] = {}
    for text, item in patterns:
        words = tuple(text.encode().split(b" "))
        n = len(words)
        table = tables.setdefault(n, Table(n, {}, {}))
        blocks = [(words[0], words[0])] if n == 1 else list(zip(words, words[1:]))
        for k, block in enumerate(blocks):
            table.shift[block] = min(table.shift.get(block, n), len(blocks) - 1 - k)
        bucket = table.buckets.setdefault(blocks[-1], {})
        bucket.setdefault(words[0], {}).setdefault(words, set()).add(item)
    return [tables[n] for n in sorted(tables)]


def search(words: list[bytes], tables: list[Table]) -> Iterator[tuple[int, int, set[str]]]:
    """(start, stop, item_ids) of every occurrence of a window in ``words``."""
    total = len(words)
    for length, shift, buckets in tables:
        if length == 1:
            for i, w in enumerate(words):
                if (w, w) in buckets:
                    yield i, i + 1, buckets[w, w][w][(w,)]
            continue
        jump, at = shift.get, length - 1
        while at < total:
            block = (words[at - 1], words[at])
            skip = jump(block, length - 1)
            if skip:
                at += skip
                continue
            start = at - length + 1
            entries = buckets[block].get(words[start])
            if entries:
                items = entries.get(tuple(words[start:at + 1]))
                if items:
                    yield start, at + 1, items
            at += 1


def scan_text(text: bytes | None, tables: list[Table]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Word count, merged hit ranges [start, stop) and items of one text. The
    text is read piece by piece with the longest window's words carried over."""
    over = max((t.length for t in tables), default=1) - 1
    n, items, spans, carry = 0, set(), [], []
    for words in alnum_words(text or b""):
        base, n = n - len(carry), n + len(words)
        words = carry + words
        for start, stop, found in search(words, tables):
            items |= found
            spans.append((base + start, base + stop))
        carry = words[len(words) - over:] if 0 < over < len(words) else words if over else []
    return n, merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def mark(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with n_words, hits (merged word ranges), n_hit, items (sorted
    item_ids with an occurring window) and contaminated.

    Null and empty texts have no words; with an empty benchmark nothing is
    hit. Repeated rows and ties get equal results. Clashing column names are
    replaced. The benchmark comes to the driver in blocks of ``block`` windows
    at most (about; blocks are dealt by hash), and each block is one pass.
    """
    pairs = item_windows(items, window).cache()
    names = ("n_words", "hits", "n_hit", "items", "contaminated")
    docs = without(docs, *names)
    n_blocks = max(1, -(-pairs.count() // block))
    parts = []
    for b in range(n_blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine])
        w, s, i = (spare(docs, f"__{x}{b}") for x in ("words", "spans", "items"))
        fields = T.StructType([T.StructField(w, T.LongType()), T.StructField(s, SPANS),
                               T.StructField(i, T.ArrayType(T.StringType()))])

        def compute(shared=shared, names=(w, s, i)):
            tables = build(shared.value)

            def batch(texts: list) -> dict[str, list]:
                found = [scan_text(t, tables) for t in texts]
                return {names[0]: [n for n, _, _ in found],
                        names[1]: [[{"start": a, "stop": z} for a, z in spans] for _, spans, _ in found],
                        names[2]: [sorted(items) for _, _, items in found]}
            return batch

        docs = add_columns(docs, "text", fields, compute)
        parts.append((w, s, i))
    pairs.unpersist()
    words, spans, found = zip(*parts)
    if n_blocks == 1:
        hits, every = F.col(spans[0]), F.col(found[0])
    else:
        hits = _merged(F.array_sort(F.flatten(F.array(*[F.col(c) for c in spans]))))
        every = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c) for c in found]))))
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    rest = [quoted(c) for c in docs.columns if c not in {x for p in parts for x in p}]
    return docs.select(*rest, F.col(words[0]).alias("n_words"), hits.alias("hits"), n_hit.alias("n_hit"),
                       every.alias("items"), (F.size(hits) > 0).alias("contaminated"))


def _merged(spans):
    """Union of sorted ranges: each range loses what an earlier one covers."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    start = F.struct(empty.alias("out"), F.lit(-1).cast("long").alias("end"))

    def step(acc, x):
        rest = F.struct(F.greatest(x["start"], acc["end"]).alias("start"), x["stop"].alias("stop"))
        grown = F.when(x["stop"] > acc["end"], F.concat(acc["out"], F.array(rest))).otherwise(acc["out"])
        return F.struct(grown.alias("out"), F.greatest(acc["end"], x["stop"]).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns as they are, without the documents that hold a
    window of a benchmark item."""
    names = {c: spare(docs, f"__kept_{i}") for i, c in enumerate(docs.columns)}
    text = next(c for c in docs.columns if c.lower() == "text")
    held = docs.select(*[quoted(c).alias(n) for c, n in names.items() if c != text], quoted(text).alias("text"))
    clean = mark(spark, held, items, window).filter("not contaminated")
    return clean.select(*[quoted("text" if c == text else n).alias(c) for c, n in names.items()])
