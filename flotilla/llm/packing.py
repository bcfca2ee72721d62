"""Token ids packed into fixed-length sequences, as binary columns.

Documents are dealt by a hash into groups of about ``docs_per_group``. A
group is packed best fit decreasing: pieces are placed longest first, each
into the open sequence with the least room that still holds it. A segment
tree over the amounts of room finds that sequence in logarithmic time. A
document longer than a sequence is split losslessly: full pieces, then its
rest.

A packed row is a row of the id matrix (little-endian, padded to the sequence
length) with cumulative segment lengths and position ids that restart with
every segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, quoted, slices
from .spm import SPACE, Encoder, _encoder, _pieces
from .token_counts import byte_batches

SEQ_LEN = 2048
DOCS_PER_GROUP = 2048
#: Tokens a task holds before it packs what it has: bounds memory for a group of very long documents.
HELD = 6_000_000
#: Bytes of text that are encoded together, and words whose ids a worker remembers.
BATCH_BYTES, WORDS = 8 << 20, 800_000
PAD = 0

PACKED = ("grp long, part int, seq int, n_tokens int, doc_ids array<bigint>, doc_offsets array<bigint>, "
          "cu_seqlens array<int>, ids binary, position_ids binary")


class RoomTree:
    """Open sequences by free room; finds the least room of at least n."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, seq: int) -> None:
        self.open.setdefault(room, []).append(seq)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the best fit, or None."""
        count, node = self.count, self.base + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # up until a right neighbour has sequences
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        seq = self.open[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, seq


def pack(lengths: list[int], seq_len: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, offset, length) for items of the given lengths.
    Items of length 0 are in none. Ties are broken by item and offset."""
    parts = [(min(seq_len, n - at), item, at) for item, n in enumerate(lengths) for at in range(0, n, seq_len)]
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, out = RoomTree(seq_len), []
    for n, item, at in parts:
        found = tree.take(n)
        if found is None:
            found = (seq_len, len(out))
            out.append([])
        room, seq = found
        out[seq].append((item, at, n))
        if room > n:
            tree.put(room - n, seq)
    return out


def rows_of(group: int, part: int, doc_ids: list, ids: list[np.ndarray], seq_len: int, width: str) -> Iterator[dict]:
    for seq, segments in enumerate(pack([len(x) for x in ids], seq_len)):
        sizes = [n for _, _, n in segments]
        row, place = np.full(seq_len, PAD, width), np.zeros(seq_len, "<u4" if seq_len > 65_536 else "<u2")
        ends = np.cumsum([0] + sizes)
        for (item, at, n), start in zip(segments, ends):
            row[start:start + n] = ids[item][at:at + n]
            place[start:start + n] = np.arange(n)
        yield {"grp": group, "part": part, "seq": seq, "n_tokens": int(ends[-1]),
               "doc_ids": [doc_ids[i] for i, _, _ in segments], "doc_offsets": [at for _, at, _ in segments],
               "cu_seqlens": ends.tolist(), "ids": row.tobytes(), "position_ids": place.tobytes()}


def id_width(model_file: str) -> str:
    return "<u2" if len(_pieces(model_file)[0]) <= 65_536 else "<u4"


class BatchEncoder:
    """Ids of texts, a batch at a time. A batch is cut into words by Arrow;
    its distinct words are looked up, or encoded by one call of the library,
    once; the texts' ids are then gathered by number. Texts with other blanks
    than single ones between words are left to the encoder."""

    def __init__(self, encoder: Encoder, remembered: int = WORDS):
        self.encoder, self.remembered, model = encoder, remembered, encoder.model
        self.plain = encoder.splits and model.prefix
        self.by_line, self.library = bool(model.alone), model.library
        self.lead = len(self.library.encode("\n")) if self.plain else 0
        self.forget()

    def forget(self) -> None:
        """Words by number: where their ids begin, how many they are."""
        self.number: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<i4")

    def is_plain(self, text: str) -> bool:
        return (self.plain and bool(text) and "  " not in text and SPACE not in text and text[0] not in " \n" and text[-1] != " "
                and " \n" not in text and (self.by_line or "\n" not in text))

    def learn(self, words: list[str]) -> None:
        """Words stand after a blank, those that begin with a line end after
        that: they get its ids and those of a word without a blank before it."""
        found = self.library.encode(words, num_threads=1)
        line = np.frombuffer(self.encoder.line_break, "<i4").tolist()
        found = [line + ids[self.lead:] if w[0] == "\n" else ids for w, ids in zip(words, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<i4", int(sizes.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.number) > self.remembered:
            self.forget()
        out = [None if self.is_plain(t) else np.frombuffer(self.encoder.encode(t), "<i4") for t in texts]
        plain = [t for t, ids in zip(texts, out) if ids is None]
        if not plain:
            return out
        cut = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.large_string()), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn([w for w in words if w not in self.number])
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[number]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[number] - end + size, size) + np.arange(end[-1])]
        at = np.concatenate([[0], end])[cut.offsets.to_numpy()]
        found = (ids[a:z] for a, z in zip(at, at[1:]))
        return [next(found) if x is None else x for x in out]


@lru_cache(maxsize=4)
def _batches(model_file: str) -> BatchEncoder:
    """One a Python worker, which serves many tasks."""
    return BatchEncoder(_encoder(model_file, True))


def tokenised(rows: DataFrame, model_file: str) -> DataFrame:
    """(grp, doc_id, h, ids) of (grp, doc_id, h, text): ids as a binary column
    of 2 or 4 bytes an id, found where the documents are read, so that neither
    texts nor the work on them are shuffled."""
    width = id_width(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _batches(model_file)
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_pylist()
            for start, stop in byte_batches(enumerate(sizes), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                ids = [i.astype(width).tobytes() for i in encoder.encode(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary())], names=["grp", "doc_id", "h", "ids"])

    return mapped(rows, run, "grp long, doc_id long, h long, ids binary")


def pack_documents(docs: DataFrame, model_file: str, seq_len: int = SEQ_LEN, docs_per_group: int = DOCS_PER_GROUP,
                   held: int = HELD) -> DataFrame:
    """One row a packed sequence (columns of PACKED).

    Every token of every document is in exactly one place; ``doc_ids`` and
    ``doc_offsets`` say from which document, and from which of its tokens on,
    each segment comes. Null and empty texts have no tokens and are in no
    sequence; an empty table gives no rows. Repeated rows are packed each. The
    result depends on the rows alone, not on files or partitions. ``part``
    counts the packings of a group that holds over ``held`` tokens.
    """
    if not 0 < seq_len < 1 << 31:
        raise ValueError("seq_len must be positive")
    groups = max(1, -(-docs.count() // docs_per_group))
    thin = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    thin = thin.filter("text <> ''").withColumn("h", F.xxhash64("doc_id", "text"))
    thin = thin.select(F.pmod(F.col("h"), F.lit(groups)).cast("long").alias("grp"), "doc_id", "h", "text")
    dealt = tokenised(thin, model_file).repartition("grp").sortWithinPartitions("grp", "doc_id", "h").select("grp", "doc_id", "ids")
    width = id_width(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, count, doc_ids, ids = None, 0, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in rows_of(now, part, doc_ids, ids, seq_len, width):
                rows.append(row)
                if len(rows) * seq_len >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

        for batch in slices(batches):
            for group, doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ids and (group != now or count > held):
                    yield from flush()
                    part, count, doc_ids, ids = (part + 1 if group == now else 0), 0, [], []
                elif group != now:
                    part = 0
                now = group
                got = np.frombuffer(found, width)
                doc_ids.append(doc)
                ids.append(got)
                count += len(got)
        if ids:
            yield from flush()

    return mapped(dealt, run, PACKED)


SCHEMA = pa.schema([
    ("grp", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("position_ids", pa.binary()),
])


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the binary columns are rows of the id and
    position matrices as they are used, to be read without conversion."""
    packed.write.parquet(path)
