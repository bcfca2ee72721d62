"""Token counts by batch encoding, lengths only.

Texts reach the tokenizer in batches of about equal bytes. Where the
tokenizer is known to cut its input before a blank that follows a non-blank
character, texts are split there: a long text is taken in spans, a span in
pieces (a word with the blank before it), and each piece that the worker has not
met yet is encoded once, in a batch with others. No token crosses such a
boundary, so the sum of the pieces' lengths is the length of the whole text.
Ids never leave the tokenizer's own objects.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, quoted, spare, without

#: Bytes of text that a batch holds (a text that alone is longer is a batch of its own).
BATCH_BYTES = 2 << 20
#: Characters of a long text that are split into pieces at a time.
SPAN = 1 << 18
#: Bytes given to one call of the tokenizer, whose results are larger objects.
CALL_BYTES = 1 << 18
#: Bytes, about, of the pieces whose lengths a worker remembers.
REMEMBERED = 128 << 20
LIMIT = 512

BOUNDARY = re.compile(r"(?<=[\x21-\x7E]) ")
#: White space before a blank: no boundary between the two.
JOINED = re.compile(r"\s ")


def splits_at_blanks(tokenizer_json: str) -> bool:
    """Whether a token can never hold a non-blank character and a blank after
    it: byte-level splitting by pattern, no normalizer, no added token that
    holds or swallows white space."""
    config = json.loads(tokenizer_json)
    splitter = config.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    added = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) and not t["single_word"]
                for t in config.get("added_tokens") or [])
    return bool(plain and added and not config.get("normalizer") and not config.get("post_processor"))


def byte_batches(rows: Iterable[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive (index, bytes) rows that hold about
    ``limit`` bytes; a row that alone holds more is by itself."""
    start, stop, held = 0, 0, 0
    for i, size in rows:
        if stop > start and held + size > limit:
            yield start, stop
            start, held = i, 0
        stop, held = i + 1, held + size
    if stop > start:
        yield start, stop


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """``text`` cut before blanks into spans of about ``size`` characters, all
    but the first beginning with a blank."""
    start = 0
    while len(text) - start > size and (m := BOUNDARY.search(text, start + size)):
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def pieces(span: str) -> list[str]:
    """Words of a span, each to be read with the blank before it but for the
    first, which is as it stands. Words that no boundary parts stay joined."""
    words = span.split(" ")
    if not JOINED.search(span) and words[0]:
        return words
    out: list[str] = []
    for word in words:
        if out and (not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + word
        else:
            out.append(word)
    return out


class Counter:
    """Lengths of texts in tokens."""

    def __init__(self, tokenizer_file: str, call_bytes: int = CALL_BYTES, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = splits_at_blanks(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False) if self.split else {}
        #: By id: does the token begin with a blank (byte-level letter U+0120)?
        self.blank = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.call_bytes, self.remembered = call_bytes, remembered
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.held = 0

    def encode(self, texts: list[str]) -> list[int]:
        """Lengths by the library, in calls of about equal bytes."""
        out: list[int] = []
        sizes = enumerate(len(t.encode("utf-8")) for t in texts)
        for start, stop in byte_batches(sizes, self.call_bytes):
            out += [len(e) for e in self.tokenizer.encode_batch(texts[start:stop], add_special_tokens=False)]
        return out

    def encode_words(self, words: list[str]) -> list[int]:
        """Lengths of words, each with a blank before it. Words without
        blanks of their own are encoded as one text a call: its tokens that
        begin with a blank are where the words start."""
        out = dict.fromkeys(words, 0)
        plain = [w for w in words if w and " " not in w and not w[-1].isspace()]
        for start, stop in byte_batches(enumerate(map(len, plain)), self.call_bytes // 4):
            part = plain[start:stop]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids)
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) != len(part):  # not seen with byte-level vocabularies
                out.update(zip(part, self.encode([" " + w for w in part])))
            else:
                out.update(zip(part, np.diff(starts, append=len(ids)).tolist()))
        other = [w for w in words if not out[w]]
        out.update(zip(other, self.encode([" " + w for w in other])))
        return list(out.values())

    def count(self, texts: list[str]) -> list[int]:
        """Length of every text."""
        if not self.split:
            return self.encode(texts)
        parts = [(i, s) for i, t in enumerate(texts) for s in spans(t)]
        out = [0] * len(texts)
        for start, stop in byte_batches(enumerate(len(s) for _, s in parts), BATCH_BYTES):
            for (i, _), n in zip(parts[start:stop], self._lengths([s for _, s in parts[start:stop]])):
                out[i] += n
        return out

    def _lengths(self, texts: list[str]) -> list[int]:
        words = [pieces(t) for t in texts]
        heads = [w.pop(0) for w in words]
        first, rest = self._learn("", set(heads)), self._learn(" ", set().union(*words))
        out = [first[h] + sum(map(rest.__getitem__, w)) for h, w in zip(heads, words)]
        if self.held > self.remembered:
            self.known, self.held = {"": {}, " ": {}}, 0
        return out

    def _learn(self, lead: str, found: set[str]) -> dict[str, int]:
        """Lengths of words that stand after ``lead``, those of ``found``
        among them; unseen ones are encoded in one batch."""
        known = self.known[lead]
        new = [w for w in found if w not in known]
        known.update(zip(new, self.encode_words(new) if lead else self.encode(new)))
        self.held += sum(map(len, new)) + 100 * len(new)
        return known


@lru_cache(maxsize=2)
def counter(tokenizer_file: str) -> Counter:
    """One a Python worker, which serves many tasks."""
    return Counter(tokenizer_file)


FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("over_limit", T.BooleanType())])


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, column: str = "text",
                 keep: list[str] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with n_bytes (UTF-8),
    n_tokens and over_limit (n_tokens > ``limit``) of the whole text.

    Lengths are the library's own without begin, end or other added special
    tokens; strings of special tokens inside a text count as the library reads
    them by default. Null and empty texts have 0 bytes and 0 tokens. A very long
    text is held whole as text, but split a span at a time; one without a blank
    is encoded in one piece, as is any text where the tokenizer's boundaries are
    not known (:func:`splits_at_blanks`). Rows are told by position: ties and
    repeated rows each get their own result. An empty table gives no rows.
    Columns whose names clash with the new ones are replaced.
    """
    names = docs.columns if keep is None else keep
    rest = without(docs.select(*[quoted(c) for c in names]), *FIELDS.names)
    src = spare(docs, "__src")
    thin = docs.select(*[quoted(c) for c in rest.columns], quoted(column).cast("string").alias(src))
    out = T.StructType([docs.schema[c] for c in rest.columns] + FIELDS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_file).count
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1).cast(pa.binary())), 0)
            for start, stop in byte_batches(enumerate(sizes.to_pylist()), batch_bytes):
                part = batch.slice(start, stop - start)
                raw = part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()
                n = count([(t or b"").decode("utf-8", "replace") for t in raw])
                new = [sizes.slice(start, stop - start).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=out.names)

    return mapped(thin, run, out)
