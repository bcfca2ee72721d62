"""License scan by an exact set-similarity join.

A text block is a window of ``BLOCK`` words, one every ``STEP`` words, so any
run of STEP words lies whole in some block. Templates of more words have
blocks of their own: twice their words, one every so many words, so that a
notice as long as its template lies whole in some block. Blocks and license templates are
sets of tokens. A block matches a template if it contains at least the
template's threshold of its tokens. All such pairs are found:

* tokens are ordered by how many documents of the whole corpus hold them,
  rarest first;
* prefix filter: a block that reaches the needed overlap ``need`` holds one
  of the template's first ``size - need + 1`` tokens;
* length filter: it has at least ``need`` tokens;
* positional filter: from a shared token at place ``p`` of the ordered
  template, at most ``size - p`` tokens can be shared;
* what is left is verified by counting.

Templates are a bounded parameter. Besides, three fixed phrases are looked up
word by word (the base labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, add_columns, alnum_words, mapped, quoted, slices

BLOCK = 64
STEP = 32
MAX_TEMPLATES = 1000

#: Phrases of the base labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Opening sentences of public license notices, each with its
#: label and the part of its distinct words that a block must contain.
TEMPLATES = (
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", 0.8, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                      "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", 0.8, "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                 "that the following conditions are met"),
    ("mpl-2", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                   "MPL was not distributed with this file"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                 "hereby granted, provided that the above copyright notice"),
    ("unlicense", 0.8, "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                       "modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", 0.8, "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
                 "and related or neighboring rights to this work"),
    ("cc-by-nc", 1.0, "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", 1.0, "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
)


class Template(NamedTuple):
    label: str
    tokens: tuple[bytes, ...]  # rarest first
    need: int
    block: int = BLOCK  # words of the blocks it is compared with


class Index(NamedTuple):
    templates: list[Template]
    sets: list[frozenset]
    postings: dict[int, dict[bytes, list[tuple[int, int]]]]  # words of a block -> prefix token -> (template, place)


def token_set(text: str) -> set[bytes]:
    return set(ALNUM.findall(text.encode().lower()))


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each token of the (bounded) vocabulary, over the
    whole corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held = set()
                for words in alnum_words(text or b""):
                    held |= vocabulary.intersection(words)
                counts.update(held)
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    found = mapped(docs.select(quoted("text").cast("string").alias("text")), run, "token string, n long")
    return {r.token.encode(): r.n for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def build_index(templates, counts: dict[bytes, int]) -> Index:
    out, postings = [], {}
    for label, threshold, text in templates:
        tokens = tuple(sorted(token_set(text), key=lambda t: (counts.get(t, 0), t)))
        need = max(1, ceil(threshold * len(tokens) - 1e-9))
        words = len(ALNUM.findall(text.encode().lower()))
        out.append(Template(label, tokens, need, BLOCK if words <= BLOCK - STEP + 1 else 2 * words))
        for place, token in enumerate(tokens[:len(tokens) - need + 1]):
            postings.setdefault(out[-1].block, {}).setdefault(token, []).append((len(out) - 1, place))
    return Index(out, [frozenset(t.tokens) for t in out], postings)


def matches(block: set[bytes], index: Index, size: int = BLOCK) -> Iterator[tuple[int, float]]:
    """(template, containment) of all templates with blocks of ``size`` words that the block contains."""
    seen, postings = set(), index.postings.get(size, {})
    for token in postings.keys() & block:
        for t, place in postings[token]:
            template = index.templates[t]
            if t in seen or len(block) < template.need or len(template.tokens) - place < template.need:
                continue
            seen.add(t)
            shared = len(index.sets[t] & block)
            if shared >= template.need:
                yield t, shared / len(template.tokens)


def step_of(size: int) -> int:
    return STEP if size == BLOCK else size // 2


def scan_text(text: bytes | None, index: Index, phrases) -> dict:
    n, bases, found = 0, [], {}
    held_back = {size: (0, []) for size in index.postings}  # first word and words not yet in a full block
    widest = max((len(words) for _, words in phrases), default=1) - 1
    tail: list[bytes] = []

    def block(size: int, at: int, words: list[bytes]) -> None:
        if index.postings[size].keys().isdisjoint(words):
            return
        for t, part in matches(set(words), index, size):
            label = index.templates[t].label
            found[label, at, at + len(words)] = max(part, found.get((label, at, at + len(words)), 0.0))

    for words in alnum_words(text or b""):
        held = tail + words
        here = set(held)
        for label, phrase in phrases:
            if phrase[-1] in here:
                for k, w in enumerate(held):
                    if w == phrase[0] and held[k:k + len(phrase)] == phrase and k + len(phrase) > len(tail):
                        bases.append((n - len(tail) + k, label))
        tail = held[len(held) - widest:] if 0 < widest < len(held) else held if widest else []
        n += len(words)
        for size, (start, carry) in held_back.items():
            step = step_of(size)
            rare = index.postings[size].keys()
            carry = carry + words
            if len(carry) > size and rare.isdisjoint(here) and rare.isdisjoint(carry):
                skip = (len(carry) - size + step) // step * step  # blocks without a prefix token
                start, carry = start + skip, carry[skip:]
            at = 0
            while len(carry) - at >= size:
                block(size, start + at, carry[at:at + size])
                at += step
            held_back[size] = start + at, carry[at:]
    for size, (start, carry) in held_back.items():
        step = step_of(size)
        if carry and (len(carry) > size - step or start == 0):
            block(size, start, carry)
    labels = {label for _, label in bases}
    return {"n_words": n, "n_base": len(bases), "first_word": min(bases)[0] if bases else None,
            "last_word": max(bases)[0] if bases else None, "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {k[0] for k in found})),
            "score": 1.0 if bases else max(found.values(), default=0.0),
            "blocks": [{"label": k[0], "start": k[1], "stop": k[2], "containment": v} for k, v in sorted(found.items())]}


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
        T.StructField("containment", T.DoubleType())])))])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``docs`` with the columns of FIELDS: ``blocks`` lists every block that
    contains a template, with its word range and containment; ``score`` is
    the largest containment found (1 for a phrase, 0 for nothing).

    Null and empty texts have no words and no labels. Repeated rows get equal
    results; clashing column names are replaced. At most MAX_TEMPLATES.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError("too many templates for one scan")
    vocabulary = set().union(*[token_set(t[2]) for t in templates]) if templates else set()
    index = build_index(templates, token_counts(docs, vocabulary))
    spoken = [(label, ALNUM.findall(p.encode().lower())) for label, p in phrases]

    def compute():
        def batch(texts: list) -> dict[str, list]:
            rows = [scan_text(t, index, spoken) for t in texts]
            return {name: [r[name] for r in rows] for name in FIELDS.names}
        return batch

    return add_columns(docs, "text", FIELDS, compute)
