"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of
labelled text. A text is parsed against it greedily: each phrase is the
longest match that occurs in the sample. Few, long phrases mean that the
text resembles the sample: phrases times the logarithm of the sample's
length, over the text's length, estimates the cross-entropy, and the
language with the least wins. A phrase costs no less than the logarithm of
the alphabet's size, or a sample of a few letters would win by being short.

Texts are reduced to lower-case letters and single blanks. The automaton is a
table, dense for the commonest letters and sorted pairs of state and symbol
for the others; a missing transition ends the phrase and starts the next one.
So many texts are parsed in lockstep, one symbol a step. Long texts are cut
into stretches that are parsed side by side.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, quoted, without

#: Bounds of the fit: labelled rows and characters of sample text a language, and languages.
#: What the driver gathers is at most a thousand characters a row.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 40_000
MAX_LANGUAGES = 200
#: Symbols parsed one after the other; a text is parsed in stretches of so many.
STRETCH = 512
#: Symbols with a column of their own in the automaton's table.
DENSE = 200
UNKNOWN = "und"


def normalise(text: str) -> str:
    """Lower-case letters, everything else as single blanks."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


class Alphabet:
    """All letters of the samples as numbers, the commonest first; 0: any other
    letter, 1: a blank (whatever is no letter)."""

    def __init__(self, texts):
        seen = Counter(c for t in texts for c in normalise(t) if c != " ")
        self.letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.size = len(self.letters) + 2
        number = {c: k + 2 for k, c in enumerate(self.letters)}
        # One entry a code point; a letter is numbered by the first letter of its lower case.
        self.number = np.ones(0x110000, np.min_scalar_type(self.size))
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.number[code] = number.get(c.lower()[:1], 0)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of the normalised text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.number[codes]
        blank = out == 1
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        out = out[keep]
        lo, hi = int(len(out) > 0 and out[0] == 1), len(out)
        hi -= int(hi > lo and out[hi - 1] == 1)
        return out[lo:hi]


class Table(NamedTuple):
    """An automaton's transitions. An entry is twice the next state, plus one
    if the phrase ended before the symbol (no such transition: the next phrase
    starts with the symbol, at the root's transition or, for a symbol the
    sample lacks, alone)."""
    wide: int  # symbols with a column
    dense: np.ndarray  # [state * wide + symbol]
    root: np.ndarray  # entry of each symbol that ends a phrase
    keys: np.ndarray  # sorted state * size + symbol of the other symbols' transitions
    entries: np.ndarray

    def step(self, state: np.ndarray, symbols: np.ndarray, size: int) -> np.ndarray:
        common = symbols < self.wide
        if common.all():
            return self.dense[state * self.wide + symbols]
        out = self.root[symbols]
        out[common] = self.dense[state[common] * self.wide + symbols[common]]
        if len(self.keys):
            rare = np.flatnonzero(~common)
            key = state[rare].astype(np.int64) * size + symbols[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[rare[found]] = self.entries[at[found]]
        return out


def automaton(symbols: np.ndarray, size: int, dense: int = DENSE) -> Table:
    """Suffix automaton of a sample over ``size`` symbols."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new, p = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    root = np.ones(size, np.int32)
    for c, to in moves[0].items():
        root[c] = 2 * to + 1
    wide = min(size, dense)
    table = np.empty((len(moves), wide), np.int32)
    table[:] = root[:wide]
    rest = {}
    for state, out in enumerate(moves[1:], 1):  # leaving the root always starts a phrase
        for c, to in out.items():
            if c < wide:
                table[state, c] = 2 * to
            else:
                rest[state * size + c] = 2 * to
    keys = np.array(sorted(rest), np.int64)
    return Table(wide, table.reshape(-1), root, keys, np.array([rest[k] for k in keys.tolist()], np.int32))


def phrases(table: Table, size: int, stretches: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each row of ``stretches`` (sorted by falling length)."""
    state = np.zeros(len(stretches), np.int32)
    count = np.zeros(len(stretches), np.int32)
    live = np.searchsorted(-lengths, -np.arange(stretches.shape[1]), side="left")
    for k in range(stretches.shape[1]):
        n = live[k]
        if not n:
            break
        step = table.step(state[:n] >> 1, stretches[:n, k], size)
        count[:n] += step & 1
        state[:n] = step
    return count


class Classifier:
    def __init__(self, samples: dict[str, str]):
        # A language without a letter in its sample can't be parsed against.
        self.names = sorted(name for name in samples if normalise(samples[name]))
        self.alphabet = Alphabet(samples.values())
        self.tables, self.weights = [], []
        for name in self.names:
            symbols = self.alphabet.encode(samples[name])[:SAMPLE_CHARS]
            self.tables.append(automaton(symbols, self.alphabet.size))
            # A phrase costs a place in the sample, or a symbol where the sample is shorter than the alphabet.
            self.weights.append(np.log2(max(len(symbols), self.alphabet.size)))

    def costs(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy estimate of each text (row) in each language; a row of
        infinities for a text without letters."""
        out = np.full((len(texts), len(self.names)), np.inf)
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and held < 4_000_000:
                held += len(texts[stop] or "")
                stop += 1
            out[start:stop] = self._costs(texts[start:stop])
            start = stop
        return out

    def _costs(self, texts: list[str | None]) -> np.ndarray:
        coded = [self.alphabet.encode(t or "") for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        per = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), per)
        lengths = np.full(len(owner), STRETCH, np.int64)
        ends = np.cumsum(per)
        full = sizes > 0
        lengths[ends[full] - 1] = sizes[full] - (per[full] - 1) * STRETCH
        rows = np.zeros((len(owner), STRETCH), self.alphabet.number.dtype)
        at = 0
        for c, n in zip(coded, per.tolist()):
            for k in range(n):
                piece = c[k * STRETCH:(k + 1) * STRETCH]
                rows[at, :len(piece)] = piece
                at += 1
        order = np.argsort(-lengths, kind="stable")
        rows, lengths, owner = rows[order], lengths[order], owner[order]
        out = np.full((len(texts), len(self.names)), np.inf)
        for k, table in enumerate(self.tables):
            total = np.bincount(owner, phrases(table, self.alphabet.size, rows, lengths), len(texts))
            out[full, k] = total[full] * self.weights[k] / sizes[full]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score; the score is the winner's part of all weights
        2 ** -cost, so it lies between 0 and 1. Ties go to the first name."""
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        costs = self.costs(texts)
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        lettered &= np.isfinite(costs[:, 0])
        best = costs.argmin(axis=1)
        with np.errstate(invalid="ignore"):
            weights = np.exp2(costs.min(axis=1, keepdims=True) - costs)
        score = np.where(lettered, 1 / np.where(lettered, weights.sum(axis=1), 1), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score.tolist()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text of each language of ``labelled`` (text, lang) that has a
    text with letters.

    Copies count once: texts with letters are reduced to distinct ones, which
    are counted, and at most ``rows`` of each language are taken by the order
    of a hash of the text, so the sample does not depend on files, partitions
    or copies. Of these up to ``chars`` characters altogether go into the
    sample; of one text a fortieth of that at most, from its first letter on.
    """
    thin = labelled.select(quoted("text").cast("string").alias("text"), quoted("lang").cast("string").alias("lang"))
    thin = thin.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    thin = thin.withColumn("h", F.xxhash64("text", F.lit(7)))
    distinct = thin.select("lang", "h").distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    if not counts:
        return {}
    # About 4 * rows distinct texts of a language pass, so that the ranking's one task a language stays small.
    scale = 1 << 40
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, 4 * rows * scale // n))])
    lettered = F.regexp_replace("text", r"^\P{L}+", "")
    few = thin.filter(F.pmod("h", F.lit(scale)) < rate[F.col("lang")]).groupBy("lang", "h").agg(
        F.min(F.substring(lettered, 1, chars // 40)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    taken = few.withColumn("r", rank).filter(F.col("r") <= rows).select("lang", "r", "text").collect()
    samples: dict[str, list[str]] = {lang: [] for lang in counts}
    for lang, _, text in sorted(taken):
        if sum(map(len, samples[lang])) < chars:
            samples[lang].append(normalise(text))
    joined = {lang: " ".join(t)[:chars] for lang, t in samples.items()}
    return {lang: t for lang, t in joined.items() if t.strip()}


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` with lang_pred and score. Only ``text`` is read. A text that is
    null or has no letter is ``und`` with score 0, as is every text if there
    are no samples. Repeated rows get equal results; clashing names are
    replaced."""
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def compute():
        model = _classifier(tuple(sorted(samples.items())))

        def batch(texts: list) -> dict[str, list]:
            names, scores = model.predict([None if t is None else t.decode("utf-8", "replace") for t in texts])
            return {"lang_pred": names, "score": scores}
        return batch

    return add_columns(without(docs, "lang_pred", "score"), "text", fields, compute)


_FITTED: dict[tuple, Classifier] = {}


def _classifier(samples: tuple) -> Classifier:
    """One classifier a worker process."""
    if samples not in _FITTED:
        _FITTED.clear()
        _FITTED[samples] = Classifier(dict(samples))
    return _FITTED[samples]


def held_out():
    return F.pmod(F.crc32(quoted("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the
    labelled documents that are not held out. A null doc_id is not held out."""
    out = F.coalesce(held_out(), F.lit(False))
    samples = fit(docs.filter(~out))
    return predict(docs.select(quoted("doc_id").alias("doc_id"), out.alias("held_out"), quoted("text").alias("text")),
                   samples).select("doc_id", "held_out", "lang_pred", "score")
