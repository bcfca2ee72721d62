"""Quality rules, line first.

Every line is judged on its own: lines without terminal punctuation that look
like navigation (separators, counters, link lists), symbol noise, lines that
are one word over and over, and known boilerplate are removed. A document is
then rejected if too much of its text was in removed lines, or if it fails
the base rules on its whole text (under ten words, or over a fifth of the
words inside 5-word windows that the text repeats).
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, quoted, spare

MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
WINDOW = 5
#: A document is rejected if over this part of its words stood in removed lines.
MAX_LOST = 0.5

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Phrases of web pages' own furniture, as lower-case text.
BOILERPLATE = (
    b"lorem ipsum", b"javascript", b"cookie policy", b"privacy policy", b"terms of service", b"terms of use",
    b"all rights reserved", b"subscribe to our newsletter", b"click here", b"sign in", b"log in", b"skip to content",
    b"add to cart", b"page not found",
)
NAVIGATION = re.compile(rb"\s*(home|menu|next|previous|back|share|search)\b", re.I)
ARROW = "»".encode()
TERMINAL = (b".", b"!", b"?", b":", b";", b"\"", b"'", b")", b"\xe2\x80\x9d", b"\xe2\x80\xa6")


def line_fails(line: bytes) -> str:
    """The rule a line breaks, or ''. Lines without a word break none."""
    words = line.split()
    if not words:
        return ""
    n = len(words)
    symbols = len(SYMBOLS.findall(line))
    lower = line.lower()
    if n < 25 and any(p in lower for p in BOILERPLATE):
        return "boilerplate"
    if symbols >= max(3, n * 0.5):
        return "symbols"
    ended = line.rstrip().endswith(TERMINAL)
    if b"|" in line and line.count(b"|") * 3 >= n or not ended and n < 10 and (b"|" in line or ARROW in line):
        return "navigation"
    if not ended and n < 5 and NAVIGATION.match(line):
        return "navigation"
    if n >= 5 and not any(c.isalpha() for c in line.decode("utf-8", "replace")):
        return "no letters"
    if n >= 8 and Counter(words).most_common(1)[0][1] * 2 > n:
        return "repeated word"
    if n >= 8 and sum(w.isupper() and len(w) > 1 for w in words) * 2 > n or n >= 4 and line.count(b"!") * 2 > n:
        return "shouting"
    if n >= 40 and not any(c in line for c in b".!?;:"):
        return "no punctuation"
    return ""


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    grams = list(zip(*[words[k:] for k in range(size)]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


FIELDS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("lost", T.DoubleType()),
       T.StructField("clean_text", T.StringType()), T.StructField("kept", T.BooleanType())])


def judge(text: bytes | None) -> tuple:
    """Values of FIELDS for one text."""
    data = text or b""
    words = data.split()
    n = len(words)
    lines = data.split(b"\n")
    spoken = [x for x in lines if x.split()]
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    good, lost = [], 0
    for line in lines:
        if line_fails(line):
            lost += len(line.split())
        else:
            good.append(line)
    share = lost / n if n else 0.0
    chars = sum(map(len, words)) - sum(len(w) - len(w.decode("utf-8", "replace")) for w in words if not w.isascii())
    clean = None if text is None else b"\n".join(good).decode("utf-8", "replace")
    return (n, chars, len(SYMBOLS.findall(data)), len(spoken) - len(set(spoken)), repeated, failed, share, clean,
            not failed and share <= MAX_LOST)


def judge_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of FIELDS: counts over the whole text, the
    part of the words in removed lines (lost), the text without them
    (clean_text) and the verdict (kept).

    A null text has no words, fails the base rules and has a null clean_text.
    Repeated rows get equal results; clashing column names are replaced.
    """
    def compute():
        def batch(texts: list) -> dict[str, list]:
            rows = [judge(t) for t in texts]
            return {name: [r[i] for r in rows] for i, name in enumerate(FIELDS.names)}
        return batch
    return add_columns(docs, "text", FIELDS, compute)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns as they are, without rejected documents; failed
    lines are cut out of ``text``."""
    names = {c: spare(docs, f"__kept_{i}") for i, c in enumerate(docs.columns)}
    text = next(c for c in docs.columns if c.lower() == "text")
    held = docs.select(*[quoted(c).alias(n) for c, n in names.items() if c != text], quoted(text).alias("text"))
    good = judge_documents(held).filter("kept")
    return good.select(*[quoted("clean_text" if c == text else n).alias(c) for c, n in names.items()])
