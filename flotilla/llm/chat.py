"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. To learn
where each turn went, the template is called on successive prefixes of the
turns: if one output continues the output before it, the new turn's span is
what was added; if not, the template rewrites history, which is flagged.

What a template does with a turn may depend on all turns before it, so a
conversation is rendered as a whole, whatever its length: one task holds it
and its prefixes cost quadratic time. Only templates declared
:func:`concatenative` are rendered in blocks of ``BLOCK`` turn numbers, whose
outputs one after the other are the rendering of the whole; so a conversation
with very many turns is spread over tasks and costs no quadratic time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, quoted

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

BLOCK = 64
LOSS_ROLE = "assistant"

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_PLAIN = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    """Put a backslash into every control string, and one more where there
    are some already, so that none is left and :func:`unescape` can undo it."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def concatenative(template: Template) -> Template:
    """Declare that ``template(a + b) == template(a) + template(b)`` for all
    turns a and b."""
    template.concatenative = True
    return template


@concatenative
def instruct(turns: Turns) -> str:
    """The production template: every turn between control strings."""
    return "".join([f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns])


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of the turns in a string made by
    :func:`instruct`; start and stop delimit the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def render(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole rendering, the span of each turn in it, and whether the
    template rewrote history. Spans of a rewriting template begin where two
    consecutive outputs part; earlier spans are cut back to that point."""
    spans: list[tuple[int, int]] = []
    before, rewrites = template([]) if turns else "", False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        at = len(before)
        if not now.startswith(before):
            rewrites = True
            at = _common(before, now)
            spans = [(min(a, at), min(z, at)) for a, z in spans]
        spans.append((at, len(now)))
        before = now
    return before, spans, rewrites


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


FORMATTED = ("conv_id long, block long, part int, n_turns int, formatted string, "
             "spans array<struct<role:string,start:int,stop:int,loss:boolean>>, rewrites boolean")
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("loss", pa.bool_())]))),
    ("rewrites", pa.bool_())])


def format_conversations(rows: DataFrame, template: Template = instruct, loss_role: str = LOSS_ROLE,
                         block: int = BLOCK) -> DataFrame:
    """Rendered conversations (columns of FORMATTED): a row for each block if
    the template is declared :func:`concatenative`, else a row for each
    conversation (block and part 0).

    ``rows`` has conv_id, turn, role and text; turns are ordered by turn
    (null first), then role and text, and repeated rows are turns of their
    own. Null roles and texts are empty. Rows with a null conv_id form one
    conversation. A block whose turn numbers repeat is cut into parts of
    ``block`` turns. Spans count from the start of their row's output. An empty table gives no rows; other columns are not read.
    """
    thin = rows.select(
        quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").cast("long").alias("turn"),
        F.coalesce(quoted("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text"))
    whole = not getattr(template, "concatenative", False)
    number = F.lit(0) if whole else F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    thin = thin.withColumn("block", number.cast("long"))
    dealt = (thin.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
             .select("conv_id", "block", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, turns, out = None, 0, [], []

        def done() -> dict:
            text, spans, rewrites = render(turns, template)
            return {"conv_id": now[0], "block": now[1], "part": part, "n_turns": len(turns), "formatted": text, "rewrites": rewrites,
                    "spans": [{"role": r, "start": a, "stop": z, "loss": r == loss_role} for (r, _), (a, z) in zip(turns, spans)]}

        for batch in batches:
            for conv, number, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if turns and ((conv, number) != now or not whole and len(turns) >= block):
                    out.append(done())
                    part, turns = (part + 1 if (conv, number) == now else 0), []
                now = (conv, number)
                turns.append((role, text))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out = []
        if turns:
            out.append(done())
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return mapped(dealt, run, FORMATTED)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "rewrites boolean")


def read_back(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation, read from the production template's output: its
    turns' digest and that of all text under the loss mask. Blocks stream
    through in order, so a long conversation is never held as a whole."""
    dealt = (formatted.select("conv_id", "block", "part", "formatted", "spans", "rewrites").repartition("conv_id")
             .sortWithinPartitions("conv_id", "block", "part"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], None, None

        def row() -> dict:
            n, turns, loss_chars, loss, chars, rewrites = state
            return {"conv_id": now[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "rewrites": rewrites}

        for batch in batches:
            for conv, _, _, text, spans, rewrites in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (conv,):
                    if now is not None:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, said, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    if span["loss"]:  # the mask: text of the turn inside the span, without its marks
                        for _, said, _, _ in parse(text[span["start"]:span["stop"]]):
                            state[2] += len(said)
                            state[3].update(said.encode())
                state[4] += len(text)
                state[5] = state[5] or rewrites
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if now is not None:
            out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return mapped(dealt, run, DIGEST)


def with_control_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` plus conversation -7, whose texts hold the control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return rows.select(*[quoted(c).alias(c) for c in ("conv_id", "turn", "role", "text")]).unionByName(extra)
