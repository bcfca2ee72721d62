"""Log operators: rendering without a fraction, glued prompts, record
assembly against a line-by-line brute force, parse(format(x)) = x."""

import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import SF_SMALL, rows
from flotilla.constants import LOG_HEADER_PATTERN
from flotilla.operators import logs as E
from flotilla.schemas import LOG_LINES, LOG_RECORDS
from flotilla.sources import fixtures as fx


def _records(spark, recs):
    return spark.createDataFrame(recs, LOG_RECORDS)


def test_format_without_fraction(spark):
    r = _records(spark, [(1, 1, datetime.datetime(2017, 5, 1, 10, 0, 0), "info", "hello"),
                         (1, 2, datetime.datetime(2017, 5, 1, 10, 0, 0, 120), "danger", "x")])
    got = sorted(rows(E.format_log(r), "seq", "line"))
    assert got == [(1, "[2017-05-01T10:00:00] info: hello"), (2, "[2017-05-01T10:00:00.000120] danger: x")]


def test_style(spark):
    r = _records(spark, [(1, 1, None, "danger", "x"), (1, 2, None, "other", "y")])
    got = sorted(rows(E.style_log(r), "seq", "time_color", "label", "fg", "bg", "bold"))
    assert got == [(1, "yellow", "Danger", "white", "on_red", False), (2, "yellow", None, None, None, None)]


def test_parse_glued_prompt_and_multiline(spark):
    text = "Do you accept this configuration? [Y/n][2017-05-01T10:00:00] info: Brief summary:\n  + 1 main"
    df = spark.createDataFrame([(1, 1, text)], "deployment_id bigint, seq bigint, line string")
    (prompt, ts, status, msg), = rows(E.parse_log(df), "prompt", "ts", "status", "message")
    assert prompt == "Do you accept this configuration? [Y/n]"
    assert ts == datetime.datetime(2017, 5, 1, 10, 0, 0)
    assert status == "info" and msg == "Brief summary:\n  + 1 main"


def test_parse_no_header_gives_nulls(spark):
    df = spark.createDataFrame([(1, 1, "lb_network_interfaces_ids []")], "deployment_id bigint, seq bigint, line string")
    assert rows(E.parse_log(df), "prompt", "ts", "status", "message") == [(None, None, None, None)]


def test_parse_format_roundtrip(spark):
    recs = fx.log_records(spark, SF_SMALL)
    back = E.parse_log(E.format_log(recs)).select("deployment_id", "seq", "ts", "status", "message")
    assert back.exceptAll(recs).count() == 0 and recs.exceptAll(back).count() == 0


def brute_assemble(lines):
    """Line-by-line record numbering per deployment, in (seq, sub_no) order."""
    header = re.compile(LOG_HEADER_PATTERN)
    out = {}
    for dep in sorted({d for d, *_ in lines}):
        rec = 0
        for d, seq, sub, line in sorted(x for x in lines if x[0] == dep):
            if header.match(line):
                rec += 1
            out.setdefault((dep, rec), []).append(line)
    return sorted((d, r, "\n".join(ls)) for (d, r), ls in out.items())


@pytest.mark.parametrize("chunk_span", [1, 7, 1 << 16])
def test_assemble_matches_brute_force(spark, chunk_span):
    lines = fx.log_lines(spark, SF_SMALL)
    expected = brute_assemble(rows(lines))
    got = sorted(rows(E.assemble_records(lines, chunk_span=chunk_span), "deployment_id", "rec", "text"))
    assert got == expected


def test_lines_before_first_header_are_record_zero(spark):
    lines = spark.createDataFrame([
        (1, 1, 0, "lb_network_interfaces_ids []"),
        (1, 2, 0, "[2017-05-01T10:00:00] info: a"),
        (1, 3, 0, "continued"),
        (1, 9, 0, "[2017-05-01T10:00:01] success: b"),
        (1, 9, 1, "  more"),
    ], LOG_LINES)
    got = sorted(rows(E.assemble_records(lines, chunk_span=2), "rec", "text"))
    assert got == [(0, "lb_network_interfaces_ids []"), (1, "[2017-05-01T10:00:00] info: a\ncontinued"),
                   (2, "[2017-05-01T10:00:01] success: b\n  more")]


def test_status_counts(spark):
    r = _records(spark, [(1, 1, None, "info", ""), (1, 2, None, "info", ""), (2, 3, None, "critical", "")])
    got = sorted(rows(E.status_counts(r), "deployment_id", "info", "success", "warning", "danger", "critical"))
    assert got == [(1, 2, 0, 0, 0, 0), (2, 0, 0, 0, 0, 1)]


line_kinds = st.lists(st.tuples(st.integers(min_value=1, max_value=3), st.integers(min_value=0, max_value=2),
                                st.booleans()), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(st.lists(line_kinds, min_size=1, max_size=3), st.integers(min_value=1, max_value=9))
def test_assemble_random_layouts(spark, deployments, chunk_span):
    rows_ = []
    for dep, kinds in enumerate(deployments):
        seq = 0
        for gap, sub, header in kinds:
            seq += gap
            text = f"[2017-05-01T10:00:0{sub}] info: m{seq}" if header else f"  cont {seq}.{sub}"
            rows_.append((dep, seq, sub, text))
    # (seq, sub_no) must be unique per deployment, as in captured logs
    rows_ = list({(d, s, n): (d, s, n, t) for d, s, n, t in rows_}.values())
    lines = spark.createDataFrame(rows_, LOG_LINES)
    got = sorted(rows(E.assemble_records(lines, chunk_span=chunk_span), "deployment_id", "rec", "text"))
    assert got == brute_assemble(rows_)


def test_parse_equals_the_whole_pattern(spark):
    """The parts cut from the header are the groups of the whole pattern."""
    from pyspark.sql import functions as F
    head = "[2024-01-02T03:04:05.000006] info: "
    texts = [head + "x", "ask? [Y/n]" + head + "a [2] b] c", "[not one] " + head, head, head + "a\rb c\nd", "none", "", None,
             "[2024-01-02T03:04:05] warning: [2024-01-02T03:04:05] info: y", "p\n" + head + "[", "[[" + head + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    got = {r[0]: tuple(r)[1:] for r in E.parse_log(df, keep=("i",)).withColumn("ts", F.col("ts").cast("string")).collect()}
    for i, t in enumerate(texts):
        m = re.compile(LOG_HEADER_PATTERN).match(t or "")
        if m is None:
            assert got[i] == (None,) * 4
        else:
            prompt, ts, status, message = got[i]
            assert (prompt, status, message) == (m[1], m[3], m[4])
            assert ts.replace(" ", "T") == m[2]
