"""Property tests: the column functions that mimic Python semantics agree
with Python on random inputs (one Spark job per example batch)."""

import datetime
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flotilla.functions.columns import config_int, iso_time, json_string, py_floordiv, py_mod, strict_bool
from flotilla.operators import logs as E
from flotilla.schemas import LOG_RECORDS


def python_int(s):
    try:
        return int(s)
    except (ValueError, TypeError):
        return None


int_text = st.one_of(
    st.text(alphabet="0123456789+-_ \t\n.ab", max_size=12),
    st.from_regex(r"\A[ \t]{0,2}[+-]?[0-9]{1,9}(_[0-9]{1,3}){0,2}[ \t]{0,2}\Z"),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(int_text, min_size=1, max_size=200))
def test_config_int_matches_python_int(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(config_int(json_string(F.col("v")))).collect()]
    assert got == [python_int(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["True", "true", "False", "TRUE", ""])), min_size=1, max_size=50))
def test_strict_bool_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(strict_bool(json_string(F.col("v")))).collect()]
    assert got == [v == "True" for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-10**6, max_value=10**6), min_size=1, max_size=200))
def test_python_division(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n int")
    got = [tuple(r) for r in df.select(py_floordiv(F.col("n"), 2), py_mod(F.col("n"), 2)).collect()]
    assert got == [(v // 2, v % 2) for v in values]


timestamps = st.datetimes(min_value=datetime.datetime(1990, 1, 1), max_value=datetime.datetime(2090, 1, 1))


@settings(max_examples=5, deadline=None)
@given(st.lists(timestamps, min_size=1, max_size=100))
def test_iso_time_matches_isoformat(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ts timestamp_ntz")
    got = [r[0] for r in df.select(iso_time(F.col("ts"))).collect()]
    assert got == [v.isoformat() for v in values]


messages = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\r"), max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(timestamps, st.sampled_from(["info", "success", "warning", "danger", "critical"]),
                          messages), min_size=1, max_size=60))
def test_parse_inverts_format(spark, recs):
    rows = [(1, i, ts, status, msg) for i, (ts, status, msg) in enumerate(recs)]
    df = spark.createDataFrame(rows, LOG_RECORDS)
    back = E.parse_log(E.format_log(df)).select("deployment_id", "seq", "ts", "status", "message")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), min_size=1, max_size=50))
def test_json_string_matches_json_dumps_roundtrip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [json.loads(r[0]) for r in df.select(json_string(F.col("v"))).collect()]
    assert got == values
