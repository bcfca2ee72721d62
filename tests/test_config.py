"""Configuration operators: presence vs null, strict booleans, integer
conversion, required keys, forced keys, masking (SURVEY §2.4 traps)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from flotilla.functions.columns import config_int, json_string, strict_bool
from flotilla.operators import config as C
from helpers import overrides_df, request, requests_df


def _conf(spark, ov_rows, mask=False, **req):
    r = requests_df(spark, request(spark, **req))
    e = C.config_entries(r, overrides_df(spark, ov_rows), mask=mask)
    return {k: (v, err) for k, v, err in rows(e, "key", "value", "error")}


@pytest.mark.parametrize("value,expected", [("True", True), ("true", False), ("False", False), (None, False)])
def test_strict_bool(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string").select(strict_bool(json_string(F.col("v"))).alias("b"))
    assert rows(df) == [(expected,)]


def test_strict_bool_on_json_true_is_false(spark):
    df = spark.createDataFrame([("true",)], "v string").select(strict_bool(F.col("v")).alias("b"))
    assert rows(df) == [(False,)]


@pytest.mark.parametrize("value,expected", [
    ('" 12 "', 12), ('"10.5"', None), ('"1_000"', 1000), ('"1__0"', None), ('"-7"', -7), ("10240", 10240),
    ("true", 1), ("null", None), ('"abc"', None)])
def test_config_int(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string").select(config_int(F.col("v")).alias("n"))
    assert rows(df) == [(expected,)]


def test_absent_uses_default_but_null_stays_null(spark):
    conf = _conf(spark, [(1, "db_passwd", "pw"), (1, "printer", None), (1, "temp_dir", "/scratch")])
    assert conf["printer"][0] == "null"
    assert conf["https_certfile"][0] == "null"
    assert conf["temp_dir"][0] == '"/scratch"'
    assert conf["paper_size"][0] == '"A4"'
    assert conf["max_file_size"][0] == "10240"


def test_bool_keys(spark):
    conf = _conf(spark, [(1, "db_passwd", "pw"), (1, "backdoor", "True"), (1, "keep_sandbox", "true"),
                         (1, "tornado_debug", None)])
    assert conf["backdoor"][0] == "true"
    assert conf["keep_sandbox"][0] == "false"
    assert conf["tornado_debug"][0] == "false"
    assert conf["database_debug"][0] == "false"


def test_invalid_integer_is_flagged(spark):
    conf = _conf(spark, [(1, "db_passwd", "pw"), (1, "max_file_size", "10.5")])
    assert conf["max_file_size"] == (None, "invalid integer")
    r = requests_df(spark, request(spark))
    e = C.config_entries(r, overrides_df(spark, [(1, "db_passwd", "pw"), (1, "max_file_size", "10.5")]))
    (doc, err), = rows(C.config_document(e), "document", "error")
    assert doc is None and err == "invalid integer"


def test_forced_keys_win(spark):
    conf = _conf(spark, [(1, "db_passwd", "pw"), (1, "num_proxies_used", "5"), (1, "admin_listen_port", "1"),
                         (1, "core_services", "x")])
    assert conf["num_proxies_used"][0] == "1"
    assert conf["admin_listen_port"][0] == "13800"
    assert json.loads(conf["core_services"][0])["LogService"] == [["10.0.1.5", 29000]]


def test_unknown_keys_pass_through_and_local_keys_only_when_given(spark):
    conf = _conf(spark, [(1, "db_passwd", "pw"), (1, "shard_note", "v1"), (1, "db_port", "6543")])
    assert conf["shard_note"][0] == '"v1"'
    assert conf["db_port"][0] == '"6543"'
    assert "db_user" not in conf and "rankings_user" not in conf
    assert json.loads(conf["database"][0]) == "postgresql+psycopg2://cmsuser:pw@localhost:6543/cmsdb"


@pytest.mark.parametrize("given,first", [
    ([], "core_services"), ([("core_services", "x")], "other_services"),
    ([("core_services", "x"), ("other_services", "y")], "db_passwd"),
    ([("core_services", "x"), ("other_services", "y"), ("db_passwd", "z")], None)])
def test_missing_required_raw(spark, given, first):
    ov = C.overrides_json(overrides_df(spark, [(1, k, v) for k, v in given]))
    ids = spark.createDataFrame([(1,)], "deployment_id bigint")
    got = rows(C.missing_required(ov, ids), "first_missing")
    assert got == ([(first,)] if first else [])


def test_missing_password_after_forced(spark):
    r = requests_df(spark, request(spark))
    ov = C.apply_forced(C.overrides_json(overrides_df(spark, [])), r)
    assert rows(C.missing_required(ov, r.select("deployment_id")), "first_missing") == [("db_passwd",)]
    conf = _conf(spark, [])
    assert conf["db_passwd"] == (None, "missing required key")
    assert "database" not in conf


def test_generated_secrets_reported(spark):
    r = requests_df(spark, request(spark))
    ov = C.overrides_json(overrides_df(spark, [(1, "secret_key", "s")]))
    assert rows(C.generated_secrets(ov, r.select("deployment_id")), "key") == [("rankings_passwd",)]


def test_ranking_document(spark):
    r = requests_df(spark, request(spark))
    ov = C.apply_forced(C.overrides_json(overrides_df(spark, [(1, "rankings_user", "u")])), r)
    parts = C.parts_for(ov, r.select("deployment_id"))
    (doc,), = rows(C.ranking_config_document(parts, mask=False), "document")
    assert json.loads(doc) == {"bind_address": "", "http_port": 8890, "username": "u", "password": None}


def test_rankings_always_empty_and_missing_password_reported_first(spark):
    conf = _conf(spark, [(1, "rankings", "x"), (1, "max_file_size", "1.5")])
    assert conf["rankings"][0] == "[]"
    r = requests_df(spark, request(spark))
    ov = overrides_df(spark, [(1, "rankings", "x"), (1, "max_file_size", "1.5")])
    (doc, err), = rows(C.config_documents(r, ov), "document", "error")
    assert doc is None and err == "missing required key"
    (doc2, err2), = rows(C.config_document(C.config_entries(r, ov)), "document", "error")
    assert doc2 is None and err2 == "missing required key"


def test_one_aggregate_document_equals_long_form_document(spark):
    from helpers import SF_SMALL
    from flotilla.sources import fixtures as fx
    req, ov = fx.deployment_requests(spark, SF_SMALL), fx.config_overrides(spark, SF_SMALL)
    for mask in (True, False):
        a = C.config_documents(req, ov, mask).select("deployment_id", "document", "error")
        b = C.config_document(C.config_entries(req, ov, mask))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


VALUES = [
    ('{"b": [1, {"z": null}],\n "a": "x"}', {"a": "x", "b": [1, {"z": None}]}), ("[1, 2.5, \"s\"]", [1, 2.5, "s"]), ("  true ", True),
    ("null", None), ('"quo\\"te \\u00e9"', 'quo"te é'), ("-12.50", -12.5), ("1e3", 1000.0), ("[]", []), ("{}", {}),
    ("123456789012345678901234567890", 123456789012345678901234567890), ('"],["', "],["), ('"}"', "}"), ("[[1],[2]]", [[1], [2]])]
NO_VALUES = ["[1,2", "nul", "", "  ", "1,2", "1], [2", '1},{"a":2', '{"a":1} x', "{'a':1}", '"a', "01", "[1,]", "NaN", '1,"w":2', "],[", '{"a":1,"a":2}',
             "1 2", "1,null", "\"a\" \"b\""]


def _typed(spark, given):
    return spark.createDataFrame([(i, "note", None, g) for i, g in enumerate(given, 1)],
                                 "deployment_id bigint, key string, value string, value_json string")


def test_json_values_keep_their_content(spark):
    got = sorted(rows(C.overrides_json(_typed(spark, [g for g, _ in VALUES])), "deployment_id", "value"))
    assert [json.loads(v) for _, v in got] == [w for _, w in VALUES]
    assert all("\n" not in v for _, v in got)


def test_text_that_is_no_json_value_gives_none(spark):
    got = sorted(rows(C.overrides_json(_typed(spark, NO_VALUES)), "deployment_id", "value"))
    assert [v for _, v in got] == [None] * len(NO_VALUES)


def test_invalid_values_are_errors_of_their_deployment(spark):
    ids = [1, 2, 3]
    r = requests_df(spark, *[request(spark, deployment_id=i) for i in ids])
    given = [(i, "db_passwd", "pw", None) for i in ids] + [(1, "note", None, "[1,2"), (2, "note", None, '[1, {"a": 2}]'), (3, "backdoor", "x", '"tru')]
    ov = spark.createDataFrame(given, "deployment_id bigint, key string, value string, value_json string")
    docs = {d: (doc, e) for d, doc, e in rows(C.config_documents(r, ov, mask=False), "deployment_id", "document", "error")}
    assert docs[1] == (None, "invalid value") and docs[3] == (None, "invalid value")
    assert docs[2][1] is None and json.loads(docs[2][0])["note"] == [1, {"a": 2}]
    long = {d: (doc, e) for d, doc, e in rows(C.config_document(C.config_entries(r, ov, mask=False)), "deployment_id", "document", "error")}
    assert long == docs


def test_repeated_keys_are_written_once(spark):
    r = requests_df(spark, request(spark))
    given = [(1, "db_passwd", "pw", 1), (1, "note", "b", 1), (1, "note", "a", 2)]
    told = spark.createDataFrame(given, "deployment_id bigint, key string, value string, set_no bigint")
    for ov, note in ((told, "a"), (told.drop("set_no"), "b")):
        (doc,), = rows(C.config_documents(r, ov), "document")
        assert doc.count('"note"') == 1 and json.loads(doc)["note"] == note


def test_last_setting_of_a_key_counts(spark):
    data = [(1, "a", None, 5), (1, "a", "x", 5), (1, "a", "z", 4), (1, "b", "y", 1), (1, "b", None, 2), (2, "a", "q", 1)]
    ov = spark.createDataFrame(data, "deployment_id bigint, key string, value string, set_no bigint").repartition(4)
    assert sorted(rows(C.latest_overrides(ov), "deployment_id", "key", "value")) == [(1, "a", "x"), (1, "b", None), (2, "a", "q")]


def test_repeated_settings_are_resolved_in_a_deployments_list(spark):
    """the documents are those of the last settings, which no sort by key finds beforehand."""
    from flotilla.plans.catalog import QUERIES
    from helpers import SF_SMALL
    plan = QUERIES["c9_config_document_repeated"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "set_no" not in plan.split("partial_collect_list", 1)[1].split("SortAggregate", 1)[1] and plan.count("SortAggregate") == 2
    keys = ["db_passwd", "db_port", "max_file_size", "backdoor", "note", "rankings", "database", "core_services", None, "x"]
    values = [("5", None), (None, "7"), (None, "[1"), ("True", None), (None, None), ("a", '"é"'), ("b", "{}")]
    data = [(d or None, keys[(i * 7 + d) % 10], *values[(i * i + d) % 7], None if i % 9 == 4 else i % 4) for d in range(5) for i in range(12 * d + 9)]
    ov = spark.createDataFrame(data, "deployment_id bigint, key string, value string, value_json string, set_no bigint").repartition(3)
    r = requests_df(spark, *[request(spark, deployment_id=i) for i in (1, 2, 3, 5)], request(spark, deployment_id=1))
    for given in (ov, ov.drop("value_json")):
        want = rows(C.config_documents(r, C.latest_overrides(given), mask=False))
        assert sorted(rows(C.config_documents(r, given, mask=False)), key=repr) == sorted(want, key=repr) and len(want) == 4


# -- Python's int() and str() --------------------------------------------------------

PRINTED = ['1e3', '5e-7', '0.1', '1.0', '1e16', '123456789012345680.0', '1e22', '1.7976931348623157e308', '5e-324', '2e23', '9007199254740993.0',
           '1e-5', '0.0001', '123456.789', '1E400', '-1e400', '-0.0', '-0', '0', '[1,"a",null]', '{"a":true,"b":"it\'s","c":[1.50,{"d":"q\\"u\'o\\n\\\\"}]}',
           '"plain \'x\'"', '[]', '{}', '["\\u0001\\u007f\\u00a0 é漢\\t\\r"]', '[-12345678901234567890123,1e5,-2.5e-9,false]', 'true', 'false', 'null',
           '123456789012345678901234567890', '[",:[]{}\\"true"]', '""', '[[["x"]]]', '1e125', '4.2e37', '-18446744073709551617.0']


def test_values_print_as_python_prints_them(spark):
    from pyspark.sql import functions as F
    from flotilla.functions.columns import config_int_text, py_str
    r = random.Random(3)
    given = PRINTED + [f"{r.uniform(-1, 1) * 10 ** r.randrange(-20, 20):.12g}" for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    for v, text, whole in df.select("v", py_str(F.col("v")), config_int_text(F.col("v"))).collect():
        value = json.loads(v)
        assert text == str(value), v
        if isinstance(value, (int, float)) and abs(value) < 2 ** 125:
            assert whole == str(int(value)), v


def test_integers_of_any_length(spark):
    from pyspark.sql import functions as F
    from flotilla.functions.columns import config_int_text
    good = ["12", " 12 ", "+0_1", "-007", "1_000", "9" * 400, "-" + "1" * 60, "0", "-0", "000"]
    bad = ["", " ", "10.5", "1__0", "_1", "1_", "+-1", "x", "1 2", "0x10", "1e3"]
    df = spark.createDataFrame([(json.dumps(v),) for v in good + bad], "v string")
    got = {json.loads(v): w for v, w in df.select("v", config_int_text(F.col("v"))).collect()}
    assert got == {**{v: str(int(v)) for v in good}, **dict.fromkeys(bad)}


def test_long_integers_reach_the_document(spark):
    r = requests_df(spark, request(spark))
    ov = spark.createDataFrame([(1, "db_passwd", "p", None), (1, "max_file_size", None, "123456789012345678901234567890"), (1, "db_name", None, '["a", 1.0]')],
                               "deployment_id bigint, key string, value string, value_json string")
    (doc,), = rows(C.config_documents(r, ov, mask=False), "document")
    assert json.loads(doc)["max_file_size"] == 123456789012345678901234567890
    assert json.loads(doc)["database"].endswith("/['a', 1]")
