"""State and teardown: the set-based Spark plan against a key-by-key
teardown written from the step table (brute force), plus the traps."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from flotilla.constants import STATE_KEY_NAMES, TEARDOWN_STEPS, TERMINATE_KEYS
from flotilla.operators import state as D
from flotilla.schemas import STATE_ENTRIES, TEARDOWN_OUTCOMES
from flotilla.sources import fixtures as fx


def brute_teardown(state: dict, ok: dict) -> dict:
    """Teardown one record key by key, checking guards against the record as
    it is at each step and stopping a step's deletions at the first absent
    key."""
    st = dict(state)
    queued = []
    for step, guard, removes, _ in TEARDOWN_STEPS:
        if step <= 4:
            key = guard[0]
            if key in st:
                queued += json.loads(st[key]) if step < 4 else [st[key]]
                if ok.get(step):
                    del st[key]
            continue
        if step == 5:
            runs = len(queued) > 0
        else:
            runs = all(g in st for g in guard)
        if runs and ok.get(step):
            for k in removes:
                if k not in st:
                    break
                del st[k]
    return st


def _state(spark, rows_):
    return spark.createDataFrame(rows_, STATE_ENTRIES)


def _outcomes(spark, dep, ok_steps):
    return spark.createDataFrame([(dep, s, s in ok_steps) for s in range(1, 20)], TEARDOWN_OUTCOMES)


def test_residual_matches_brute_force_on_fixture(spark):
    st = fx.state_entries(spark, SF_SMALL)
    oc = fx.teardown_outcomes(spark, SF_SMALL)
    records, oks = {}, {}
    for d, k, v in rows(st):
        records.setdefault(d, {})[k] = v
    for d, s, ok in rows(oc):
        oks.setdefault(d, {})[s] = ok
    expected = sorted((d, k, v) for d, rec in records.items() for k, v in brute_teardown(rec, oks[d]).items())
    got = sorted(rows(D.residual_state(st, oc)))
    assert got == expected


def test_leaks_match_residual(spark):
    st = fx.state_entries(spark, SF_SMALL)
    oc = fx.teardown_outcomes(spark, SF_SMALL)
    a = sorted(rows(D.leaks(st, oc), "deployment_id", "leaked"))
    b = sorted(rows(D.leak_counts(D.residual_state(st, oc))))
    assert a == b


def test_residual_is_subset_of_state(spark):
    st = fx.state_entries(spark, SF_SMALL)
    res = D.residual_state(st, fx.teardown_outcomes(spark, SF_SMALL))
    assert res.exceptAll(st).count() == 0


def test_address_step_stops_at_first_absent_key(spark):
    st = _state(spark, [(1, "main_instance_id", "i-0"), (1, "main_instance_ip", "10.0.1.5"),
                        (1, "workers_instance_ips", "[]"), (1, "cws2_instance_ips", "[]"),
                        (1, "instances_ips", "[]")])
    res = rows(D.residual_state(st, _outcomes(spark, 1, set(range(1, 20)))), "state_key")
    assert sorted(x[0] for x in res) == ["cws2_instance_ips", "instances_ips"]


def test_wait_step_runs_even_if_terminate_failed(spark):
    st = _state(spark, [(1, "main_instance_id", "i-0"), (1, "main_instance_ip", "10.0.1.5")])
    res = rows(D.residual_state(st, _outcomes(spark, 1, {5})), "state_key")
    assert res == [("main_instance_id",)]
    plan = rows(D.teardown_plan(st), "step")
    assert sorted(x[0] for x in plan) == [4, 5]


def test_empty_worker_list_queues_nothing(spark):
    st = _state(spark, [(1, "worker_instances_ids", "[]"), (1, "main_instance_ip", "10.0.1.5")])
    assert sorted(x[0] for x in rows(D.teardown_plan(st), "step")) == [1]
    assert D.instances_to_terminate(st).count() == 0


def test_gateway_step_needs_vpc(spark):
    st = _state(spark, [(1, "gateway_id", "g"), (2, "gateway_id", "g"), (2, "vpc_id", "v")])
    plan = sorted(rows(D.teardown_plan(st), "deployment_id", "step"))
    assert plan == [(2, 17), (2, 18)]


def test_failed_step_keeps_its_keys(spark):
    st = _state(spark, [(1, "load_balancer_arn", "a"), (1, "load_balancer_dnsname", "n"), (1, "vpc_id", "v")])
    res = sorted(x[0] for x in rows(D.residual_state(st, _outcomes(spark, 1, {18})), "state_key"))
    assert res == ["load_balancer_arn", "load_balancer_dnsname"]
    res = sorted(x[0] for x in rows(D.residual_state(st, _outcomes(spark, 1, {7})), "state_key"))
    assert res == ["vpc_id"]


def test_unknown_keys_survive(spark):
    st = _state(spark, [(1, "note", "x"), (1, "vpc_id", "v")])
    res = rows(D.residual_state(st, _outcomes(spark, 1, set(range(1, 20)))), "state_key")
    assert res == [("note",)]


def test_missing_prerequisites(spark):
    st = _state(spark, [(1, "vpc_id", "v"), (1, "cws1_subnet_id", "s"), (2, "vpc_id", "v"),
                        (2, "cws1_subnet_id", "s"), (2, "cws2_subnet_id", "s"), (2, "cws1_instances_ids", "[]"),
                        (2, "cws2_instances_ids", "[]")])
    ids = spark.createDataFrame([(1,), (2,), (3,)], "deployment_id bigint")
    assert sorted(rows(D.missing_prerequisites(st, ids))) == [(1, "cws2_subnet_id"), (3, "vpc_id")]


def test_effective_state_prefers_memory(spark):
    mem = _state(spark, [(1, "main_instance_ip", "10.0.1.5")])
    saved = _state(spark, [(1, "vpc_id", "v"), (2, "vpc_id", "w")])
    assert sorted(rows(D.effective_state(mem, saved))) == [(1, "main_instance_ip", "10.0.1.5"), (2, "vpc_id", "w")]


def test_instances_to_terminate_order(spark):
    st = _state(spark, [(1, "main_instance_id", "m"), (1, "cws1_instances_ids", '["a","b"]'),
                        (1, "worker_instances_ids", '["w"]')])
    got = rows(D.instances_to_terminate(st).orderBy("step", "pos"), "step", "pos", "instance_id")
    assert got == [(1, 0, "w"), (2, 0, "a"), (2, 1, "b"), (4, 0, "m")]


def test_interfaces_in_group(spark):
    st = _state(spark, [(1, "lb_security_group_id", "sg-1"), (2, "lb_security_group_id", "sg-2")])
    ig = spark.createDataFrame([("eni-1", "sg-1"), ("eni-2", "sg-1"), ("eni-2", "sg-9")], "ni_id string, group_id string")
    assert sorted(rows(D.interfaces_in_group(ig, st))) == [(1, "eni-1"), (1, "eni-2")]


def test_top_leaks_is_sorted(spark):
    lk = D.leaks(fx.state_entries(spark, SF_SMALL), fx.teardown_outcomes(spark, SF_SMALL))
    top = rows(D.top_leaks(lk, 5), "leaked", "deployment_id")
    assert top == sorted(top, key=lambda x: (-x[0], x[1]))
    assert top[0][0] == lk.agg(F.max("leaked")).first()[0]


def test_records_after_teardown_cover_every_deployment(spark):
    from helpers import SF_SMALL
    from flotilla.plans.catalog import QUERIES
    from flotilla.sources import fixtures as fx
    ids = {r[0] for r in fx.state_entries(spark, SF_SMALL).select("deployment_id").distinct().collect()}
    left = {r.deployment_id: r.json for r in QUERIES["a2_state_after_teardown_all"](spark, SF_SMALL).collect()}
    gone = {r.deployment_id: r.json for r in QUERIES["a2_state_emptied"](spark, SF_SMALL).collect()}
    assert left.keys() == gone.keys() == ids
    assert any('"vpc_id"' in j for j in left.values()) and any(j.endswith('"state":{}}') for j in gone.values())


# -- a teardown that ends at the listing of interfaces --------------------------------

LISTED = "deployment_id bigint, step int, ok boolean, listing_ok boolean"


def brute_aborting(state: dict, ok: dict, listing_ok: bool):
    """Step after step as the tool does it: (steps run, record saved, keys whose resource went without the record showing it)."""
    record, ran = dict(state), []
    queued = any(k in record and (not lst or json.loads(record[k])) for _, k, lst in TERMINATE_KEYS)
    for step, guard, removes, _ in TEARDOWN_STEPS:
        if not (queued if guard is None else all(k in state for k in guard)):
            continue
        ran.append(step)
        if step == 9 and not listing_ok:
            return ran, dict(state), sorted(set(state) - set(record))
        if ok.get(step):
            for k in removes:
                if k not in record:
                    break
                del record[k]
    return ran, record, []


def test_aborted_teardowns_match_brute_force(spark):
    r = random.Random(4)
    records = {d: {k: '["i"]' if k in D.LIST_KEYS else f"{k}-{d}" for k in STATE_KEY_NAMES if r.random() < 0.8} for d in range(40)}
    oks = {d: {s: r.random() < 0.7 for s in range(1, 20)} for d in records}
    listed = {d: r.random() < 0.5 for d in records}
    st = spark.createDataFrame([(d, k, v) for d, rec in records.items() for k, v in rec.items()], "deployment_id bigint, state_key string, state_value string")
    oc = spark.createDataFrame([(d, s, ok, listed[d] if s == 9 else None) for d, o in oks.items() for s, ok in o.items()], LISTED)
    want = {d: brute_aborting(records[d], oks[d], listed[d]) for d in records}
    assert sorted(rows(D.steps_run(st, oc), "deployment_id", "step")) == sorted((d, s) for d, w in want.items() for s in w[0])
    assert sorted(rows(D.residual_state(st, oc))) == sorted((d, k, v) for d, w in want.items() for k, v in w[1].items())
    assert sorted(rows(D.stale_keys(st, oc))) == sorted((d, k) for d, w in want.items() for k in w[2])
    assert any(w[2] for w in want.values()) and any(9 in w[0] and len(w[0]) > w[0].index(9) + 1 for w in want.values())


def test_listing_that_is_not_told_is_fine(spark):
    st = spark.createDataFrame([(1, "lb_security_group_id", "g"), (1, "vpc_id", "v")], "deployment_id bigint, state_key string, state_value string")
    oc = spark.createDataFrame([(1, 9, True, None), (1, 18, True, None)], LISTED)
    assert rows(D.residual_state(st, oc)) == [] and rows(D.stale_keys(st, oc)) == []
    assert rows(D.residual_state(st, oc.drop("listing_ok"))) == []


def test_listing_fails_only_where_there_is_a_group(spark):
    st = spark.createDataFrame([(1, "vpc_id", "v")], "deployment_id bigint, state_key string, state_value string")
    oc = spark.createDataFrame([(1, 9, False, False), (1, 18, True, None)], LISTED)
    assert rows(D.residual_state(st, oc)) == []
    assert rows(D.steps_run(st, oc), "step") == [(18,)]


def test_malformed_lists_are_rows_of_their_deployment(spark):
    st = spark.createDataFrame([(1, "worker_instances_ids", '["a","b"'), (1, "main_instance_id", "m"), (2, "cws1_instances_ids", '["c","d"]'),
                                (3, "cws2_instances_ids", None), (4, "worker_instances_ids", "[]")], "deployment_id bigint, state_key string, state_value string")
    got = sorted(rows(D.instances_or_errors(st)), key=repr)
    assert got == sorted([(1, 1, None, None, "malformed list"), (1, 4, 0, "m", None), (2, 2, 0, "c", None), (2, 2, 1, "d", None)], key=repr)


def test_plain_lists_are_not_parsed(spark):
    """What counts as a plain list is what the parser finds not empty."""
    texts = ['["a"]', '["i-1","i-2"]', '[""]', "[]", "[ ]", '["a", "b"]', '["é"]', '["a\\"b"]', "[1]", "[null]", None]
    st = spark.createDataFrame([(i, "worker_instances_ids", v) for i, v in enumerate(texts)], "deployment_id bigint, state_key string, state_value string")
    got = dict(rows(D.teardown_masks(st), "deployment_id", "queued"))
    assert got == {i: v is not None and v not in ("[]", "[ ]") for i, v in enumerate(texts)}
    value = spark.createDataFrame([(v,) for v in [*texts, '["a"]x', '["a",]', '["a"\n]', '["a\nb"]', '["a"]\n', '[a"]', "x"]], "v string")
    plain = value.where(F.col("v").rlike(D.PLAIN_LIST)).select("v", F.size(F.from_json("v", "array<string>")).alias("n"))
    assert {r.v: r.n for r in plain.collect()} == {'["a"]': 1, '["i-1","i-2"]': 2, '[""]': 1}
    for broken in ('["a"', "x"):
        with pytest.raises(Exception, match="malformed id list"):
            D.teardown_masks(spark.createDataFrame([(1, "worker_instances_ids", broken)], st.schema)).collect()
