"""Records as folds of change logs: order, removals, stores, compaction,
repeated keys."""

import json
import random

import pytest

from helpers import SF_SMALL, rows
from flotilla.operators import changes as G
from flotilla.operators import state as D
from flotilla.session import scratch_path
from flotilla.sources import fixtures as fx
from flotilla.sources import state_io as A
from flotilla.sources import state_store as SS

LOG = "deployment_id bigint, change_no bigint, state_key string, op string, state_value string"


def log(spark, data):
    return spark.createDataFrame(data, LOG)


def replay(data, upto=None):
    """The tool's way: one dictionary a deployment, change after change."""
    records = {}
    for d, no, key, op, value in sorted(data, key=lambda c: (c[1], c[3] == "remove", c[4] is not None, c[4] or "")):
        if upto is None or no <= upto:
            if op == "set":
                records.setdefault(d, {})[key] = value
            else:
                records.setdefault(d, {}).pop(key, None)
    return sorted(((d, k, v) for d, r in records.items() for k, v in r.items()), key=repr)


def random_log(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(4), r.randrange(60), r.choice("abcdef"), r.choice(["set", "set", "remove"]), r.choice(["x", "y", None, "z"])) for _ in range(n)]


def folded(df):
    return sorted(rows(df, "deployment_id", "state_key", "state_value"), key=repr)


@pytest.mark.parametrize("upto", [None, 0, 25])
def test_fold_equals_replay(spark, upto):
    data = [(d, no, k, op, None if op == "remove" else v) for d, no, k, op, v in random_log(3)]
    assert folded(G.fold_changes(log(spark, data).repartition(6), upto)) == replay(data, upto)


def test_ties_and_nulls(spark):
    data = [(1, 5, "a", "set", "x"), (1, 5, "a", "remove", None), (1, 5, "b", "set", "x"), (1, 5, "b", "set", "y"),
            (1, 5, "c", "set", None), (1, 5, "c", "set", "v"), (1, 6, "d", "set", None)]
    assert folded(G.fold_changes(log(spark, data))) == [(1, "b", "y"), (1, "c", "v"), (1, "d", None)]


def test_folding_folds_is_folding(spark):
    """What compaction rests on."""
    data = random_log(8)
    early = log(spark, [c for c in data if c[1] < 30])
    late = log(spark, [c for c in data if c[1] >= 30])
    assert folded(G.fold_changes(G.latest_changes(early).unionByName(late))) == folded(G.fold_changes(log(spark, data)))


def test_teardown_removals_leave_the_residual_state(spark):
    st, oc = fx.state_entries(spark, SF_SMALL), fx.teardown_outcomes(spark, SF_SMALL)
    got = G.fold_changes(G.assignments(st, 1).unionByName(G.teardown_removals(st, oc, 2)))
    want = D.residual_state(st, oc)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_fold_shuffles_once_after_a_partial_aggregate(spark):
    st, oc = fx.state_entries(spark, SF_SMALL), fx.teardown_outcomes(spark, SF_SMALL)
    runs = G.assignments(st, 1).unionByName(G.assignments(st, 2))
    plan = G.fold_changes(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max" in plan


def test_store(spark):
    """Runs, a compaction, later runs; a run and a compaction tried again."""
    path, data = scratch_path(spark, "t-store"), random_log(11)
    data = [(d, no, k, op, None if op == "remove" else v) for d, no, k, op, v in data]
    parts = [[c for c in data if c[1] // 20 == i] for i in range(3)]
    for n in (0, 1):
        SS.append_run(log(spark, parts[n]), path, n)
        SS.append_run(log(spark, parts[n]), path, n)
    assert folded(SS.read_records(spark, path)) == replay(parts[0] + parts[1])
    assert SS.compact(spark, path) == 1 and SS.compact(spark, path) == 1
    assert folded(SS.read_records(spark, path)) == replay(parts[0] + parts[1])
    SS.append_run(log(spark, parts[2]), path, 2)
    assert folded(SS.read_records(spark, path)) == replay(data)
    read = SS.read_changes(spark, path)
    assert "run=0" not in " ".join(f for f in read.inputFiles() if "/changes/" in f) or read.count() < len(data)
    assert SS.compact(spark, path) == 2 and folded(SS.read_records(spark, path)) == replay(data)


def test_removed_keys_stay_removed_after_compaction(spark):
    path = scratch_path(spark, "t-store")
    SS.append_run(log(spark, [(1, 10, "vpc_id", "set", "v"), (1, 20, "vpc_id", "remove", None)]), path, 1)
    SS.compact(spark, path)
    SS.append_run(log(spark, [(1, 15, "vpc_id", "set", "arrived late")]), path, 2)
    assert folded(SS.read_records(spark, path)) == []


def test_repeated_keys_of_a_record(spark):
    plain = spark.createDataFrame([(1, "vpc_id", "a"), (1, "vpc_id", "b"), (1, "x", None), (1, "x", "n")], "deployment_id bigint, state_key string, state_value string")
    (text,), = rows(A.state_to_json(plain), "json")
    assert text.count('"vpc_id"') == 1 and json.loads(text)["state"] == {"vpc_id": "b", "x": "n"}
    told = log(spark, [(1, 2, "vpc_id", "set", "a"), (1, 1, "vpc_id", "set", "b"), (1, 1, "x", "set", "n"), (1, 2, "x", "set", None)])
    (text,), = rows(A.state_to_json(told), "json")
    assert text.count('"vpc_id"') == 1 and json.loads(text)["state"] == {"vpc_id": "a", "x": None}


def test_known_keys_are_folded_by_number(spark):
    """Known keys are sorted and sent as numbers; unknown ones and nulls are keys like others."""
    data = [(1, n, key, "set", f"{key}{n}") for n in (1, 2) for key in ("vpc_id", "note", None)] + [(None, 1, "vpc_id", "remove", None)]
    got = G.latest_changes(log(spark, data))
    assert sorted(rows(got), key=repr) == sorted([(1, 2, "vpc_id", "set", "vpc_id2"), (1, 2, "note", "set", "note2"), (1, 2, None, "set", "None2"),
                                                 (None, 1, "vpc_id", "remove", None)], key=repr)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "state_key" not in plan.split("partial_max")[0].split("SortAggregate")[-1]
