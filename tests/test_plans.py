"""Plan-shape checks: no broadcast chosen from static size estimates, no
exchange where a request row suffices."""

import pytest

import __spark_entry__ as entry_mod
from helpers import SF_SMALL
from flotilla.plans.catalog import QUERIES


def _initial_plan(df) -> str:
    """The physical plan before any stage runs (AQE re-plans later from
    measured sizes)."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["d4_residual_state", "b8_ingress_rules", "c6_passthrough_keys",
                                  "a5_interfaces_in_group", "b15_attach_addresses", "d6_effective_state"])
def test_no_static_broadcast(spark, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    plan = _initial_plan(df)
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["b4_expand_instances", "b9_published_ports", "b11_target_registrations",
                                  "b12_service_endpoints", "b14_listen_lists", "d2_instances_to_terminate",
                                  "e1_format_log", "e4_parse_log"])
def test_row_local_queries_do_not_shuffle_on_keys(spark, name):
    plan = entry_mod.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_stream") and not n.startswith(("a1_read", "a3_write", "a4_"))))
def test_plans_do_not_depend_on_table_size(spark, name):
    """Tables are read as stored: no query spreads its input."""
    assert "REPARTITION_BY" not in _initial_plan(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("name,scans,windows", [("d4_residual_state", 3, 0), ("e3_assemble_records", 2, 2), ("c1_missing_required", 2, 0),
                                                ("c10_generated_secrets", 2, 0)])
def test_inputs_are_read_once_a_use(spark, name, scans, windows):
    """D4 reads the state twice and the outcomes once; E3 numbers the lines once."""
    plan = _initial_plan(QUERIES[name](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == scans
    assert sum(line.lstrip(" :+-*(0123456789)").startswith("Window ") for line in plan.splitlines()) == windows


def test_bucketed_tables_need_no_exchange(spark):
    """D4 and A2 over state and outcomes that were written into the same buckets."""
    from flotilla.operators import state as D
    from flotilla.session import scratch_path
    from flotilla.sources import fixtures as fx
    from flotilla.sources import state_io as A
    from flotilla.sources.buckets import write_bucketed
    st, oc = fx.state_entries(spark, SF_SMALL), fx.teardown_outcomes(spark, SF_SMALL)
    bst, boc = (write_bucketed(df, scratch_path(spark, "t-buckets"), 4) for df in (st, oc))
    left = D.residual_state(bst, boc, copartitioned=True)
    told = A.state_to_json(left, bst, copartitioned=True)
    for df in (left, told, A.state_to_json(bst)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = D.residual_state(st, oc)
    assert left.exceptAll(want).count() == 0 and want.exceptAll(left).count() == 0
    want = A.state_to_json(want, st.select("deployment_id").distinct())
    assert told.exceptAll(want).count() == 0 and want.exceptAll(told).count() == 0


@pytest.mark.parametrize("name", ["c9_config_entries", "c9_config_entries_typed", "c2_fill_defaults", "c9_config_document"])
def test_configuration_reads_each_input_once(spark, name):
    """Requests and overrides are read once and meet in one exchange (the
    fixture of the overrides has one of its own); nothing is joined."""
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_newest_snapshots_are_found_by_a_narrow_aggregate(spark):
    """Only two numbers are aggregated, and only the newest records parsed."""
    plan = _initial_plan(QUERIES["a1_latest_snapshot"](spark, SF_SMALL))
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "max(snapshot" in plan
    assert plan.index("from_json") < plan.index("Join")


@pytest.mark.parametrize("name", ["b12_endpoints_digest", "b13_document_digest", "c9_entries_digest"])
def test_digests_are_partial_sums(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("collect_list") <= 2  # those of a document, not of the digest
