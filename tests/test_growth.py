"""What keeps tasks and the driver small when the tables grow."""

import glob

import pytest

from helpers import SF_SMALL, rows
from flotilla.plans.catalog import QUERIES
from flotilla.session import scratch_path
from flotilla.sources import state_io as A
from flotilla.sources.buckets import BUCKET_ROWS, bucket_count


@pytest.fixture
def default_threshold(spark):
    """A session whose joins go by Spark's static sizes, as without JOIN_POLICY."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["a2_deployed_state", "b15_attach_addresses"])
def test_observations_are_not_collected_by_the_driver(default_threshold, name):
    got = plan(QUERIES[name](default_threshold, SF_SMALL))
    assert "SortMergeJoin" in got and "Broadcast" not in got


@pytest.mark.parametrize("name", ["d4_residual_state", "d4_residual_state_aborted", "d6_effective_state", "d4_residual_state_bucketed"])
def test_state_rows_are_not_sorted_to_be_joined(default_threshold, name):
    got = plan(QUERIES[name](default_threshold, SF_SMALL))
    assert "ShuffledHashJoin" in got and "SortMergeJoin" not in got and "Broadcast" not in got


def test_buckets_grow_with_the_table():
    assert bucket_count(0) == bucket_count(16 * BUCKET_ROWS) == 16
    for n in (10 ** 8, 10 ** 9, 10 ** 10):
        assert n / bucket_count(n) <= BUCKET_ROWS


def test_records_travel_without_their_json(spark):
    """Rows are collected as key number and value: keys and texts are made afterwards."""
    st = spark.createDataFrame([(1, "vpc_id", "v"), (1, "vpc_id", "w"), (1, "note", 'n"'), (1, "aa", None), (None, "vpc_id", "x")],
                               "deployment_id bigint, state_key string, state_value string")
    told = A.state_to_json(st)
    assert sorted(rows(told), key=repr) == [(1, '{"deployment_id":1,"state":{"vpc_id":"w","aa":null,"note":"n\\""}}'), (None, None)]
    shuffled = plan(told).split("partial_collect_list")[1]
    assert "concat" not in shuffled and "RLIKE" not in shuffled


def test_state_lines_are_compressed(spark):
    st = spark.createDataFrame([(1, "vpc_id", "v")], "deployment_id bigint, state_key string, state_value string")
    path = A.write_state(st, scratch_path(spark, "t-state"))
    assert glob.glob(path.replace("file:", "") + "/part-*.txt.gz") and rows(A.read_state(spark, path)) == [(1, "vpc_id", "v")]


def test_generated_configuration_rows_are_not_looked_up(spark):
    """After the generator nothing is typed or looked up for a row."""
    top = plan(QUERIES["c9_config_entries"](spark, SF_SMALL)).split("Generate")[0]
    assert "RLIKE" not in top and "max_print_length" not in top
