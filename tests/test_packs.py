"""Logs of changes whose rows travel in packs (``sources.packs``)."""

import random

import pytest

from helpers import SF_SMALL, rows
from flotilla.plans.catalog import QUERIES
from flotilla.sources import state_io as A

LOG = "deployment_id bigint, state_key string, state_value string, change_no bigint"


def test_logs_are_not_sorted_before_the_shuffle(spark):
    """one sort of packs after the shuffle, none of rows before it, and no aggregate that falls back to sorting."""
    plan = QUERIES["a2_repeated_keys"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 2
    full = QUERIES["a2_repeated_keys"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in full.split("Exchange", 1)[1] and full.count("Exchange") == 1


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_packs_give_the_records_of_collected_rows(spark, batch):
    """Any order of rows, batches within a deployment, unknown and null keys, equal and null numbers, empty records."""
    rng = random.Random(int(batch))
    keys = ["vpc_id", "workers_instance_ips", "main_instance_id", "note", "aa", None, "éx"]
    values = [None, "", "v", "[]", '["a"]', "ü€", "x" * 300]
    data = [(rng.choice([None, 1, 2, 10 ** 12]), rng.choice(keys), rng.choice(values), rng.choice([None, 0, 1, -5, 40_000, 2 ** 62, -2 ** 63])) for _ in range(90)]
    log = spark.createDataFrame(data, LOG).coalesce(1)
    ids = spark.createDataFrame([(1,), (77,), (77,)], "deployment_id bigint")
    want = sorted(rows(A.state_to_json(log, copartitioned=True)), key=repr)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for given in (log, log.orderBy("deployment_id"), log.repartition(3)):
            assert sorted(rows(A.state_to_json(given)), key=repr) == want
        assert sorted(rows(A.state_to_json(log, ids)), key=repr) == sorted([*want, (77, '{"deployment_id":77,"state":{}}')], key=repr)
        assert rows(A.state_to_json(log.limit(0))) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
