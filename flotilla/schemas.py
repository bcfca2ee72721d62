"""Declared schemas of every table the operators read or write."""

from __future__ import annotations

from pyspark.sql import types as T


DEPLOYMENT_REQUESTS = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("nb_workers_instances", T.IntegerType(), True),
    T.StructField("nb_workers_per_instance", T.IntegerType(), True),
    T.StructField("nb_cws_instances", T.IntegerType(), True),
    T.StructField("nb_cws_per_instance", T.IntegerType(), True),
    T.StructField("config_phase", T.BooleanType(), True),
    T.StructField("main_instance_type", T.StringType(), True),
    T.StructField("workers_instances_type", T.StringType(), True),
    T.StructField("cws_instances_type", T.StringType(), True),
    T.StructField("cms_contest", T.IntegerType(), True),
    T.StructField("requested_at", T.TimestampNTZType(), True),
])

ALLOWED_CIDRS = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("cidr", T.StringType(), True),
])

CONFIG_OVERRIDES = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

STATE_ENTRIES = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("state_key", T.StringType(), False),
    T.StructField("state_value", T.StringType(), True),
])

TEARDOWN_OUTCOMES = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("step", T.IntegerType(), False),
    T.StructField("ok", T.BooleanType(), True),
])

OBSERVED_ADDRESSES = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("launch_pos", T.IntegerType(), False),
    T.StructField("public_ip", T.StringType(), True),
    T.StructField("private_ip", T.StringType(), True),
])

INTERFACE_GROUPS = T.StructType([
    T.StructField("ni_id", T.StringType(), False),
    T.StructField("group_id", T.StringType(), False),
])

LOG_RECORDS = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])

LOG_LINES = T.StructType([
    T.StructField("deployment_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("sub_no", T.IntegerType(), False),
    T.StructField("line", T.StringType(), True),
])

CONTEST_ENV = T.StructType([
    T.StructField("host_id", T.LongType(), False),
    T.StructField("cms_contest", T.StringType(), True),
    T.StructField("cms_rws", T.StringType(), True),
])

# Declared schemas of the driver's tables the library reads (no inference
# at read time; a file that disagrees fails the scan instead of changing
# the plan).
SOURCE_TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}
