"""Scaled inputs derived from the driver's tables (see FIXTURES.md §2).

Each fixture is a DataFrame expression over one base table. All but two are
narrow: a projection or a generator over a short literal array, so no
fixture adds a shuffle. ``config_overrides`` groups ``lineitem`` by
(order, key) and keeps the largest value, exactly as its SQL; the partial
aggregate runs map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STATE_KEY_NAMES
from ..functions.columns import iso_micros
from .tables import table

PROMPT_TEXT = "Is your IP authorized? [Y/n]"
SUMMARY_HEAD = "Brief summary:"
SUMMARY_LINE = "  + 1 main instance"


def _s(c: Column) -> Column:
    return c.cast("string")


def deployment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_orderpriority", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("deployment_id"),
        F.concat(F.lit("d"), _s(k)).alias("id"),
        F.concat(F.lit("Contest "), _s(k)).alias("title"),
        (k % 5).cast("int").alias("nb_workers_instances"),
        (1 + c % 3).cast("int").alias("nb_workers_per_instance"),
        (c % 7).cast("int").alias("nb_cws_instances"),
        (1 + k % 4).cast("int").alias("nb_cws_per_instance"),
        (F.col("o_orderstatus") != "F").alias("config_phase"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "t2.large")
        .otherwise("t2.medium").alias("main_instance_type"),
        F.concat(F.lit("c5."), F.when(c % 3 == 0, "large").when(c % 3 == 1, "xlarge")
                 .otherwise("2xlarge")).alias("workers_instances_type"),
        F.when(k % 2 == 0, "t2.small").otherwise("t2.micro").alias("cws_instances_type"),
        (c % 4).cast("int").alias("cms_contest"),
        F.col("o_orderdate").alias("requested_at"),
    )


def allowed_cidrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    slots = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"))
                      for kind, pos in (("admin", 0), ("admin", 1), ("ssh", 0), ("ssh", 1))])
    kept = F.filter(slots, lambda s: s["pos"] < k % 3)
    return (o.select(k.alias("deployment_id"), c, F.inline(kept))
            .select("deployment_id", "kind", F.col("pos").cast("int").alias("pos"),
                    F.concat(F.lit("10."), _s(c % 256), F.lit("."), _s(F.col("pos")), F.lit(".0/24"))
                    .alias("cidr")))


_OVERRIDE_KEY = ("CASE l_linenumber WHEN 1 THEN 'backdoor' WHEN 2 THEN 'database_debug' "
                 "WHEN 3 THEN 'max_file_size' WHEN 4 THEN 'num_proxies_used' WHEN 5 THEN 'db_passwd' "
                 "WHEN 6 THEN 'paper_size' ELSE 'shard_note' END")
_OVERRIDE_VALUE = ("CASE WHEN l_linenumber IN (1, 2) "
                   "THEN CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN 'true' ELSE 'False' END "
                   "WHEN l_linenumber IN (3, 4) THEN CAST(l_partkey AS STRING) "
                   "ELSE concat('v', CAST(l_suppkey AS STRING)) END")


def config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag",
               "l_partkey", "l_suppkey")
    return (li.select(F.col("l_orderkey").alias("deployment_id"), F.expr(_OVERRIDE_KEY).alias("key"),
                      F.expr(_OVERRIDE_VALUE).alias("value"))
            .groupBy("deployment_id", "key").agg(F.max("value").alias("value")))


_TYPED_VALUE = ("CASE WHEN key IN ('backdoor', 'database_debug') AND deployment_id % 4 = 0 THEN 'true' "
                "WHEN key = 'database_debug' AND deployment_id % 4 = 1 THEN 'null' "
                "WHEN key = 'max_file_size' AND deployment_id % 3 = 0 THEN value "
                "WHEN key = 'max_file_size' AND deployment_id % 3 = 1 THEN concat(value, '.75') "
                "WHEN key = 'max_file_size' AND deployment_id % 7 = 2 THEN '[1]' "
                "WHEN key = 'paper_size' AND deployment_id % 3 = 1 THEN 'null' "
                "WHEN key = 'shard_note' AND deployment_id % 2 = 0 THEN concat('[1,\"', value, '\",null]') END")


def config_overrides_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides with numbers, lists, booleans and nulls among them."""
    return config_overrides(spark, sf_dir).withColumn("value_json", F.expr(_TYPED_VALUE))


_NESTED_VALUE = ("CASE WHEN key = 'shard_note' AND deployment_id % 4 = 0 "
                 "THEN concat('{\"hosts\" : [ {\"ip\": \"10.0.0.1\", \"ports\": [1, 2.5, null]} ],\\n \"note\": \"', value, ' \\\\u00e9\"}') "
                 "WHEN key = 'shard_note' AND deployment_id % 4 = 1 THEN concat('[1,', value) "
                 "WHEN key = 'shard_note' AND deployment_id % 4 = 2 THEN '{\"a\": 1} and more' "
                 "WHEN key = 'paper_size' AND deployment_id % 5 = 0 THEN '{\"w\": 210, \"h\": {\"mm\": 297.0}}' "
                 "WHEN key = 'paper_size' AND deployment_id % 5 = 1 THEN '1], [2' "
                 "WHEN key = 'max_file_size' AND deployment_id % 6 = 1 THEN ' 1e3 ' "
                 "WHEN key = 'backdoor' AND deployment_id % 7 = 1 THEN '\"Tru\\\\u0065\"' END")


def config_overrides_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides with objects and lists among them, spread over lines, and
    texts that are no JSON value."""
    return config_overrides(spark, sf_dir).withColumn("value_json", F.expr(_NESTED_VALUE))


#: Parts of the database URL that are no strings, by deployment; long integers.
_PART_VALUES = r"""array(
  named_struct('key', 'db_user', 'v', CASE deployment_id % 4 WHEN 0 THEN '[1, "a", null, [2.50, true]]'
    WHEN 1 THEN '{"u": "it\'s", "b": {"x": []}}' WHEN 3 THEN '1e16' END),
  named_struct('key', 'db_port', 'v', CASE deployment_id % 3 WHEN 0 THEN '5432.50' WHEN 1 THEN '123456789012345678901234567890' END),
  named_struct('key', 'db_host', 'v', CASE deployment_id % 2 WHEN 0 THEN '"h\\\\x"' ELSE '["h\\n", "q\\"u\'s"]' END),
  named_struct('key', 'max_file_size', 'v', CASE deployment_id % 5 WHEN 0 THEN '" +00123_456_789_012_345_678_901_234_567_890 "'
    WHEN 1 THEN '-98765432109876543210' WHEN 2 THEN '1.5e20' WHEN 3 THEN '"1__0"' END))"""


def config_overrides_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides with URL parts that are numbers, lists and objects, and
    integers beyond 64 bits."""
    o = table(spark, sf_dir, "orders", "o_orderkey").withColumnsRenamed({"o_orderkey": "deployment_id"})
    parts = o.select("deployment_id", F.inline(F.expr(f"filter({_PART_VALUES}, p -> p.v IS NOT NULL)")))
    rest = config_overrides(spark, sf_dir).where("key <> 'max_file_size'").withColumn("value_json", F.lit(None).cast("string"))
    return rest.unionByName(parts.select("deployment_id", "key", F.lit(None).cast("string").alias("value"), F.col("v").alias("value_json")))


def config_overrides_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every override set twice, first to something else."""
    ov = config_overrides(spark, sf_dir)
    sets = F.array(F.struct(F.concat(F.lit("zz"), "value").alias("value"), F.lit(1).cast("bigint").alias("set_no")),
                   F.struct(F.col("value"), F.lit(2).cast("bigint").alias("set_no")))
    return ov.select("deployment_id", "key", F.inline(sets))


def state_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    g = o.select(k.alias("deployment_id"), F.inline(F.expr(_STATE_KEY_ROWS)))
    key, no, ks = F.col("state_key"), F.col("key_no"), _s(F.col("deployment_id"))
    value = (F.when((key == "worker_instances_ids") & (F.col("deployment_id") % 5 == 0), "[]")
             .when(no.isin(19, 20, 21),
                   F.concat(F.lit('["i-'), ks, F.lit("-"), _s(no), F.lit('-0","i-'), ks, F.lit("-"), _s(no),
                            F.lit('-1"]')))
             .otherwise(F.concat(key, F.lit("-"), ks)))
    return g.select("deployment_id", "state_key", value.alias("state_value"))


_STATE_KEY_ROWS = "filter(array(" + ", ".join(
    f"named_struct('state_key', '{name}', 'key_no', {no})" for no, name in enumerate(STATE_KEY_NAMES, start=1)
) + "), s -> (o_orderkey + s.key_no) % 9 <> 0)"


def teardown_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    steps = F.transform(F.array_repeat(F.lit(0), 19), lambda _, i: i + 1)
    return (o.select(F.col("o_orderkey").alias("deployment_id"), F.col("o_custkey"),
                     F.explode(steps).alias("step"))
            .select("deployment_id", F.col("step").cast("int").alias("step"),
                    ((F.col("o_custkey") + F.col("step")) % 4 != 0).alias("ok")))


def observed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    slots = F.filter(F.transform(F.array_repeat(F.lit(0), 11), lambda _, i: i),
                     lambda p: (k + p) % 6 != 0)
    g = o.select(k.alias("deployment_id"), F.explode(slots).alias("launch_pos"))
    d, p = F.col("deployment_id"), _s(F.col("launch_pos"))
    return g.select(
        "deployment_id", F.col("launch_pos").cast("int").alias("launch_pos"),
        F.concat(F.lit("3."), _s(d % 200), F.lit("."), p, F.lit(".7")).alias("public_ip"),
        F.concat(F.lit("10.9."), _s(d % 200), F.lit("."), p).alias("private_ip"),
    )


def teardown_outcomes_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes with ``listing_ok``: every eleventh deployment could not
    list its network interfaces."""
    step = F.col("step")
    return teardown_outcomes(spark, sf_dir).withColumn("listing_ok", F.when(step == 9, F.col("deployment_id") % 11 != 0))


def observed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines observed three times, thirty days apart, and once more at the
    last of these times; the addresses change."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumnsRenamed({"o_orderkey": "deployment_id"})
    seen = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(min(k, 2)).alias("time")) for k in range(4)])
    obs = observed_addresses(spark, sf_dir).join(o, "deployment_id").withColumn("s", F.explode(seen))
    at = F.col("o_orderdate") + F.expr("make_dt_interval(30 * s.time)")
    return obs.select("deployment_id", "launch_pos", F.concat("public_ip", _s(F.col("s.k"))).alias("public_ip"), "private_ip", at.alias("observed_at"))


def interface_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two group ids per part; the SQL's UNION removes the copy when both are
    equal. ``p_partkey`` is the key of ``part``, so duplicates can only come
    from one row and ``array_distinct`` removes them without a shuffle."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    prefix = F.lit("lb_security_group_id-")
    groups = F.array_distinct(F.array(F.concat(prefix, _s(F.col("p_partkey") % 500)),
                                      F.concat(prefix, _s(F.col("p_size") * 10))))
    return p.select(F.concat(F.lit("eni-"), _s(F.col("p_partkey"))).alias("ni_id"),
                    F.explode(groups).alias("group_id"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return log_records_from_events(ev)


def log_records_from_events(ev: DataFrame) -> DataFrame:
    """The log record fixture from an events DataFrame, batch or stream."""
    et, eid = F.col("event_type"), F.col("event_id")
    status = (F.when(et == "click", "info").when(et == "view", "success").when(et == "purchase", "warning")
              .when(et == "error", "danger").otherwise("critical"))
    message = F.when(eid % 10 == 0,
                     F.concat(F.lit(SUMMARY_HEAD + "\n" + SUMMARY_LINE + "\n  = "), _s(eid), F.lit(" instances"))
                     ).when(eid % 40 == 3, F.concat(F.col("props"), F.lit("\rpull 100%"))
                     ).when(eid % 40 == 7, F.concat(F.col("props"), F.lit("\u2028second part"))
                     ).otherwise(F.col("props"))
    return ev.select(F.col("user_id").alias("deployment_id"), eid.alias("seq"), "ts",
                     status.alias("status"), message.alias("message"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured text, one row per physical line; every 25th header is glued
    to a prompt and every tenth message spans three lines."""
    r = log_records(spark, sf_dir)
    seq = F.col("seq")
    head = F.concat(F.when(seq % 25 == 1, PROMPT_TEXT).otherwise(""), F.lit("["), iso_micros(F.col("ts")),
                    F.lit("] "), F.col("status"), F.lit(": "),
                    F.when(seq % 10 == 0, SUMMARY_HEAD).otherwise(F.col("message")))

    def line(no: int, text: Column) -> Column:
        return F.struct(F.lit(no).alias("sub_no"), text.alias("line"))

    lines = F.when(seq % 10 == 0, F.array(line(0, head), line(1, F.lit(SUMMARY_LINE)),
                                          line(2, F.concat(F.lit("  = "), _s(seq), F.lit(" instances"))))
                   ).otherwise(F.array(line(0, head)))
    return r.select("deployment_id", "seq", F.inline(lines))


def contest_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    contest = (F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").when(k % 5 == 2, "0")
               .when(k % 5 == 3, "abc").otherwise(_s(k)))
    rws = (F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "ON").when(k % 4 == 2, "on")
           .otherwise("OFF"))
    return c.select(k.alias("host_id"), contest.alias("cms_contest"), rws.alias("cms_rws"))
