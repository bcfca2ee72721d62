"""Registered queries: one per operator of the survey, each over the whole
derived tables of a scale-factor folder. ``__spark_entry__`` exposes them.

Outputs are flat (arrays and maps exploded back to rows) and every computed
column is aliased, so each one compares with its SQL oracle row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import config_int, config_int_text, strict_bool
from ..operators import changes as G
from ..operators import config as C
from ..operators import planning as B
from ..operators import logs as E
from ..operators import state as D
from ..streaming import logs as S
from ..streaming import records as SR
from ..schemas import LOG_LINES, LOG_RECORDS
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import log_files as LF
from ..sources import state_io as A
from ..sources import state_store as SS
from ..sources.buckets import bucket_count, write_bucketed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query. Session settings are the caller's: see
    ``session.JOIN_POLICY`` for those this library is tuned for."""
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return wrap


def _acc(spark: SparkSession, d: str) -> DataFrame:
    return B.accepted_requests(fx.deployment_requests(spark, d))


# -- planning ---------------------------------------------------------------------------

@register("b1_validate_requests")
def q_b1(spark, d):
    return B.validate_requests(fx.deployment_requests(spark, d)).select("deployment_id", "accepted", "reason")


@register("b2_fleet_summary")
def q_b2(spark, d):
    return B.fleet_summary(_acc(spark, d))


@register("b2_fleet_totals")
def q_b2t(spark, d):
    return B.fleet_totals(_acc(spark, d))


@register("b3_split_subnets")
def q_b3(spark, d):
    return B.split_subnets(_acc(spark, d))


@register("b4_expand_instances")
def q_b4(spark, d):
    return B.expand_instances(_acc(spark, d)).select("deployment_id", "tier", "idx", "private_ip")


@register("b5_place_instances")
def q_b5(spark, d):
    return B.place_instances(_acc(spark, d))


@register("b6_launch_order")
def q_b6(spark, d):
    return B.launch_order(B.expand_instances(_acc(spark, d)))


@register("b7_derive_names")
def q_b7(spark, d):
    return B.derive_names(_acc(spark, d))


@register("b8_ingress_rules")
def q_b8(spark, d):
    return B.ingress_rules(fx.deployment_requests(spark, d), fx.allowed_cidrs(spark, d))


@register("b9_published_ports")
def q_b9(spark, d):
    return B.published_ports(_acc(spark, d))


@register("b10_port_flags")
def q_b10(spark, d):
    return B.port_flags(_acc(spark, d))


@register("b11_target_registrations")
def q_b11(spark, d):
    return B.target_registrations(_acc(spark, d))


@register("b12_service_endpoints")
def q_b12(spark, d):
    return B.service_endpoints(_acc(spark, d))


@register("b13_service_document")
def q_b13(spark, d):
    return B.service_document_rows(B.service_document(_acc(spark, d)))


def _digest(rows: DataFrame, *cols: str) -> DataFrame:
    """One row a deployment: how many rows it has and the sum of their hashes
    (60 bits of each row's MD5), which does not depend on their order, for
    results too large to be compared row by row. Partial sums, so a deployment
    with very many rows reaches its group as one row of each task."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    bits = F.conv(F.left(F.md5(line), F.lit(15)), 16, 10).cast("decimal(20,0)")
    agg = rows.groupBy("deployment_id").agg(F.count("*").alias("n"), F.sum(bits).alias("digest"))
    return agg.withColumn("digest", F.col("digest").cast("string"))


@register("b12_endpoints_digest")
def q_b12_digest(spark, d):
    return _digest(B.service_endpoints(_acc(spark, d)), "section", "service", "pos", "ip", "port")


@register("b13_document_digest")
def q_b13_digest(spark, d):
    rows = B.service_document_rows(B.service_document(_acc(spark, d)))
    return _digest(rows, "section", "service", "pos", "ip", "port")


@register("c9_entries_digest")
def q_c9_digest(spark, d):
    rows = C.config_entries(fx.deployment_requests(spark, d), fx.config_overrides(spark, d))
    return _digest(rows, "key", "value", "error")


@register("b14_listen_lists")
def q_b14(spark, d):
    return B.listen_rows(_acc(spark, d))


@register("b15_attach_addresses")
def q_b15(spark, d):
    inst = B.expand_instances(_acc(spark, d))
    return B.attach_addresses(inst, fx.observed_addresses(spark, d))


@register("b15_attach_addresses_as_of")
def q_b15_as_of(spark, d):
    """Machines observed several times, as of the first day of 1998."""
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return B.attach_addresses(B.expand_instances(_acc(spark, d)), fx.observed_history(spark, d), as_of)


@register("b15_attach_addresses_newest")
def q_b15_newest(spark, d):
    return B.attach_addresses(B.expand_instances(_acc(spark, d)), fx.observed_history(spark, d))


@register("b16_deployment_stamp")
def q_b16(spark, d):
    return B.deployment_stamp(_acc(spark, d))


@register("b17_container_services")
def q_b17(spark, d):
    return B.container_service_rows(B.container_services(fx.contest_env(spark, d)))


# -- configuration ------------------------------------------------------------------

def _config_inputs(spark, d, overrides=fx.config_overrides):
    req = fx.deployment_requests(spark, d)
    acc = B.accepted_requests(req)
    ids = acc.select("deployment_id")
    user = C.overrides_json(overrides(spark, d))
    return req, acc, ids, user


def _filled(spark, d, overrides=fx.config_overrides, kinds=None):
    return C.filled_config(fx.deployment_requests(spark, d), overrides(spark, d), kinds)


def _parts(spark, d, overrides=fx.config_overrides):
    return C.config_parts(C.resolved_facts(fx.deployment_requests(spark, d), overrides(spark, d)))


@register("c1_missing_required_raw")
def q_c1_raw(spark, d):
    _, _, ids, user = _config_inputs(spark, d)
    return C.missing_required(user, ids)


@register("c1_missing_required")
def q_c1(spark, d):
    _, _, ids, user = _config_inputs(spark, d)
    return C.missing_required(user, ids, forced=True)


@register("c2_fill_defaults")
def q_c2(spark, d):
    return _filled(spark, d)


@register("c3_strict_bool")
def q_c3(spark, d, overrides=fx.config_overrides):
    f = _filled(spark, d, overrides, ("bool",)).where(F.col("kind") == "bool")
    return f.select("deployment_id", "key", strict_bool(F.col("value")).alias("value"))


@register("c4_config_int")
def q_c4(spark, d, overrides=fx.config_overrides):
    f = _filled(spark, d, overrides, ("int",)).where(F.col("kind") == "int")
    v = config_int(F.col("value"))
    return f.select("deployment_id", "key", v.alias("value"), v.isNull().alias("error"))


@register("c5_apply_forced")
def q_c5(spark, d):
    _, acc, _, user = _config_inputs(spark, d)
    return C.apply_forced(user, acc)


@register("c6_passthrough_keys")
def q_c6(spark, d):
    _, _, ids, user = _config_inputs(spark, d)
    return C.passthrough_keys(user, ids)  # forced keys are none of these


@register("c7_database_url")
def q_c7(spark, d):
    return C.database_url(_parts(spark, d))


@register("c8_ranking_document")
def q_c8(spark, d):
    return C.ranking_document(_parts(spark, d))


@register("c8_ranking_config_document")
def q_c8_doc(spark, d):
    return C.ranking_config_document(_parts(spark, d))


@register("c9_config_entries")
def q_c9_entries(spark, d):
    return C.config_entries(fx.deployment_requests(spark, d), fx.config_overrides(spark, d))


@register("c9_config_document")
def q_c9(spark, d):
    docs = C.config_documents(fx.deployment_requests(spark, d), fx.config_overrides(spark, d))
    return docs.select("deployment_id", "document", "error")


@register("c10_generated_secrets")
def q_c10(spark, d):
    _, _, ids, user = _config_inputs(spark, d)
    return C.generated_secrets(user, ids)  # forced keys are none of these


# The same with numbers, lists, booleans and nulls among the overrides, and with masking off.

@register("c3_strict_bool_typed")
def q_c3_typed(spark, d):
    return q_c3(spark, d, fx.config_overrides_typed)


@register("c4_config_int_typed")
def q_c4_typed(spark, d):
    return q_c4(spark, d, fx.config_overrides_typed)


@register("c6_passthrough_keys_typed")
def q_c6_typed(spark, d):
    _, _, ids, user = _config_inputs(spark, d, fx.config_overrides_typed)
    return C.passthrough_keys(user, ids)


@register("c8_ranking_document_typed")
def q_c8_typed(spark, d):
    return C.ranking_document(_parts(spark, d, fx.config_overrides_typed))


@register("c9_config_entries_typed")
def q_c9_entries_typed(spark, d):
    return C.config_entries(fx.deployment_requests(spark, d), fx.config_overrides_typed(spark, d))


@register("c9_config_document_typed")
def q_c9_document_typed(spark, d):
    docs = C.config_documents(fx.deployment_requests(spark, d), fx.config_overrides_typed(spark, d))
    return docs.select("deployment_id", "document", "error")


# The same with nested values, and texts that are no JSON value.

@register("c6_passthrough_keys_nested")
def q_c6_nested(spark, d):
    _, _, ids, user = _config_inputs(spark, d, fx.config_overrides_nested)
    return C.passthrough_keys(user, ids)


@register("c9_config_entries_nested")
def q_c9_entries_nested(spark, d):
    return C.config_entries(fx.deployment_requests(spark, d), fx.config_overrides_nested(spark, d))


@register("c9_config_document_nested")
def q_c9_document_nested(spark, d):
    docs = C.config_documents(fx.deployment_requests(spark, d), fx.config_overrides_nested(spark, d))
    return docs.select("deployment_id", "document", "error")


@register("c9_documents_parse")
def q_c9_parse(spark, d):
    """Every document parses, read back as a VARIANT."""
    docs = C.config_documents(fx.deployment_requests(spark, d), fx.config_overrides_nested(spark, d)).where("document IS NOT NULL")
    v = F.try_parse_json("document")
    return docs.select("deployment_id", v.isNotNull().alias("parses"), F.size(F.json_object_keys("document")).cast("long").alias("n_keys"),
                       F.try_variant_get(v, "$.shard_note.hosts[0].ip", "string").alias("ip"),
                       F.try_variant_get(v, "$.paper_size.h.mm", "double").alias("mm"))


@register("a3_config_failures_nested")
def q_a3_failures_nested(spark, d):
    return A.config_failures(C.config_files(fx.deployment_requests(spark, d), fx.config_overrides_nested(spark, d)))


@register("c9_config_document_repeated")
def q_c9_document_repeated(spark, d):
    """Overrides that were set twice; the last setting counts."""
    docs = C.config_documents(fx.deployment_requests(spark, d), fx.config_overrides_repeated(spark, d))
    return docs.select("deployment_id", "document", "error")


@register("c4_config_int_text")
def q_c4_text(spark, d):
    """Integers of any length."""
    f = _filled(spark, d, fx.config_overrides_parts, ("int",)).where(F.col("kind") == "int")
    v = config_int_text(F.col("value"))
    return f.select("deployment_id", "key", v.alias("value"), v.isNull().alias("error"))


@register("c7_database_url_parts")
def q_c7_parts(spark, d):
    """URL parts that are numbers, lists and objects, printed as Python does."""
    return C.database_url(_parts(spark, d, fx.config_overrides_parts))


@register("c7_database_url_unmasked")
def q_c7_unmasked(spark, d):
    return C.database_url(_parts(spark, d), mask=False)


@register("c9_config_entries_unmasked")
def q_c9_unmasked(spark, d):
    return C.config_entries(fx.deployment_requests(spark, d), fx.config_overrides(spark, d), mask=False)


# -- state and teardown ---------------------------------------------------------------

@register("d1_missing_prerequisites")
def q_d1(spark, d):
    ids = _acc(spark, d).where(~F.col("config_phase")).select("deployment_id")
    return D.missing_prerequisites(fx.state_entries(spark, d), ids)


@register("d2_instances_to_terminate")
def q_d2(spark, d):
    return D.instances_to_terminate(fx.state_entries(spark, d))


def _cut_lists(spark, d):
    """State with every 97th deployment's values cut off at the end."""
    cut = F.expr("CASE WHEN deployment_id % 97 = 0 THEN left(state_value, length(state_value) - 1) ELSE state_value END")
    return fx.state_entries(spark, d).withColumn("state_value", cut)


@register("d2_malformed_lists")
def q_d2_malformed(spark, d):
    return D.malformed_lists(_cut_lists(spark, d))


@register("d2_instances_or_errors")
def q_d2_errors(spark, d):
    return D.instances_or_errors(_cut_lists(spark, d))


@register("d3_teardown_plan")
def q_d3(spark, d):
    return D.teardown_plan(fx.state_entries(spark, d))


@register("d4_residual_state")
def q_d4(spark, d):
    return D.residual_state(fx.state_entries(spark, d), fx.teardown_outcomes(spark, d))


@register("d5_leaks")
def q_d5(spark, d):
    return D.leaks(fx.state_entries(spark, d), fx.teardown_outcomes(spark, d)).drop("leaked_keys")


@register("d5_leaks_top")
def q_d5_top(spark, d):
    return D.top_leaks(D.leaks(fx.state_entries(spark, d), fx.teardown_outcomes(spark, d)).drop("leaked_keys"))


@register("d5_leak_counts_from_residual")
def q_d5_res(spark, d):
    return D.leak_counts(D.residual_state(fx.state_entries(spark, d), fx.teardown_outcomes(spark, d)))


def _bucketed(spark, d):
    """State and outcomes written into the same buckets, as many as the larger
    of them needs."""
    tables = [fx.state_entries(spark, d), fx.teardown_outcomes(spark, d)]
    n = bucket_count(max(df.count() for df in tables))
    return [write_bucketed(df, scratch_path(spark, "buckets"), n) for df in tables]


@register("d4_residual_state_bucketed")
def q_d4_bucketed(spark, d):
    return D.residual_state(*_bucketed(spark, d), copartitioned=True)


@register("a2_state_after_teardown_bucketed")
def q_a2_bucketed(spark, d):
    st, oc = _bucketed(spark, d)
    return A.state_to_json(D.residual_state(st, oc, copartitioned=True), st, copartitioned=True)


# The same where the listing of interfaces fails for some deployments.

@register("d3_steps_run")
def q_d3_run(spark, d):
    return D.steps_run(fx.state_entries(spark, d), fx.teardown_outcomes_listing(spark, d))


@register("d4_residual_state_aborted")
def q_d4_aborted(spark, d):
    return D.residual_state(fx.state_entries(spark, d), fx.teardown_outcomes_listing(spark, d))


@register("d5_leaks_aborted")
def q_d5_aborted(spark, d):
    return D.leaks(fx.state_entries(spark, d), fx.teardown_outcomes_listing(spark, d)).drop("leaked_keys")


@register("d5_stale_keys")
def q_d5_stale(spark, d):
    return D.stale_keys(fx.state_entries(spark, d), fx.teardown_outcomes_listing(spark, d))


@register("d6_effective_state")
def q_d6(spark, d):
    memory = D.planned_state(_acc(spark, d).where(F.col("config_phase")))
    return D.effective_state(memory, fx.state_entries(spark, d))


@register("d7_select_instances")
def q_d7(spark, d):
    inst = D.instances_to_terminate(fx.state_entries(spark, d))
    done = fx.teardown_outcomes(spark, d).where(F.col("ok") & (F.col("step") <= 4))
    return D.select_instances(inst, done, on=("deployment_id", "step"))


@register("d7_select_by_instance_id")
def q_d7_id(spark, d):
    inst = D.instances_to_terminate(fx.state_entries(spark, d))
    return D.select_instances(inst, inst.where(F.col("pos") == 0), on=("instance_id",))


@register("a5_interfaces_in_group")
def q_a5(spark, d):
    return D.interfaces_in_group(fx.interface_groups(spark, d), fx.state_entries(spark, d))


# -- logs -----------------------------------------------------------------------------------

@register("e1_format_log")
def q_e1(spark, d):
    return E.format_log(fx.log_records(spark, d))


@register("e2_style_log")
def q_e2(spark, d):
    return E.style_log(fx.log_records(spark, d))


@register("e3_assemble_records")
def q_e3(spark, d):
    return E.assemble_records(fx.log_lines(spark, d))


@register("e3_assemble_records_chunked")
def q_e3_chunked(spark, d):
    """The same with chunks small enough that records cross their edges."""
    return E.assemble_records(fx.log_lines(spark, d), chunk_span=64)


@register("e3_assemble_files")
def q_e3_files(spark, d):
    """From text files without line numbers, several a deployment: records
    go on in the next file."""
    path = LF.write_log_files(fx.log_lines(spark, d), scratch_path(spark, "logs"), lines_per_file=50)
    return E.assemble_files(LF.read_log_files(spark, path))


def _line_batches(spark, d, batch: Column, out: str) -> str:
    """Captured lines arrive in four batches, each through a stream that is
    started anew from its checkpoint. Batches are cut inside messages."""
    lines = fx.log_lines(spark, d)
    step = (lines.agg(F.max("seq")).first()[0] // 40 + 1) * 10
    base = scratch_path(spark, out)
    lines = lines.withColumn("slice", F.expr(f"(3 * seq + sub_no - 1) div {3 * step}")).withColumn("batch_no", batch)
    for k in range(4):
        lines.where(F.col("batch_no") == k).drop("slice", "batch_no").write.mode("append").parquet(f"{base}/lines")
        stream = spark.readStream.schema(LOG_LINES).parquet(f"{base}/lines")
        SR.start(stream, f"{base}/records", f"{base}/checkpoint").awaitTermination()
    return f"{base}/records"


@register("e3_assemble_stream")
def q_e3_stream(spark, d):
    return SR.records(spark, _line_batches(spark, d, F.col("slice"), "e3-stream"))


@register("e3_stream_late_lines")
def q_e3_late(spark, d):
    """Every fiftieth line comes a batch later than its neighbours."""
    late = F.when(F.col("seq") % 50 == 7, F.least(F.lit(3), F.col("slice") + 1)).otherwise(F.col("slice"))
    return SR.late_lines(spark, _line_batches(spark, d, late, "e3-late"))


@register("e4_parse_log")
def q_e4(spark, d):
    p = E.parse_log(E.format_log(fx.log_records(spark, d)))
    return p.withColumn("ts", E.ts_text(F.col("ts")))


@register("e4_parse_assembled")
def q_e4_asm(spark, d):
    recs = E.assemble_records(fx.log_lines(spark, d))
    p = E.parse_log(recs, "text", keep=("deployment_id", "rec", "first_seq"))
    return p.withColumn("ts", E.ts_text(F.col("ts")))


@register("e5_status_counts")
def q_e5(spark, d):
    return E.status_counts(fx.log_records(spark, d))


@register("e1_format_log_stream")
def q_e1_stream(spark, d):
    out = S.run_to_parquet(S.formatted_log_stream(spark, d), spark, "e1-stream")
    return spark.read.parquet(out)


@register("e2_style_log_stream")
def q_e2_stream(spark, d):
    return spark.read.parquet(S.run_to_parquet(S.styled_log_stream(spark, d), spark, "e2-stream"))


@register("e5_status_counts_stream")
def q_e5_stream(spark, d):
    return S.latest_counts(spark, S.run_updates_to_parquet(S.status_count_stream(spark, d), spark, "e5-stream"))


WINDOW, DELAY = "1 day", "2 days"


def _record_batches(spark, d, start, out: str) -> str:
    """Log records arrive in slices of eight days, every fiftieth a slice
    late; each slice goes through a stream started anew from its checkpoint."""
    recs = fx.log_records(spark, d)
    first = recs.agg(F.min("ts")).first()[0]
    day = F.datediff(F.col("ts"), F.lit(first).cast("date"))
    slice_no = (day / 8).cast("int")
    batch = F.when(F.col("seq") % 50 == 7, F.least(F.lit(3), slice_no + 1)).otherwise(slice_no)
    base = scratch_path(spark, out)
    for k in range(4):
        recs.where(batch == k).write.mode("append").parquet(f"{base}/records")
        stream = spark.readStream.schema(LOG_RECORDS).parquet(f"{base}/records")
        start(stream, f"{base}/out", f"{base}/checkpoint", WINDOW, DELAY).awaitTermination()
    return f"{base}/out"


@register("e5_window_counts_stream")
def q_e5_windows(spark, d):
    out = spark.read.parquet(_record_batches(spark, d, S.start_window_counts, "e5-windows"))
    return out.withColumn("window_start", E.ts_text(F.col("window_start")))


@register("e5_late_window_counts")
def q_e5_late(spark, d):
    out = S.late_window_counts(spark, _record_batches(spark, d, S.start_late_counts, "e5-late"))
    return out.withColumn("window_start", E.ts_text(F.col("window_start")))


@register("e4_parse_log_stream")
def q_e4_stream(spark, d):
    out = S.run_to_parquet(S.parsed_log_stream(spark, d), spark, "e4-stream")
    return spark.read.parquet(out).withColumn("ts", E.ts_text(F.col("ts")))


# -- sources and sinks -------------------------------------------------------------------

@register("a1_read_state")
def q_a1(spark, d):
    path = A.write_state(fx.state_entries(spark, d), scratch_path(spark, "state"))
    return A.read_state(spark, path)


#: Folders over which a fleet's files are spread.
FILE_FOLDERS = 1024


@register("a1_state_files")
def q_a1_files(spark, d):
    """What the configuration runs record, a file a deployment as the tool
    writes it, read back."""
    acc = _acc(spark, d).where(F.col("config_phase"))
    path = A.write_state_files(D.planned_state(acc), acc, scratch_path(spark, "state-files"), folders=FILE_FOLDERS)
    return A.read_state(spark, path, layout="files")


@register("a3_config_files")
def q_a3_files(spark, d):
    """Both documents of every deployment in files as the tool writes them,
    read back."""
    req = fx.deployment_requests(spark, d)
    files = C.config_files(req, fx.config_overrides_nested(spark, d))
    path = A.write_config_files(files, req, scratch_path(spark, "config-files"), folders=FILE_FOLDERS)
    return A.read_config_files(spark, path)


@register("a1_state_records")
def q_a1_records(spark, d):
    r = A.state_records(fx.state_entries(spark, d))
    return r.select("deployment_id", "vpc_id", "main_instance_id",
                    F.when(F.col("worker_instances_ids").isNotNull(), F.size("worker_instances_ids")).alias("n_workers"),
                    F.get("cws1_instances_ids", F.lit(0)).alias("first_cws1"))


def _after_teardown(spark, d, outcomes):
    st = fx.state_entries(spark, d)
    return A.state_to_json(D.residual_state(st, outcomes), st.select("deployment_id").distinct())


@register("a2_state_after_teardown_all")
def q_a2_after_all(spark, d):
    """The records of all deployments, saved after teardown: partly emptied
    where steps failed."""
    return _after_teardown(spark, d, fx.teardown_outcomes(spark, d))


@register("a2_state_emptied")
def q_a2_emptied(spark, d):
    """The same where every step succeeds: emptied records are saved as such."""
    return _after_teardown(spark, d, fx.teardown_outcomes(spark, d).withColumn("ok", F.lit(True)))


@register("a2_state_after_abort")
def q_a2_abort(spark, d):
    """The same where some teardowns end at the listing of interfaces and
    save nothing."""
    return _after_teardown(spark, d, fx.teardown_outcomes_listing(spark, d))


@register("a1_latest_snapshot")
def q_a1_latest(spark, d):
    """A full snapshot, then one of every other deployment after teardown."""
    st = fx.state_entries(spark, d)
    path = A.append_state(st, scratch_path(spark, "snapshots"), 1).rsplit("/", 1)[0]
    torn = st.where(F.col("deployment_id") % 2 == 0)
    left = D.residual_state(torn, fx.teardown_outcomes(spark, d))
    A.append_state(left, path, 2, torn.select("deployment_id").distinct())
    return A.read_latest_state(spark, path)


@register("a2_deployed_state")
def q_a2_deployed(spark, d):
    return D.deployed_state(_acc(spark, d), fx.observed_addresses(spark, d))


def _runs(spark, d):
    """The changes of three runs: every deployment is deployed, torn down with
    the given outcomes, and the configuration runs record their addresses."""
    st = fx.state_entries(spark, d)
    planned = D.planned_state(_acc(spark, d).where(F.col("config_phase")))
    return [G.assignments(st, 1), G.teardown_removals(st, fx.teardown_outcomes(spark, d), 2), G.assignments(planned, 3)]


def _log(runs):
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@register("a1_fold_changes")
def q_a1_fold(spark, d):
    return G.fold_changes(_log(_runs(spark, d)))


@register("a1_fold_changes_upto")
def q_a1_fold_upto(spark, d):
    """The records as they were after the teardown."""
    return G.fold_changes(_log(_runs(spark, d)), upto=3 * G.RUN - 1)


@register("a1_latest_changes")
def q_a1_latest_changes(spark, d):
    """The last change of every key, removals included."""
    return G.latest_changes(_log(_runs(spark, d)))


@register("a1_compacted_store")
def q_a1_compacted(spark, d):
    """From a store that was compacted after its second run."""
    path = scratch_path(spark, "store")
    for n, changes in enumerate(_runs(spark, d), 1):
        SS.append_run(changes, path, n)
        if n == 2:
            SS.compact(spark, path)
    return SS.read_records(spark, path)


@register("a2_repeated_keys")
def q_a2_repeated(spark, d):
    """Records of a log in which every key is assigned twice and the addresses
    a third time; the last assignment counts."""
    st = fx.state_entries(spark, d)
    first = G.assignments(st.withColumn("state_value", F.concat(F.lit("zz-old-"), "state_value")), 1)
    return A.state_to_json(first.unionByName(G.assignments(st, 2)).unionByName(_runs(spark, d)[2]))


@register("a2_state_to_json")
def q_a2(spark, d):
    return A.state_to_json(fx.state_entries(spark, d))


@register("a3_write_config")
def q_a3(spark, d):
    files = C.config_files(fx.deployment_requests(spark, d), fx.config_overrides(spark, d))
    path = A.write_config(files, scratch_path(spark, "config"))
    names = F.when(F.col("doc") == "config", "cms.conf").otherwise("cms.ranking.conf")
    return A.read_configs(spark, path).withColumn("doc", names)


@register("a3_config_failures")
def q_a3_failures(spark, d):
    return A.config_failures(C.config_files(fx.deployment_requests(spark, d), fx.config_overrides(spark, d)))


@register("a4_read_requests")
def q_a4(spark, d):
    path = A.write_requests(fx.deployment_requests(spark, d), scratch_path(spark, "requests"))
    return A.read_requests(spark, path).withColumn("requested_at", E.ts_text(F.col("requested_at")))
