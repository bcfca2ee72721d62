"""State and teardown operators.

The saved state is a long table ``(deployment_id, state_key, state_value)``.
Teardown logic depends, per deployment, only on which of the 27 known keys
are present, whether any machine id was queued for termination, and which
steps succeeded. Those facts fit in three small values, so the plan is:

1. map every state row and outcome row to bits (narrow);
2. ONE ``groupBy(deployment_id)`` with ``bit_or``/``bool_or``; the partial
   aggregate runs map-side, so even a deployment with very many rows
   reaches the reducer as one row per map partition;
3. plan steps, removed keys (with the stop-at-first-absent rule of the
   address step) and leak counts are column arithmetic on that row;
4. only the residual rows need the state values back: one join on
   ``deployment_id`` with the per-deployment row (already partitioned by the
   aggregate; AQE can split a skewed state side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    LB_PREREQUISITES, MAIN_IP, NON_RESOURCE_KEYS, STATE_KEY_NAMES, TEARDOWN_STEPS, TERMINATE_KEYS,
)
from ..functions.columns import case_lookup, json_string, sql_literal, struct_sql
from .config import first_absent

KEY_BIT = {k: i for i, k in enumerate(STATE_KEY_NAMES)}
LIST_KEYS = [k for _, k, is_list in TERMINATE_KEYS if is_list]
SINGLE_KEYS = [k for _, k, is_list in TERMINATE_KEYS if not is_list]
RESOURCE_MASK = sum(1 << KEY_BIT[k] for k in STATE_KEY_NAMES if k not in NON_RESOURCE_KEYS)


def _mask_of(keys) -> int:
    return sum(1 << KEY_BIT[k] for k in keys)


def _key_bit(key: str = "state_key") -> Column:
    """The bit of a known state key (null for other keys)."""
    return case_lookup(key, {k: 1 << i for k, i in KEY_BIT.items()}, cast="bigint")


def id_list(value: Column) -> Column:
    """The ids of a saved list. A list that does not parse fails the job, as
    loading a broken record fails the tool; :func:`malformed_lists` finds
    such rows beforehand."""
    ids = F.from_json(value, "array<string>")
    broken = F.raise_error(F.concat(F.lit("malformed id list: "), value)).cast("array<string>")
    return F.when(ids.isNotNull() | value.isNull(), ids).otherwise(broken)


def malformed_lists(state_entries: DataFrame) -> DataFrame:
    """D2's error rows: ``(deployment_id, state_key)`` of id lists whose text
    is no JSON list."""
    lists = state_entries.where(F.col("state_key").isin(LIST_KEYS) & F.col("state_value").isNotNull())
    return lists.where(F.from_json("state_value", "array<string>").isNull()).select("deployment_id", "state_key")


# -- D1, D2 -----------------------------------------------------------------------

def missing_prerequisites(state_entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The first absent of the load balancer's prerequisites."""
    return first_absent(ids, state_entries, LB_PREREQUISITES, key_col="state_key")


def instances_to_terminate(state_entries: DataFrame) -> DataFrame:
    """``(deployment_id, step, pos, instance_id)``: workers, cws1, cws2,
    then main, each list in its saved order; absent keys give nothing. A
    filter and a generator, no shuffle; ``(step, pos)`` is the wait order."""
    step = None
    for s, k, _ in TERMINATE_KEYS:
        step = F.when(F.col("state_key") == k, F.lit(s)) if step is None else step.when(F.col("state_key") == k, s)
    ids = (F.when(F.col("state_key").isin(SINGLE_KEYS), F.array(F.col("state_value")))
           .otherwise(id_list(F.col("state_value"))))
    return (state_entries.where(F.col("state_key").isin([k for _, k, _ in TERMINATE_KEYS]))
            .select("deployment_id", step.alias("step"), F.posexplode(ids).alias("pos", "instance_id")))


def instances_or_errors(state_entries: DataFrame) -> DataFrame:
    """D2 with a column ``error``: a list whose text is no JSON list is a row
    of its deployment (``pos`` and ``instance_id`` null) instead of the end of
    the job for all."""
    step = case_lookup("state_key", {k: s for s, k, _ in TERMINATE_KEYS}, cast="int")
    ids = F.when(F.col("state_key").isin(SINGLE_KEYS), F.array(F.col("state_value"))).otherwise(F.from_json("state_value", "array<string>"))
    bad = ids.isNull() & F.col("state_value").isNotNull()
    row = "struct<pos:int,instance_id:string,error:string>"
    good = F.transform(ids, lambda x, i: F.struct(i.alias("pos"), x.alias("instance_id"), F.lit(None).cast("string").alias("error")).cast(row))
    error = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("instance_id"), F.lit("malformed list").alias("error")).cast(row))
    return (state_entries.where(F.col("state_key").isin([k for _, k, _ in TERMINATE_KEYS]))
            .select("deployment_id", step.alias("step"), F.inline(F.when(bad, error).otherwise(good))))


# -- per-deployment masks -----------------------------------------------------------

#: A JSON list that begins with a plain text and holds nothing but such texts: it parses, and is not empty.
PLAIN_LIST = r'^\["[ !#-\[\]-~]*"(?:,"[ !#-\[\]-~]*")*\]\z'


def _queued(key: Column, value: Column) -> Column:
    """True when the row adds at least one id to the wait list. Only lists that
    are not plain (:data:`PLAIN_LIST`) or empty are parsed for it."""
    plain = F.when(value == "[]", F.lit(False)).when(value.rlike(PLAIN_LIST), F.lit(True))
    return (F.when(key.isin(SINGLE_KEYS), F.lit(True))
            .when(key.isin(LIST_KEYS), plain.otherwise(F.coalesce(F.size(id_list(value)) > 0, F.lit(False))))
            .otherwise(F.lit(False)))


def teardown_masks(state_entries: DataFrame, outcomes: DataFrame | None = None, copartitioned: bool = False) -> DataFrame:
    """``(deployment_id, present, queued, ok)`` per deployment with state:
    bit i of ``present`` for the i-th known key, ``queued`` when some
    machine id is waited on, bit s of ``ok`` when step s succeeded.

    State and outcomes go through one aggregate, one exchange of partial
    results. ``copartitioned`` inputs (``sources.buckets``) are aggregated each
    where they lie and joined, without an exchange.

    ``outcomes`` may tell in a column ``listing_ok`` of the balancer group's
    step whether its interfaces could be listed. Where they could not, bit
    :data:`LISTING_BIT` of ``ok`` is set."""
    st = (state_entries.select(
        "deployment_id", _key_bit("state_key").alias("present"),
        _queued(F.col("state_key"), F.col("state_value")).alias("queued"),
        F.lit(0).cast("bigint").alias("ok"), F.lit(1).alias("has_state"))
        .where(F.col("present").isNotNull()))
    rows = st
    if outcomes is not None:
        bits = F.when(F.coalesce(F.col("ok"), F.lit(False)), F.expr("shiftleft(CAST(1 AS BIGINT), step)")).otherwise(0)
        if "listing_ok" in outcomes.columns:
            stopped = (F.col("step") == LISTING_STEP) & ~F.coalesce(F.col("listing_ok"), F.lit(True))
            bits = bits.bitwiseOR(F.when(stopped, F.lit(1 << LISTING_BIT).cast("bigint")).otherwise(0))
        oc = outcomes.select(
            "deployment_id", F.lit(0).cast("bigint").alias("present"), F.lit(False).alias("queued"),
            bits.cast("bigint").alias("ok"), F.lit(0).alias("has_state")).where(F.col("ok") != 0)
        if copartitioned:
            marks = st.groupBy("deployment_id").agg(F.bit_or("present").alias("present"), F.bool_or("queued").alias("queued"))
            told = oc.groupBy("deployment_id").agg(F.bit_or("ok").alias("ok"))
            return marks.join(told.hint("shuffle_hash"), "deployment_id", "left").select(
                "deployment_id", "present", "queued", F.coalesce("ok", F.lit(0).cast("bigint")).alias("ok"))
        rows = st.unionByName(oc)
    return (rows.groupBy("deployment_id")
            .agg(F.bit_or("present").alias("present"), F.bool_or("queued").alias("queued"),
                 F.bit_or("ok").alias("ok"), F.max("has_state").alias("has_state"))
            .where(F.col("has_state") == 1).drop("has_state"))


def _has_all(mask: int) -> str:
    return f"((`present` & {mask}L) = {mask}L)"


def _runs(guard) -> str:
    """SQL condition under which a step runs, over ``present``/``queued``."""
    return "`queued`" if guard is None else _has_all(_mask_of(guard))


#: The listing of interfaces in this step is outside the step's own error
#: handling: where it fails, the teardown ends there and saves nothing.
LISTING_STEP = 9
LISTING_BIT = 20
_LISTING_GUARD = next(guard for step, guard, _, _ in TEARDOWN_STEPS if step == LISTING_STEP)
#: SQL condition under which a teardown ends at the listing.
_ABORTED = f"((`ok` & {1 << LISTING_BIT}L) <> 0 AND {_runs(_LISTING_GUARD)})"


def aborted() -> Column:
    """Whether the teardown ended at the listing of interfaces, over the
    columns of :func:`teardown_masks`."""
    return F.expr(_ABORTED)


def _removed_sql(before: int | None = None) -> str:
    """Bits of the keys that successful steps delete, or those ``before`` a step."""
    terms = []
    for step, guard, removes, _ in TEARDOWN_STEPS:
        if before is not None and step >= before:
            continue
        runs = f"({_runs(guard)} AND (`ok` & {1 << step}L) <> 0)"
        for j in range(len(removes)):
            bit = 1 << KEY_BIT[removes[j]]
            terms.append(f"CASE WHEN {runs} AND {_has_all(_mask_of(removes[: j + 1]))} THEN {bit}L ELSE 0L END")
    return " | ".join(terms)


_REMOVED = _removed_sql()


def removed_mask() -> Column:
    """Keys deleted by successful steps, over the columns ``present``,
    ``queued`` and ``ok``. A step deletes its keys in order and stops at
    the first absent one (the deletion raises there), so key j of a step
    goes only when keys 1..j are all present."""
    return F.expr(_REMOVED)


def _plan_sql(ran: bool = False) -> str:
    """Steps whose guard holds; ``ran``: without those after an abort."""
    rows = []
    for st, g, _, a in TEARDOWN_STEPS:
        after = f" AND NOT {_ABORTED}" if ran and st > LISTING_STEP else ""
        rows.append(f"CASE WHEN {_runs(g)}{after} THEN {struct_sql({'step': str(st), 'action': sql_literal(a)})} END")
    return "array_compact(array(" + ", ".join(rows) + "))"


_PLAN_STEPS = _plan_sql()


# -- D3, D4, D5 -------------------------------------------------------------------------

def teardown_plan(state_entries: DataFrame) -> DataFrame:
    """D3: ``(deployment_id, step, action)`` for the steps whose guard holds,
    in execution order. Guards read the input state only: no step removes
    another step's guard key, so one pass suffices."""
    m = teardown_masks(state_entries)
    return m.select("deployment_id", F.inline(F.expr(_PLAN_STEPS)))


def steps_run(state_entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """D3 with outcomes: the steps that the teardown came to. Where the listing
    of interfaces failed, its step is the last."""
    m = teardown_masks(state_entries, outcomes)
    return m.select("deployment_id", F.inline(F.expr(_plan_sql(ran=True))))


def stale_keys(state_entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(deployment_id, state_key)``: keys that a teardown which ended at the
    listing still records, since it saved nothing, though steps before the
    listing had deleted what they name."""
    m = teardown_masks(state_entries, outcomes).where(aborted())
    gone = m.select("deployment_id", F.expr(_removed_sql(before=LISTING_STEP)).alias("gone"))
    names = "array_compact(array(" + ", ".join(
        f"CASE WHEN (`gone` & {1 << i}L) <> 0 THEN {sql_literal(k)} END" for k, i in KEY_BIT.items()) + "))"
    return gone.select("deployment_id", F.explode(F.expr(names)).alias("state_key"))


def teardown_result(state_entries: DataFrame, outcomes: DataFrame, copartitioned: bool = False) -> DataFrame:
    """Per deployment: masks plus ``removed`` and ``left`` (present and not
    removed). A teardown that ended at the listing of interfaces saved
    nothing: the record is still the input record, so nothing is removed."""
    m = teardown_masks(state_entries, outcomes, copartitioned)
    removed = removed_mask()
    if "listing_ok" in outcomes.columns:
        removed = F.when(aborted(), F.lit(0).cast("bigint")).otherwise(removed)
    return (m.withColumn("removed", removed)
            .withColumn("left", F.col("present").bitwiseAND(F.bitwise_not(F.col("removed")))))


def residual_state(state_entries: DataFrame, outcomes: DataFrame, copartitioned: bool = False) -> DataFrame:
    """The state rows still saved after teardown. Unknown keys carry no
    bit and are never touched. The state is read twice: for the masks and
    for its rows. Over ``copartitioned`` tables there is no exchange.

    The state rows are looked up in a hash table of the one row a deployment
    that the masks are, partition by partition, so they are not sorted."""
    res = teardown_result(state_entries, outcomes, copartitioned).select("deployment_id", "removed")
    zero = F.lit(0).cast("bigint")
    rows = state_entries.select("deployment_id", "state_key", "state_value",
                                F.coalesce(_key_bit("state_key"), zero).alias("bit"))
    return (rows.join(res.hint("shuffle_hash"), "deployment_id", "left")
            .where(F.coalesce(F.col("removed"), zero).bitwiseAND(F.col("bit")) == 0)
            .select("deployment_id", "state_key", "state_value"))


def leaks(state_entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(deployment_id, leaked, leaked_keys)`` for deployments where
    cloud resources (not addresses or names) are still recorded after
    teardown, from the per-deployment masks (no join)."""
    r = teardown_result(state_entries, outcomes)
    left = F.col("left").bitwiseAND(F.lit(RESOURCE_MASK))
    return (r.select("deployment_id", F.bit_count(left).cast("int").alias("leaked"),
                     F.expr(_LEAKED_NAMES).alias("leaked_keys"))
            .where(F.col("leaked") > 0))


_LEAKED_NAMES = "array_compact(array(" + ", ".join(
    f"CASE WHEN (`left` & {1 << i}L) <> 0 THEN {sql_literal(k)} END"
    for k, i in KEY_BIT.items() if (RESOURCE_MASK >> i) & 1) + "))"


def leak_counts(residual: DataFrame) -> DataFrame:
    """D5 from residual rows: resource keys left per deployment."""
    return (residual.where(F.col("state_key").isin([k for k in STATE_KEY_NAMES if k not in NON_RESOURCE_KEYS]))
            .groupBy("deployment_id").agg(F.count("*").cast("int").alias("leaked")))


def top_leaks(leaked: DataFrame, k: int = 20) -> DataFrame:
    """Top-k deployments by leaked resources (ties by id): each partition
    keeps its k best, then one merge."""
    return leaked.orderBy(F.col("leaked").desc(), F.col("deployment_id")).limit(k)


# -- D6, D7, A5 -----------------------------------------------------------------------

def effective_state(memory: DataFrame, saved: DataFrame) -> DataFrame:
    """The in-memory record where there is one, else the saved one. The
    memory ids are made distinct first (partial aggregate), then an anti
    join keeps saved rows of other deployments, which are not sorted for it:
    they are looked up in a hash table of a partition's ids."""
    mem_ids = memory.select("deployment_id").distinct()
    return memory.unionByName(saved.join(mem_ids.hint("shuffle_hash"), "deployment_id", "left_anti"))


def select_instances(instances: DataFrame, ids: DataFrame, on=("deployment_id", "instance_id")) -> DataFrame:
    """Machines whose id is in the id list (a semi join)."""
    return instances.join(ids.select(*on).distinct(), list(on), "left_semi")


def interfaces_in_group(interface_groups: DataFrame, state_entries: DataFrame) -> DataFrame:
    """A5: network interfaces carrying each deployment's LB security group."""
    groups = (state_entries.where(F.col("state_key") == "lb_security_group_id")
              .select("deployment_id", F.col("state_value").alias("group_id")))
    return groups.join(interface_groups, "group_id").select("deployment_id", "ni_id").distinct()


def planned_state(requests: DataFrame) -> DataFrame:
    """The record a configuration run keeps in memory: the four address
    keys computed from the request (JSON lists as text)."""
    from . import planning as B
    ips = B.request_ips()
    rows = F.array(
        F.struct(F.lit("main_instance_ip").alias("state_key"), F.lit(MAIN_IP).alias("state_value")),
        F.struct(F.lit("workers_instance_ips").alias("state_key"), F.to_json(ips["workers"]).alias("state_value")),
        F.struct(F.lit("cws1_instance_ips").alias("state_key"), F.to_json(ips["cws1"]).alias("state_value")),
        F.struct(F.lit("cws2_instance_ips").alias("state_key"), F.to_json(ips["cws2"]).alias("state_value")),
    )
    return requests.select("deployment_id", F.inline(rows))


def deployed_state(requests: DataFrame, observed: DataFrame) -> DataFrame:
    """The address keys of the record a deployment run saves: those of
    :func:`planned_state` and ``instances_ips``, the observed address pairs
    of all machines in launch order (null where none is observed). The
    collected group is one deployment's list."""
    from . import planning as B
    pair = F.concat(F.lit('{"public":'), F.coalesce(json_string(F.col("public_ip")), F.lit("null")), F.lit(',"private":'),
                    F.coalesce(json_string(F.col("observed_private_ip")), F.lit("null")), F.lit("}"))
    lists = (B.attach_addresses(B.expand_instances(requests), observed).groupBy("deployment_id")
             .agg(F.sort_array(F.collect_list(F.struct("launch_pos", pair.alias("pair")))).alias("ps")))
    text = F.concat(F.lit("["), F.array_join(F.col("ps")["pair"], ","), F.lit("]"))
    return planned_state(requests).unionByName(
        lists.select("deployment_id", F.lit("instances_ips").alias("state_key"), text.alias("state_value")))
