"""The state record as a log of changes (A1, A2).

The deployment tool assigns and deletes keys of one record while it runs. Here
each assignment and deletion is a row

    (deployment_id, change_no, state_key, op, state_value)

with ``op`` ``set`` or ``remove``, numbered in the order of the runs and of the
statements in a run. A record is the fold of its changes: of each key the last
change counts, and a key whose last change is a removal is not in the record.

Order, stated once: a change is later than another of the same key if its
``change_no`` is greater; between equal numbers a removal is later than an
assignment, and of two assignments the one with the greater value (a null
value before all others).

Folding is one aggregate with partial results, so of a key changed very often
each task sends one row on, and folded changes may be folded again with later
ones (:func:`latest_changes` is its own merge): that is what compaction does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STATE_KEYS, TEARDOWN_STEPS
from ..functions.columns import case_lookup, sql_literal, struct_sql
from . import state as D

SET, REMOVE = "set", "remove"
COLUMNS = ["deployment_id", "change_no", "state_key", "op", "state_value"]
#: Change numbers that a run has to itself: run r has r * RUN .. r * RUN + RUN - 1.
RUN = 1_000
#: Places of a step's removals within a run: step * STEP + position.
STEP = 10


def _place(key: str = "state_key") -> Column:
    """Where a run assigns a key: the keys' recording order, unknown ones last."""
    return case_lookup(key, {k: i for i, (k, _) in enumerate(STATE_KEYS)}, default=len(STATE_KEYS), cast="bigint")


def assignments(state_entries: DataFrame, run: int) -> DataFrame:
    """The changes of run ``run`` that assigns the given state rows, in the
    order in which the tool records its keys."""
    return state_entries.select("deployment_id", (F.lit(run * RUN).cast("bigint") + _place()).alias("change_no"), "state_key",
                                F.lit(SET).alias("op"), "state_value")


def _removals_sql(run: int) -> str:
    rows = []
    for step, _, removes, _ in TEARDOWN_STEPS:
        for j, key in enumerate(removes):
            row = struct_sql({"change_no": f"{run * RUN + step * STEP + j}L", "state_key": sql_literal(key)})
            rows.append(f"CASE WHEN (`removed` & {1 << D.KEY_BIT[key]}L) <> 0 THEN {row} END")
    return "array_compact(array(" + ", ".join(rows) + "))"


def teardown_removals(state_entries: DataFrame, outcomes: DataFrame, run: int) -> DataFrame:
    """The changes of run ``run`` that tears the given records down: a removal
    for every key that a successful step deletes (D4), by step and position.
    Made of the one row a deployment that D4 works on; no join back."""
    gone = D.teardown_result(state_entries, outcomes).where("removed <> 0")
    return gone.select("deployment_id", F.inline(F.expr(_removals_sql(run)))).select(
        "deployment_id", "change_no", "state_key", F.lit(REMOVE).alias("op"), F.lit(None).cast("string").alias("state_value"))


def latest_changes(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """The last change of every key, removals included (COLUMNS); ``upto``
    leaves out changes with a greater number."""
    if upto is not None:
        changes = changes.where(F.col("change_no") <= upto)
    # Known keys travel as their number, so tasks sort, compare and send less.
    known = F.array(*[F.lit(k) for k, _ in STATE_KEYS])
    place = _place()
    rows = changes.select("deployment_id", place.cast("tinyint").alias("place"), F.when(place == len(STATE_KEYS), F.col("state_key")).alias("unknown"),
                          "change_no", (F.col("op") == REMOVE).alias("removes"), "state_value", "op")
    last = rows.groupBy("deployment_id", "place", "unknown").agg(F.max(F.struct("change_no", "removes", "state_value", "op")).alias("c"))
    key = F.coalesce(F.get(known, F.col("place").cast("int")), F.col("unknown"))
    return last.select("deployment_id", "c.change_no", key.alias("state_key"), "c.op", "c.state_value")


def fold_changes(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """The records ``(deployment_id, state_key, state_value)`` that the changes
    leave, after all of them or after change ``upto``."""
    return latest_changes(changes, upto).where(F.col("op") == SET).select("deployment_id", "state_key", "state_value")


def changed_deployments(changes: DataFrame) -> DataFrame:
    """The deployments with changes: those that have a record, if an empty one."""
    return changes.select("deployment_id").distinct()
