"""Configuration operators (C1-C10): merge user overrides, forced values and
defaults into the two configuration documents of every deployment.

Values travel as JSON text (``value`` columns hold the JSON encoding), so
strings, numbers, booleans, lists and JSON null share one long table and
"absent" (no row) stays distinct from "null" (a row holding ``null``).

Plan shape, per fleet:

* forced keys come from the request row (a generator, no shuffle) and win by
  a filter on the fixed key list, not a join;
* user rows are kept to accepted deployments by a semi join on the id;
  forced rows are generated for accepted deployments only;
* ONE aggregate on ``deployment_id`` gives the per-deployment facts: a bit
  per known key present (``bit_or``; forced keys are present by
  construction) and the nine values the database URL and ranking document
  read (conditional ``max``). Accepted ids enter as marker rows, so this
  branch needs no join; the partial aggregate runs map-side, so a
  deployment with many rows reaches the reducer as one row per map
  partition;
* defaults are generated only for absent keys, from the fact row (a CASE
  per key, no merge with the user rows), and the URL comes from the same
  row; user rows pass through typed, unknown keys unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CONFIG_KEYS, DATABASE_URL_PARTS, FORCED_ADMIN_LISTEN_PORT, FORCED_CONFIG_KEYS, FORCED_NUM_PROXIES, MASK,
    MASKED_KEYS, RANKING_BIND_ADDRESS, RANKING_FIELDS, REQUIRED_CONFIG_KEYS, SECRET_KEYS,
)
from ..functions.columns import bound, case_lookup, config_int_text, json_string, json_value, py_str, sql_literal, strict_bool, struct_sql
from . import planning as B

KNOWN_KEYS = [k for k, _, _ in CONFIG_KEYS]
PIVOT_KEYS = DATABASE_URL_PARTS + [src for _, src in RANKING_FIELDS if src]
MISSING_REQUIRED = "missing required key"
INVALID_INTEGER = "invalid integer"
INVALID_VALUE = "invalid value"


# -- inputs -------------------------------------------------------------------------

def latest_overrides(overrides: DataFrame) -> DataFrame:
    """One row a key of overrides that were set one after the other: the row
    with the greatest ``set_no`` counts, as the last assignment to a dictionary
    key does (between equal numbers the one with the greatest texts). One
    aggregate with partial results."""
    rest = [c for c in overrides.columns if c not in ("deployment_id", "key", "set_no")]
    last = overrides.groupBy("deployment_id", "key").agg(F.max(F.struct("set_no", *rest)).alias("r"))
    return last.select("deployment_id", "key", *[F.col(f"r.{c}").alias(c) for c in rest])


def overrides_json(overrides: DataFrame) -> DataFrame:
    """User overrides as JSON text. A string override is ``(deployment_id,
    key, value)``; a typed one (number, list, object, boolean, null) has its
    JSON in the optional column ``value_json``, which wins where it is not
    null. Text there that is not one JSON value gives a null ``value``: the row
    stays, and its deployment gets the error :data:`INVALID_VALUE` instead of
    a document that does not parse.

    With a column ``set_no``, repeated rows of a key are resolved by it
    (:func:`latest_overrides`); without it a key has one row."""
    if "set_no" in overrides.columns:
        overrides = latest_overrides(overrides)
    value = _override_json(F.col("value"), F.col("value_json") if "value_json" in overrides.columns else None)
    return overrides.select("deployment_id", "key", value.alias("value"))


def _override_json(value: Column, given: Column | None) -> Column:
    """The JSON text of an override (:func:`overrides_json`)."""
    text = json_string(value)
    return text if given is None else F.when(given.isNotNull(), json_value(given)).otherwise(text)


#: Request columns the forced values are computed from.
COUNTS = ["nb_workers_instances", "nb_workers_per_instance", "nb_cws_instances", "nb_cws_per_instance"]


def _forced_values() -> dict[str, Column]:
    """C5 values over the request columns :data:`COUNTS`."""
    addrs, ports = B.listen_arrays()
    return {
        "core_services": B.endpoints_json("core"), "other_services": B.endpoints_json("other"),
        "contest_listen_address": F.to_json(addrs), "contest_listen_port": F.to_json(ports),
        "num_proxies_used": F.lit(str(FORCED_NUM_PROXIES)), "admin_listen_port": F.lit(str(FORCED_ADMIN_LISTEN_PORT)),
    }


def forced_config(requests: DataFrame) -> DataFrame:
    """C5 values: the six keys the planner always sets, from the request row."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in _forced_values().items()])
    return B.accepted_requests(requests).select("deployment_id", F.inline(rows))


def apply_forced(user: DataFrame, requests: DataFrame) -> DataFrame:
    """Forced keys replace the user's, for accepted deployments (a
    rejected request stops before any configuration). The forced key list is
    fixed, so dropping the user's copies is a filter, and the merge is a
    union."""
    kept = (user.where(~F.col("key").isin(FORCED_CONFIG_KEYS))
            .join(B.accepted_requests(requests).select("deployment_id"), "deployment_id", "left_semi"))
    return kept.unionByName(forced_config(requests))


# -- presence checks (C1, C10, and D1 reuse the same shape) ----------------------------

def presence_mask(ids: DataFrame, entries: DataFrame, keys: list[str], key_col: str = "key") -> DataFrame:
    """``(deployment_id, present)``: bit i set when ``keys[i]`` has a row.

    The ids and the matching rows are unioned and merged by one aggregate on
    ``deployment_id``; ``bit_or`` has a map-side partial, so a deployment
    with many rows collapses before the shuffle. Only deployments in
    ``ids`` are returned."""
    bit = case_lookup(key_col, {k: 1 << i for i, k in enumerate(keys)}, cast="bigint")
    rows = entries.where(F.col(key_col).isin(keys)).select(
        "deployment_id", bit.alias("bit"), F.lit(0).alias("is_id"))
    base = ids.select("deployment_id", F.lit(0).cast("bigint").alias("bit"), F.lit(1).alias("is_id"))
    return (base.unionByName(rows).groupBy("deployment_id")
            .agg(F.bit_or("bit").alias("present"), F.max("is_id").alias("is_id"))
            .where(F.col("is_id") == 1).drop("is_id"))


def absent_keys_array(present: Column, keys: list[str]) -> Column:
    """Keys whose bit is not set, in list order."""
    return F.array_compact(F.array(*[
        F.when(present.bitwiseAND(F.lit(1 << i)) == 0, F.lit(k)) for i, k in enumerate(keys)]))


def first_absent(ids: DataFrame, entries: DataFrame, keys: list[str], key_col: str = "key") -> DataFrame:
    """``(deployment_id, first_missing)`` for the ids that lack any of
    ``keys``; the first in list order is reported."""
    m = presence_mask(ids, entries, keys, key_col)
    return (m.select("deployment_id", F.get(absent_keys_array(F.col("present"), keys), 0).alias("first_missing"))
            .where(F.col("first_missing").isNotNull()))


def missing_required(entries: DataFrame, ids: DataFrame, forced: bool = False) -> DataFrame:
    """The first absent of core_services, other_services, db_passwd.
    ``forced``: the deployments get their forced keys, which are then present
    without a row, so only the user's entries are read."""
    keys = [k for k in REQUIRED_CONFIG_KEYS if not (forced and k in FORCED_CONFIG_KEYS)]
    return first_absent(ids, entries, keys)


def generated_secrets(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """``(deployment_id, key)`` for each secret the deployment tool would
    have to generate because the user gave none. Nothing is generated."""
    m = presence_mask(ids, entries, SECRET_KEYS)
    return m.select("deployment_id", F.explode(absent_keys_array(F.col("present"), SECRET_KEYS)).alias("key"))


# -- C2, C3, C4 -------------------------------------------------------------------

KIND_OF = {k: kind for k, _, kind in CONFIG_KEYS}
KEY_MASK = {k: 1 << i for i, (k, _, _) in enumerate(CONFIG_KEYS)}


def _lookup(key: str, table: dict, cast: str | None = None) -> Column:
    return case_lookup(key, table, cast=cast)


def _absent_defaults_sql(present: str) -> str:
    items = []
    for k, d, kind in CONFIG_KEYS:
        row = struct_sql({"key": sql_literal(k), "kind": sql_literal(kind),
                          "value": f"CAST({sql_literal(d)} AS STRING)"})
        items.append(f"CASE WHEN (`{present}` & {sql_literal(KEY_MASK[k])}) = 0 THEN {row} END")
    return "array_compact(array(" + ", ".join(items) + "))"


_ABSENT_DEFAULTS = _absent_defaults_sql("present")


def _absent_defaults(present: str = "present") -> Column:
    """Default rows of the known keys whose bit is not set in column
    ``present`` (a CASE per key inside one array, all code-generated)."""
    return F.expr(_ABSENT_DEFAULTS if present == "present" else _absent_defaults_sql(present))


def in_scope(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the deployments in ``ids`` (a semi join on the id)."""
    return entries.join(ids.select("deployment_id"), "deployment_id", "left_semi")


def config_facts(entries: DataFrame, ids: DataFrame, base_mask: int = 0) -> DataFrame:
    """One row per deployment in ``ids``: ``present``, a bit per known key
    given, and the raw values of the keys the database URL and ranking
    document read (null when absent). ``base_mask`` marks keys present by
    construction (the forced keys when ``entries`` holds user rows only).

    Rows of deployments outside ``ids`` may be in ``entries``: the ids join
    the aggregate as marker rows and only marked groups are kept, so no join
    is needed. One aggregate on ``deployment_id`` whose partial aggregate
    runs map-side."""
    known = entries.where(F.col("key").isin(KNOWN_KEYS))
    rows = known.select("deployment_id", _lookup("key", KEY_MASK, "bigint").alias("bit"),
                        *[F.when(F.col("key") == k, F.col("value")).alias(k) for k in PIVOT_KEYS],
                        F.lit(0).alias("is_id"))
    base = ids.select("deployment_id", F.lit(base_mask).cast("bigint").alias("bit"),
                      *[F.lit(None).cast("string").alias(k) for k in PIVOT_KEYS], F.lit(1).alias("is_id"))
    return (base.unionByName(rows).groupBy("deployment_id")
            .agg(F.bit_or("bit").alias("present"), *[F.max(k).alias(k) for k in PIVOT_KEYS],
                 F.max("is_id").alias("is_id"))
            .where(F.col("is_id") == 1).drop("is_id"))


def fill_defaults_scoped(scoped: DataFrame, facts: DataFrame) -> DataFrame:
    """C2 given :func:`config_facts`: the user's known rows as they are, plus
    one default row for each known key the deployment lacks (a generator
    over the catalogue, filtered by the presence bits; no merge)."""
    user = (scoped.where(F.col("key").isin(KNOWN_KEYS))
            .select("deployment_id", "key", _lookup("key", KIND_OF).alias("kind"), "value",
                    F.lit(True).alias("present")))
    defaults = (facts.select("deployment_id", F.inline(_absent_defaults("present")))
                .select("deployment_id", "key", "kind", "value", F.lit(False).alias("present")))
    return user.unionByName(defaults)


def fill_defaults(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Every known key of every deployment in ``ids``: the user's value
    when the key is present (an explicit null included), else the default.

    ``(deployment_id, key, kind, value, present)``; ``value`` is null only
    for a required or secret key that is absent."""
    return fill_defaults_scoped(in_scope(entries, ids), config_facts(entries, ids))


def typed_value(kind: Column, value: Column) -> Column:
    """C3/C4 applied by kind, as JSON text: booleans are strict, integers go
    through ``int()`` semantics, whatever their length (null when malformed)."""
    return (F.when(kind == "bool", F.when(strict_bool(value), "true").otherwise("false"))
            .when(kind == "int", config_int_text(value))
            .otherwise(value))


def _output_value(key: Column, kind: Column, value: Column) -> Column:
    """The value written for a key: ``rankings`` is always the empty list,
    other keys are typed by kind."""
    return F.when(key == "rankings", F.lit("[]")).otherwise(typed_value(kind, value))


def _error_rank(error: Column) -> Column:
    """The generator stops at the first failing statement: a missing
    required key is read before any integer is converted."""
    return F.when(error.isNotNull(), F.struct(F.when(error == MISSING_REQUIRED, 0).otherwise(1).alias("r"),
                                               error.alias("e")))


def _mask(key: Column, value: Column, mask: bool) -> Column:
    if not mask:
        return value
    return F.when(key.isin(MASKED_KEYS) & value.isNotNull(), F.lit(f'"{MASK}"')).otherwise(value)


def known_entries(filled: DataFrame, mask: bool = True) -> DataFrame:
    """Keys as written to the main document, with an ``error`` for a
    missing required key, a value that is no JSON or a malformed integer. Local keys (database and
    ranking parts) and secrets are written only when the user gave them;
    ``database`` comes from :func:`database_url`; ``rankings`` is always
    the empty list. Rows with no ``kind`` (unknown keys) pass as they are."""
    kind, key, present = F.col("kind"), F.col("key"), F.col("present")
    value = _output_value(key, kind, F.col("value"))
    emit = (kind.isNull() | kind.isin("raw", "bool", "int", "required")
            | (kind.isin("local", "secret") & present)
            | (key == "rankings"))
    error = (F.when((kind == "required") & ~present, F.lit(MISSING_REQUIRED))
             .when(present & F.col("value").isNull(), F.lit(INVALID_VALUE))
             .when((kind == "int") & value.isNull(), F.lit(INVALID_INTEGER)))
    return filled.where(emit).select("deployment_id", "key", _mask(key, value, mask).alias("value"),
                                     error.alias("error"))


# -- C7, C8 ---------------------------------------------------------------------------

def config_parts(facts: DataFrame, keep=()) -> DataFrame:
    """One row per deployment with the values the URL and ranking document
    need: the user's value, else the default (null for a required or secret
    key that is absent)."""
    defaults = {k: d for k, d, _ in CONFIG_KEYS}
    return facts.select("deployment_id", *keep, *[
        F.coalesce(F.col(k), F.lit(defaults[k]).cast("string")).alias(k) for k in PIVOT_KEYS])


def parts_for(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """:func:`config_parts` straight from merged entries and ids."""
    return config_parts(config_facts(entries, ids))


def _database_url_expr(mask: bool) -> Column:
    """The URL over the columns of :func:`config_parts`."""
    pw = F.col("db_passwd")
    pw_text = F.when(pw.isNotNull(), F.lit(MASK)) if mask else py_str(pw)
    return F.concat(F.lit("postgresql+psycopg2://"), py_str(F.col("db_user")), F.lit(":"), pw_text, F.lit("@"),
                    py_str(F.col("db_host")), F.lit(":"), py_str(F.col("db_port")), F.lit("/"),
                    py_str(F.col("db_name")))


def database_url(parts: DataFrame, mask: bool = True) -> DataFrame:
    """``postgresql+psycopg2://u:pw@h:p/n`` from the filled values;
    null when the password is missing (the generator fails there)."""
    return parts.select("deployment_id", _database_url_expr(mask).alias("database"))


def ranking_document(parts: DataFrame, mask: bool = True) -> DataFrame:
    """``(deployment_id, key, value)`` of the ranking document; an absent
    password is one the tool would generate, so it is null here (C10)."""
    fields = []
    for name, src in RANKING_FIELDS:
        v = F.lit(RANKING_BIND_ADDRESS) if src is None else F.col(src)
        if src in MASKED_KEYS:
            v = _mask(F.lit(src), v, mask)
        fields.append(F.struct(F.lit(name).alias("key"), v.alias("value")))
    return parts.select("deployment_id", F.inline(F.array(*fields)))


# -- C6, C9 -------------------------------------------------------------------------

def passthrough_keys(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys the generator does not know are kept as given."""
    return in_scope(entries.where(~F.col("key").isin(KNOWN_KEYS)), ids)


def resolved_facts(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """:func:`config_facts` of the accepted deployments, whose forced keys are
    there without being computed: what the URL and the ranking document need."""
    ids = B.accepted_requests(requests).select("deployment_id")
    user = overrides_json(overrides).where(~F.col("key").isin(FORCED_CONFIG_KEYS))
    return config_facts(user, ids, base_mask=sum(KEY_MASK[k] for k in FORCED_CONFIG_KEYS))


#: A configuration row while it is put together; an unknown key has no ``kind``.
_ENTRY = "array<struct<key:string,kind:string,value:string,present:boolean>>"
#: A row of the main document.
_WRITTEN = "array<struct<key:string,value:string,error:string>>"


def deployment_configs(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row per accepted deployment: ``present``, the URL and ranking parts
    given, the request's counts, and ``items``, its override rows ``(key,
    value, kind)`` by key without the forced ones, each key once. The kind is
    looked up here, once an override row, and not for every generated row.

    Requests (a marker row each) and overrides go through one aggregate, read
    once each; the collected group is one deployment's configuration."""
    acc = B.accepted_requests(requests)
    key, value = F.col("key"), F.col("value")
    rows = overrides_json(overrides).where(~key.isin(FORCED_CONFIG_KEYS))
    marked = rows.select("deployment_id", _lookup("key", KEY_MASK, "bigint").alias("bit"), *[F.when(key == k, value).alias(k) for k in PIVOT_KEYS],
                         F.struct("key", "value", _lookup("key", KIND_OF).alias("kind")).alias("item"), F.lit(0).alias("is_id"), *[F.lit(None).cast("int").alias(c) for c in COUNTS])
    forced_mask = sum(KEY_MASK[k] for k in FORCED_CONFIG_KEYS)
    base = acc.select("deployment_id", F.lit(forced_mask).cast("bigint").alias("bit"), *[F.lit(None).cast("string").alias(k) for k in PIVOT_KEYS],
                      F.lit(None).cast("struct<key:string,value:string,kind:string>").alias("item"), F.lit(1).alias("is_id"), *COUNTS)
    agg = (base.unionByName(marked).groupBy("deployment_id")
           .agg(F.bit_or("bit").alias("present"), *[F.max(k).alias(k) for k in [*PIVOT_KEYS, *COUNTS]],
                F.sort_array(F.collect_list("item")).alias("items"), F.max("is_id").alias("is_id"))
           .where(F.col("is_id") == 1).drop("is_id"))
    once = F.filter("items", lambda x, i: (i == F.size("items") - 1) | (F.get("items", i + 1)["key"] != x["key"]))
    return agg.withColumn("items", once)


def _given_and_forced(kinds: tuple[str, ...] | None = None) -> Column:
    """The override and forced rows of a deployment, over the columns of
    :func:`deployment_configs`; only keys of ``kinds``, if given."""
    yes = F.lit(True)
    items = F.col("items") if kinds is None else F.filter("items", lambda x: x["kind"].isin(*kinds))
    given = F.transform(items, lambda x: F.struct(x["key"].alias("key"), x["kind"].alias("kind"), x["value"].alias("value"), yes.alias("present")))
    forced = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(KIND_OF[k]).alias("kind"), v.alias("value"), yes.alias("present"))
                       for k, v in _forced_values().items() if kinds is None or KIND_OF[k] in kinds])
    return F.concat(given.cast(_ENTRY), forced.cast(_ENTRY))


def _defaults() -> Column:
    defaults = F.transform(_absent_defaults(), lambda x: F.struct(
        x["key"].alias("key"), x["kind"].alias("kind"), x["value"].alias("value"), F.lit(False).alias("present")))
    return defaults.cast(_ENTRY)


def _written_defaults_sql() -> str:
    """Rows of the absent keys as the main document has them: constants, for
    keys that are written while absent, and an error for each that must be
    there."""
    items = []
    for k, d, kind in CONFIG_KEYS:
        text = _default_text(k, d, kind)
        if text is None and kind != "required":
            continue
        row = struct_sql({"key": sql_literal(k), "value": f"CAST({sql_literal(text)} AS STRING)",
                          "error": f"CAST({sql_literal(MISSING_REQUIRED if text is None else None)} AS STRING)"})
        items.append(f"CASE WHEN (`present` & {sql_literal(KEY_MASK[k])}) = 0 THEN {row} END")
    return "array_compact(array(" + ", ".join(items) + "))"


def _written_items(mask: bool) -> Column:
    """The override rows as the main document has them (:func:`known_entries`
    of rows that are there)."""
    kept = F.filter("items", lambda x: x["kind"].isNull() | (x["kind"] != "computed") | (x["key"] == "rankings"))

    def row(x: Column) -> Column:
        key, kind, given = x["key"], x["kind"], x["value"]
        value = _output_value(key, kind, given)
        error = F.when(given.isNull(), F.lit(INVALID_VALUE)).when((kind == "int") & value.isNull(), F.lit(INVALID_INTEGER))
        return F.struct(key.alias("key"), _mask(key, value, mask).alias("value"), error.alias("error"))

    return F.transform(kept, row).cast(_WRITTEN)


def filled_config(requests: DataFrame, overrides: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """C2 for the merged (forced and user) entries of accepted deployments,
    from :func:`deployment_configs`: as :func:`fill_defaults`. ``kinds``: only
    keys of these kinds, so that no other key's value is computed."""
    defaults = _defaults() if kinds is None else F.filter(_defaults(), lambda x: x["kind"].isin(*kinds))
    rows = deployment_configs(requests, overrides).select("deployment_id", F.inline(F.concat(_given_and_forced(kinds), defaults)))
    return rows.where(F.col("kind").isNotNull()).select("deployment_id", "key", "kind", "value", "present")


def config_entries(requests: DataFrame, overrides: DataFrame, mask: bool = True) -> DataFrame:
    """The main document of every accepted deployment in long form:
    ``(deployment_id, key, value, error)``.

    One generator over the row of :func:`deployment_configs`: the given rows
    (known keys typed, unknown keys passed through), the forced ones, the
    defaults of absent keys and the database URL. Every row comes out as it is
    written: only given rows are typed, before the generator, so nothing is
    looked up or converted for the many generated ones. Both inputs are read
    once and meet in one exchange; there is no join."""
    parts = config_parts(deployment_configs(requests, overrides), keep=("present", "items", *COUNTS))
    none = F.lit(None).cast("string").alias("error")
    forced = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), none) for k, v in _forced_values().items()]).cast(_WRITTEN)
    db = bound(_database_url_expr(mask), lambda u: F.struct(
        F.lit("database").alias("key"), F.when(u.isNotNull(), json_string(u)).alias("value"), none))
    db = F.filter(F.array(db), lambda x: x["value"].isNotNull()).cast(_WRITTEN)
    rows = parts.select("deployment_id", F.inline(F.concat(_written_items(mask), forced, F.expr(_WRITTEN_DEFAULTS).cast(_WRITTEN), db)))
    error = F.coalesce("error", F.when(F.col("value").isNull(), F.lit(INVALID_VALUE)))
    return rows.select("deployment_id", "key", "value", error.alias("error"))


def config_document(entries: DataFrame) -> DataFrame:
    """One JSON object per deployment, keys sorted; null with the first
    error when the generator would have failed. The group is one
    deployment's configuration, i.e. the document itself."""
    frag = F.concat(json_string(F.col("key")), F.lit(":"), F.col("value"))
    agg = entries.groupBy("deployment_id").agg(
        F.sort_array(F.collect_list(F.struct("key", frag.alias("frag")))).alias("items"),
        F.min(_error_rank(F.col("error")))["e"].alias("error"))
    doc = F.concat(F.lit("{"), F.array_join(F.col("items")["frag"], ","), F.lit("}"))
    return agg.select("deployment_id", F.when(F.col("error").isNull(), doc).alias("document"), "error")


def _default_text(key: str, default, kind: str) -> str | None:
    """The value a default contributes to the document, or None when the
    key is not written while absent (local, secret, required, database)."""
    if key == "rankings":
        return "[]"
    if kind in ("raw", "int"):
        return default
    if kind == "bool":
        return "true" if default == '"True"' else "false"
    return None


def _default_fragment(key: str, default, kind: str) -> str | None:
    """The text a default contributes to the document."""
    text = _default_text(key, default, kind)
    return None if text is None else f'"{key}":{text}'


_WRITTEN_DEFAULTS = _written_defaults_sql()
_DEFAULT_FRAGMENTS = "array_compact(array(" + ", ".join(
    f"CASE WHEN (`present` & {KEY_MASK[k]}L) = 0 THEN "
    f"{struct_sql({'key': sql_literal(k), 'frag': sql_literal(_default_fragment(k, d, kind))})} END"
    for k, d, kind in CONFIG_KEYS if _default_fragment(k, d, kind) is not None) + "))"
_REQUIRED_MASK = sum(KEY_MASK[k] for k in REQUIRED_CONFIG_KEYS)


def _fragment(key: Column, kind: Column, value: Column, mask: bool) -> tuple[Column, Column]:
    """What a given row adds to the document (null if it is not written), and its error."""
    out = _output_value(key, kind, value)
    emit = kind.isNull() | kind.isin("raw", "bool", "int", "required", "local", "secret") | (key == "rankings")
    frag = F.when(emit, F.struct(key.alias("key"), F.concat(json_string(key), F.lit(":"), _mask(key, out, mask))
                                 .alias("frag")))
    error = F.when(value.isNull(), F.lit(INVALID_VALUE)).when((kind == "int") & out.isNull(), F.lit(INVALID_INTEGER))
    return frag, error


def _document_facts(requests: DataFrame, overrides: DataFrame, mask: bool) -> DataFrame:
    """The aggregate of :func:`config_documents`: a row per accepted deployment."""
    acc = B.accepted_requests(requests)
    rows = overrides_json(overrides).where(~F.col("key").isin(FORCED_CONFIG_KEYS))
    key, value = F.col("key"), F.col("value")
    frag, error = _fragment(key, _lookup("key", KIND_OF), value, mask)
    marked = rows.select("deployment_id", _lookup("key", KEY_MASK, "bigint").alias("bit"),
                         *[F.when(key == k, value).alias(k) for k in PIVOT_KEYS],
                         frag.alias("frag"), error.alias("error"), F.lit(0).alias("is_id"),
                         *[F.lit(None).cast("int").alias(c) for c in COUNTS])
    forced_mask = sum(KEY_MASK[k] for k in FORCED_CONFIG_KEYS)
    base = acc.select("deployment_id", F.lit(forced_mask).cast("bigint").alias("bit"),
                      *[F.lit(None).cast("string").alias(k) for k in PIVOT_KEYS],
                      F.lit(None).cast("struct<key:string,frag:string>").alias("frag"),
                      F.lit(None).cast("string").alias("error"), F.lit(1).alias("is_id"), *COUNTS)
    return (base.unionByName(marked).groupBy("deployment_id")
           .agg(F.bit_or("bit").alias("present"), *[F.max(k).alias(k) for k in [*PIVOT_KEYS, *COUNTS]],
                F.collect_list("frag").alias("items"), F.min("error").alias("row_error"),
                F.max("is_id").alias("is_id"))
           .where(F.col("is_id") == 1))


def _repeated_document_facts(requests: DataFrame, overrides: DataFrame, mask: bool) -> DataFrame:
    """:func:`_document_facts` of overrides with ``set_no``. The rows of a
    deployment are collected as they were set, known keys as their number, and
    the last one of each key is found in its list (as in
    :func:`latest_overrides`), so rows are not sorted by key beforehand."""
    key = F.col("key")
    rest = [c for c in overrides.columns if c not in ("deployment_id", "key", "set_no")]
    place = _lookup("key", {k: i for i, k in enumerate(KNOWN_KEYS)}, "tinyint")
    item = F.struct(place.alias("o"), F.when(place.isNull(), key).alias("k"), "set_no", *rest)
    rows = overrides.where(~key.isin(FORCED_CONFIG_KEYS)).select("deployment_id", item.alias("item"), F.lit(0).alias("is_id"))
    base = B.accepted_requests(requests).select("deployment_id", F.lit(1).alias("is_id"), *COUNTS)
    agg = (base.unionByName(rows, allowMissingColumns=True).groupBy("deployment_id")
           .agg(*[F.max(k).alias(k) for k in COUNTS], F.sort_array(F.collect_list("item")).alias("sets"), F.max("is_id").alias("is_id"))
           .where(F.col("is_id") == 1))
    sets = F.col("sets")
    last = F.filter(sets, lambda x, i: (i == F.size(sets) - 1) | ~F.get(sets, i + 1)["o"].eqNullSafe(x["o"]) | ~F.get(sets, i + 1)["k"].eqNullSafe(x["k"]))
    names, kinds = (F.array(*[F.lit(t[n]) for t in CONFIG_KEYS]) for n in (0, 2))

    def given(x: Column) -> Column:
        place = x["o"].cast("int")
        text = _override_json(x["value"], x["value_json"] if "value_json" in rest else None)
        return F.struct(place.alias("o"), F.coalesce(F.get(names, place), x["k"]).alias("key"), F.get(kinds, place).alias("kind"), text.alias("value"))

    def written(x: Column) -> Column:
        frag, error = _fragment(x["key"], x["kind"], x["value"], mask)
        return F.struct(frag.alias("frag"), error.alias("error"))

    def value_of(place: int) -> Column:
        return F.get(F.filter("given", lambda x: x["o"] == place), 0)["value"]

    forced = F.lit(sum(KEY_MASK[k] for k in FORCED_CONFIG_KEYS)).cast("bigint")
    present = F.aggregate("given", forced, lambda acc, x: F.when(x["o"].isNull(), acc).otherwise(
        acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["o"]))))
    given_rows = agg.select("deployment_id", *COUNTS, "is_id", last.alias("sets")).select(
        "deployment_id", *COUNTS, "is_id", F.transform("sets", given).alias("given"))
    facts = given_rows.select(
        "deployment_id", *COUNTS, "is_id", present.alias("present"), F.transform("given", written).alias("written"),
        *[value_of(KNOWN_KEYS.index(k)).alias(k) for k in PIVOT_KEYS])
    frags = F.filter(F.col("written")["frag"], lambda f: f.isNotNull())
    return facts.select("deployment_id", "present", *PIVOT_KEYS, *COUNTS, frags.alias("items"),
                        F.array_min(F.col("written")["error"]).alias("row_error"), "is_id")


def config_documents(requests: DataFrame, overrides: DataFrame, mask: bool = True) -> DataFrame:
    """C9 in one aggregate: ``(deployment_id, document, error, <URL and
    ranking parts>)`` for every accepted deployment.

    Accepted requests (a marker row with the four counts each) and the
    user's rows go into ONE ``groupBy(deployment_id)``: it yields the
    presence bits, the values the URL reads and the document fragments of
    the given keys. The forced fragments, computed from the counts, the
    defaults of absent keys and the URL are appended on the result row, so
    no generated text is shuffled, and there is no semi join, no union of
    long forms and no second regrouping. A document has each key once; of
    repeated rows without ``set_no`` the greatest text is written. The collected group is one
    deployment's document."""
    facts = _repeated_document_facts if "set_no" in overrides.columns else _document_facts
    agg = facts(requests, overrides, mask)
    parts = config_parts(agg, keep=("present", "items", "row_error", *COUNTS))
    forced = F.array(*[F.struct(F.lit(k).alias("key"), F.concat(F.lit(f'"{k}":'), v).alias("frag"))
                       for k, v in _forced_values().items()])
    db = bound(_database_url_expr(mask), lambda u: F.struct(
        F.lit("database").alias("key"), F.concat(F.lit('"database":'), F.when(u.isNotNull(), json_string(u))).alias("frag")))
    items = F.sort_array(F.concat(F.col("items"), forced, F.expr(_DEFAULT_FRAGMENTS), F.filter(F.array(db), lambda x: x["frag"].isNotNull())))
    # A key is written once: of repeated rows the last in order of their text.
    items = bound(items, lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["key"] != x["key"])))
    missing = F.col("present").bitwiseAND(F.lit(_REQUIRED_MASK)) != F.lit(_REQUIRED_MASK)
    err = F.when(missing, F.lit(MISSING_REQUIRED)).otherwise(F.col("row_error"))
    doc = F.concat(F.lit("{"), F.array_join(items["frag"], ","), F.lit("}"))
    return parts.select("deployment_id", F.when(err.isNull(), doc).alias("document"), err.alias("error"),
                        *PIVOT_KEYS)


def _ranking_doc_expr(mask: bool) -> Column:
    frags = []
    for name, src in RANKING_FIELDS:
        v = F.lit(RANKING_BIND_ADDRESS) if src is None else F.col(src)
        if src in MASKED_KEYS:
            v = _mask(F.lit(src), v, mask)
        frags.append(F.concat(F.lit(f'"{name}":'), F.coalesce(v, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *frags), F.lit("}"))


def ranking_config_document(parts: DataFrame, mask: bool = True) -> DataFrame:
    """C8 as one JSON object per deployment, fields in document order, built
    on the pivot row of :func:`config_parts` (no regrouping)."""
    return parts.select("deployment_id", _ranking_doc_expr(mask).alias("document"))


def config_files(requests: DataFrame, overrides: DataFrame, mask: bool = True) -> DataFrame:
    """Both documents of every accepted deployment, one row each:
    ``(deployment_id, config, ranking, error)``, from the one aggregate of
    :func:`config_documents` (the ranking document reads the same row)."""
    docs = config_documents(requests, overrides, mask)
    return docs.select("deployment_id", F.col("document").alias("config"), _ranking_doc_expr(mask).alias("ranking"),
                       "error")
