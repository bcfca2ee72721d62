"""Planning operators (B1-B17): expand deployment requests into machines,
addresses, ports, access rules and service endpoints.

Every expansion is a generator over arrays built from the request row
itself (``inline`` of ``transform(array_repeat(..))``), so one request
expands inside one task with no shuffle and no join. Positions that the
deployment tool produced with running counters have closed forms here
(launch position, target port), which removes the window those counters
would otherwise need. The only joins are with other inputs keyed by
``deployment_id`` (allow-lists, observed addresses), left to Catalyst/AQE.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CWS_BASE_PORT, WORKER_BASE_PORT,
    CWS_TARGET_BASE_PORT, DEFAULT_CONTEST, INGRESS_RULES, KEYPAIR_SUFFIX, LB_GROUP_SUFFIX, LB_SUFFIX,
    LOG_COMMAND, MAIN_IP, MIN_CWS_INSTANCES, PEM_SUFFIX, PUBLISHED_FIXED_PORTS, PUBLISHED_SHARDS,
    RANKING_COMMAND, REJECT_REASON, RESOURCE_COMMAND, RWS_ON, SERVICES, SHELL_COMMAND, STATE_FILE_SUFFIX,
    TARGET_GROUP_SUFFIX, TIERS,
)
from ..functions.columns import host_ips, py_floordiv, py_mod, stamp

_TIER = {t[0]: t for t in TIERS}
COUNT_COLUMNS = ["nb_workers_instances", "nb_workers_per_instance", "nb_cws_instances", "nb_cws_per_instance"]


# -- B1, B2, B3 --------------------------------------------------------------------

def validate_requests(requests: DataFrame) -> DataFrame:
    """B1: a request needs at least two CWS machines (the load balancer spans
    two zones). Requests with a missing count are rejected as well."""
    n = F.col("nb_cws_instances")
    complete = F.lit(True)
    for c in COUNT_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    enough = F.coalesce(n >= MIN_CWS_INSTANCES, F.lit(False))
    return requests.withColumns({
        "accepted": complete & enough,
        "reason": F.when(~complete, F.lit("Missing instance count."))
                   .when(~enough, F.lit(REJECT_REASON)),
    })


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Requests that pass B1; every later planning step reads these only."""
    return validate_requests(requests).where("accepted").drop("accepted", "reason")


def fleet_summary(requests: DataFrame) -> DataFrame:
    """B2 per deployment: 1 main + workers + CWS machines."""
    w, n = F.col("nb_workers_instances"), F.col("nb_cws_instances")
    return requests.select("deployment_id", F.lit(1).alias("main"), w.alias("workers"), n.alias("cws"),
                           (1 + w + n).alias("total"))


def fleet_totals(requests: DataFrame) -> DataFrame:
    """B2 for the whole fleet: one global aggregate (partial sums per
    partition, one final merge)."""
    s = fleet_summary(requests)
    return s.agg(F.count("*").alias("deployments"), F.sum("main").alias("main"),
                 F.sum("workers").alias("workers"), F.sum("cws").alias("cws"), F.sum("total").alias("total"))


def cws_split(n: Column) -> tuple[Column, Column]:
    """First subnet gets ``n // 2 + n % 2`` machines, second ``n // 2``."""
    return py_floordiv(n, 2) + py_mod(n, 2), py_floordiv(n, 2)


def split_subnets(requests: DataFrame) -> DataFrame:
    n1, n2 = cws_split(F.col("nb_cws_instances"))
    return requests.select("deployment_id", n1.alias("n_cws1"), n2.alias("n_cws2"))


# -- B4, B5, B6 --------------------------------------------------------------------

def tier_ips(tier: str, count: Column) -> Column:
    _, prefix, first, *_ = _TIER[tier]
    return host_ips(prefix, first, count)


def request_ips() -> dict[str, Column]:
    """Address lists of one request, per tier, in launch order."""
    n1, n2 = cws_split(F.col("nb_cws_instances"))
    return {
        "main": F.array(F.lit(MAIN_IP)),
        "workers": tier_ips("workers", F.col("nb_workers_instances")),
        "cws1": tier_ips("cws1", n1),
        "cws2": tier_ips("cws2", n2),
    }


def _instance_rows() -> Column:
    """array<struct<tier, idx, launch_pos, private_ip>> in launch order:
    main, workers, cws1, cws2. ``launch_pos`` is the closed form of the
    position in the concatenated id list."""
    ips = request_ips()
    n1, _ = cws_split(F.col("nb_cws_instances"))
    zero = F.lit(0)
    offsets = {
        "main": zero,
        "workers": F.lit(1),
        "cws1": 1 + F.greatest(F.col("nb_workers_instances"), zero),
        "cws2": 1 + F.greatest(F.col("nb_workers_instances"), zero) + F.greatest(n1, zero),
    }
    def row(tier: str, off: Column):
        return lambda ip, i: F.struct(F.lit(tier).alias("tier"), i.alias("idx"),
                                      (off + i).alias("launch_pos"), ip.alias("private_ip"))

    return F.concat(*[F.transform(ips[t[0]], row(t[0], offsets[t[0]])) for t in TIERS])


def expand_instances(requests: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """B4 + B6: one row per machine ``(deployment_id, tier, idx, launch_pos,
    private_ip)``; ``carry`` keeps request columns next to each machine."""
    return requests.select("deployment_id", *carry, F.inline(_instance_rows()))


def _by_tier(field: int) -> Column:
    expr = None
    for t in TIERS:
        cond = F.col("tier") == t[0]
        value = F.lit(t[field]) if field != 5 else F.col(t[field])
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def place_instances(requests: DataFrame) -> DataFrame:
    """Subnet, zone and instance type per machine. The tier constants are
    a CASE over four literals and the type comes along from the request row,
    so no join is needed."""
    types = sorted({t[5] for t in TIERS})
    inst = expand_instances(requests, carry=types)
    return inst.select(
        "deployment_id", "tier", "idx", "launch_pos", "private_ip",
        _by_tier(3).alias("subnet_cidr"), _by_tier(4).alias("zone"), _by_tier(5).alias("instance_type"),
        F.lit(1).alias("count"),
    )


def launch_order(instances: DataFrame) -> DataFrame:
    """Machines with their launch position (main, workers, cws1, cws2,
    each by index); rows already carry it from :func:`expand_instances`."""
    return instances.select("deployment_id", "launch_pos", "tier", "idx")


# -- B7, B16 --------------------------------------------------------------------------

def derive_names(requests: DataFrame) -> DataFrame:
    """Resource names derived from the deployment id and title."""
    i, t = F.col("id"), F.col("title")
    keypair = F.concat(i, F.lit(KEYPAIR_SUFFIX))
    return requests.select(
        "deployment_id",
        keypair.alias("keypair"),
        F.concat(keypair, F.lit(PEM_SUFFIX)).alias("pem"),
        F.concat(i, F.lit(LB_SUFFIX)).alias("load_balancer"),
        F.concat(i, F.lit(TARGET_GROUP_SUFFIX)).alias("target_group"),
        t.alias("security_group"),
        F.concat(t, F.lit(LB_GROUP_SUFFIX)).alias("lb_security_group"),
        F.concat(i, F.lit(STATE_FILE_SUFFIX)).alias("state_file"),
    )


def deployment_stamp(df: DataFrame, ts_col: str = "requested_at") -> DataFrame:
    """The ``dd-mm-yy-HHhMM`` stamp of a given time column."""
    return df.select("deployment_id", stamp(F.col(ts_col)).alias("stamp"))


# -- B8 ------------------------------------------------------------------------------------

def _rule_struct(rule, group, proto, from_port, to_port, cidr) -> Column:
    return F.struct(
        F.lit(group).alias("security_group"), F.lit(rule).alias("rule"), F.lit(proto).alias("protocol"),
        (F.lit(from_port) if from_port is not None else F.lit(None)).cast("int").alias("from_port"),
        (to_port if isinstance(to_port, Column) else F.lit(to_port)).cast("int").alias("to_port"),
        (cidr if isinstance(cidr, Column) else F.lit(cidr)).alias("cidr"),
    )


def ingress_rules(requests: DataFrame, allowed_cidrs: DataFrame) -> DataFrame:
    """The five rule templates; the three list-based rules are crossed
    with the request's allow-lists. An empty list gives no row.

    Allow-lists join the accepted requests on ``deployment_id`` (one
    shuffle each side, or none if AQE broadcasts a small side); each CIDR row
    then expands to its rules with a generator. The two fixed rules are a
    generator over the request rows alone."""
    acc = accepted_requests(requests).select(
        "deployment_id", (F.col("nb_cws_instances") * F.col("nb_cws_per_instance")).alias("nk"))
    last_target = CWS_TARGET_BASE_PORT + F.col("nk") - 1
    listed = [r for r in INGRESS_RULES if r[5] in ("admin", "ssh")]
    fixed = [r for r in INGRESS_RULES if r[5] not in ("admin", "ssh")]

    def per_kind(kind: str) -> Column:
        return F.array(*[_rule_struct(r, g, p, f, t if t is not None else last_target, F.col("cidr"))
                         for r, g, p, f, t, src in listed if src == kind])

    rules_for = None
    for kind in ("admin", "ssh"):
        cond = F.col("kind") == kind
        rules_for = F.when(cond, per_kind(kind)) if rules_for is None else rules_for.when(cond, per_kind(kind))
    from_lists = (allowed_cidrs.select("deployment_id", "kind", "cidr").join(acc, "deployment_id")
                  .select("deployment_id", F.inline(rules_for)))
    from_fixed = acc.select("deployment_id", F.inline(F.array(*[_rule_struct(*r) for r in fixed])))
    return from_lists.unionByName(from_fixed)


# -- B9, B10, B14 -------------------------------------------------------------------------

def published_port_array() -> Column:
    nk = F.col("nb_cws_instances") * F.col("nb_cws_per_instance")
    return F.concat(
        F.array(*[F.lit(p) for p in PUBLISHED_FIXED_PORTS]),
        F.transform(F.array_repeat(F.lit(0), nk), lambda _, i: CWS_TARGET_BASE_PORT + i),
        F.transform(F.array_repeat(F.lit(0), F.lit(PUBLISHED_SHARDS)), lambda _, i: WORKER_BASE_PORT + i),
        F.transform(F.array_repeat(F.lit(0), F.lit(PUBLISHED_SHARDS)), lambda _, i: CWS_BASE_PORT + i),
    )


def published_ports(requests: DataFrame) -> DataFrame:
    """Ports every container publishes, with their list position."""
    return requests.select("deployment_id", F.posexplode(published_port_array()).alias("pos", "port"))


def port_flags(requests: DataFrame) -> DataFrame:
    """``-p P:P`` for each published port, space separated, computed
    from the request row (no regrouping of the exploded list)."""
    flags = F.transform(published_port_array(),
                        lambda p: F.concat(F.lit("-p "), p.cast("string"), F.lit(":"), p.cast("string")))
    return requests.select("deployment_id", F.array_join(flags, " ").alias("port_flags"))


def _listen_sql() -> tuple[str, str]:
    n = "`nb_cws_instances`"
    n1 = f"CAST(({n} - pmod({n}, 2)) div 2 + pmod({n}, 2) AS INT)"
    n2 = f"CAST(({n} - pmod({n}, 2)) div 2 AS INT)"

    def ips(tier: str, count: str) -> str:
        prefix, first = _TIER[tier][1], _TIER[tier][2]
        return f"transform({_sql_host_numbers(first, count)}, h -> concat('{prefix}', CAST(h AS STRING)))"

    addrs = f"flatten(transform(concat({ips('cws1', n1)}, {ips('cws2', n2)}), ip -> array_repeat(ip, `nb_cws_per_instance`)))"
    nk = f"{n} * `nb_cws_per_instance`"
    last = CWS_TARGET_BASE_PORT - 1
    ports = (f"CASE WHEN {nk} > 0 THEN sequence({CWS_TARGET_BASE_PORT}, {last} + {nk}) "
             f"ELSE CAST(array() AS array<int>) END")
    return addrs, ports


def listen_arrays() -> tuple[Column, Column]:
    """Each CWS address repeated once per CWS on it, and the matching
    ports 9000 + 0..n*k-1 (SQL text rendered once at import)."""
    addrs, ports = _LISTEN_SQL
    return F.expr(addrs), F.expr(ports)


def listen_lists(requests: DataFrame) -> DataFrame:
    addrs, ports = listen_arrays()
    return requests.select("deployment_id", addrs.alias("contest_listen_address"),
                           ports.alias("contest_listen_port"))


def listen_rows(requests: DataFrame) -> DataFrame:
    """B14 flattened: ``(deployment_id, pos, address, port)``."""
    addrs, ports = listen_arrays()
    pairs = F.transform(F.arrays_zip(addrs.alias("a"), ports.alias("p")),
                        lambda z, i: F.struct(i.alias("pos"), z["a"].alias("address"), z["p"].alias("port")))
    return requests.select("deployment_id", F.inline(pairs))


# -- B11 -------------------------------------------------------------------------------------

def _flat_grid(count: Column, shards: Column) -> Column:
    """``[0, count*shards)`` (host-major index over a tier's hosts and their
    shards), empty when either is not positive."""
    n = F.when((count > 0) & (shards > 0), count * shards).otherwise(F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _div(j: Column, k: Column) -> Column:
    return ((j - F.pmod(j, k)) / k).cast("int")


def target_registrations(requests: DataFrame) -> DataFrame:
    """Each CWS machine registered once per CWS it runs, cws1 first;
    one running port from 9000. Closed form of the running counter:
    ``9000 + (offset + idx) * k + shard`` with offset 0 for cws1 and n_cws1
    for cws2, i.e. ``9000 + offset * k + j`` over the host-major index j,
    so no window (and no shuffle) is needed."""
    n1, n2 = cws_split(F.col("nb_cws_instances"))
    k = F.col("nb_cws_per_instance")

    def row(tier: str, offset: Column):
        _, prefix, first, *_ = _TIER[tier]
        return lambda j: F.struct(
            F.lit(tier).alias("tier"), _div(j, k).alias("idx"), F.pmod(j, k).alias("shard"),
            F.concat(F.lit(prefix), (_div(j, k) + first).cast("string")).alias("private_ip"),
            (CWS_TARGET_BASE_PORT + offset * k + j).alias("port"))

    rows = F.concat(F.transform(_flat_grid(n1, k), row("cws1", F.lit(0))),
                    F.transform(_flat_grid(n2, k), row("cws2", F.greatest(n1, F.lit(0)))))
    return requests.select("deployment_id", F.inline(rows))


# -- B12, B13 -------------------------------------------------------------------------------

def _endpoint(ip: Column, port: Column) -> Column:
    return F.struct(ip.alias("ip"), port.cast("int").alias("port"))


def _fixed_port(port: int):
    return lambda ip: _endpoint(ip, F.lit(port))


def service_arrays() -> list[tuple[str, str, Column]]:
    """``(service, section, array<struct<ip, port>>)`` in document order."""
    ips = request_ips()
    wk, k = F.col("nb_workers_per_instance"), F.col("nb_cws_per_instance")
    everyone = F.concat(ips["main"], ips["workers"], ips["cws1"], ips["cws2"])

    def sharded(tiers: list[tuple[str, Column]], shards: Column, base: int) -> Column:
        def ep(tier: str):
            _, prefix, first, *_ = _TIER[tier]
            return lambda j: _endpoint(F.concat(F.lit(prefix), (_div(j, shards) + first).cast("string")),
                                       base + F.pmod(j, shards))
        return F.concat(*[F.transform(_flat_grid(count, shards), ep(tier)) for tier, count in tiers])

    out = []
    for name, section, hosts, port in SERVICES:
        if hosts == "main":
            arr = F.array(_endpoint(F.lit(MAIN_IP), F.lit(port)))
        elif hosts == "all":
            arr = F.transform(everyone, _fixed_port(port))
        elif hosts == "workers_shards":
            arr = sharded([("workers", F.col("nb_workers_instances"))], wk, port)
        elif hosts == "cws_shards":
            n1, n2 = cws_split(F.col("nb_cws_instances"))
            arr = sharded([("cws1", n1), ("cws2", n2)], k, port)
        else:
            raise ValueError(hosts)
        out.append((name, section, arr))
    return out


def service_endpoints(requests: DataFrame) -> DataFrame:
    """``(deployment_id, section, service, pos, ip, port)``, one row per
    endpoint; ``pos`` is the place in the service's list."""
    def row(name: str, section: str):
        return lambda e, i: F.struct(F.lit(section).alias("section"), F.lit(name).alias("service"),
                                     i.alias("pos"), e["ip"].alias("ip"), e["port"].alias("port"))

    parts = [F.transform(arr, row(name, section)) for name, section, arr in service_arrays()]
    return requests.select("deployment_id", F.inline(F.concat(*parts)))


def service_document(requests: DataFrame) -> DataFrame:
    """``core_services`` and ``other_services`` as maps service ->
    ordered endpoint list, built on the request row (no regrouping)."""
    cols = {}
    for section in ("core", "other"):
        items = [(n, a) for n, s, a in service_arrays() if s == section]
        cols[f"{section}_services"] = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in items]),
                                                       F.array(*[a for _, a in items]))
    return requests.select("deployment_id", *[v.alias(k) for k, v in cols.items()])


def service_document_rows(document: DataFrame) -> DataFrame:
    """B13 back to rows, for comparison with B12 (one pass: sections, then
    services, then list positions, each a generator)."""
    sections = F.array(*[F.struct(F.lit(sec).alias("section"), F.col(f"{sec}_services").alias("m"))
                         for sec in ("core", "other")])
    return (document.select("deployment_id", F.inline(sections))
            .select("deployment_id", "section", F.explode("m").alias("service", "eps"))
            .select("deployment_id", "section", "service", F.posexplode("eps").alias("pos", "ep"))
            .select("deployment_id", "section", "service", "pos", "ep.ip", "ep.port"))


def _sql_host_numbers(first: int, count: str) -> str:
    return f"CASE WHEN {count} > 0 THEN sequence({first}, {first - 1} + {count}) ELSE CAST(array() AS array<int>) END"


def _sql_ep_list(tier: str, count: str, port: int) -> str:
    prefix, first = _TIER[tier][1], _TIER[tier][2]
    hosts = f"CAST({_sql_host_numbers(first, count)} AS array<string>)"
    return (f"CASE WHEN {count} > 0 THEN concat('[\"{prefix}', array_join({hosts}, '\",{port}],[\"{prefix}'), "
            f"'\",{port}]') END")


def _sql_sharded_list(tiers: list[tuple[str, str]], shards: str, base: int) -> str:
    ports = (f"CAST(CASE WHEN {shards} > 0 THEN sequence({base}, {base - 1} + {shards}) "
             f"ELSE CAST(array() AS array<int>) END AS array<string>)")
    parts = []
    for tier, count in tiers:
        prefix, first = _TIER[tier][1], _TIER[tier][2]
        hosts = f"CAST({_sql_host_numbers(first, count)} AS array<string>)"
        item = (f"h -> concat('[\"{prefix}', h, '\",', "
                f"array_join({ports}, concat('],[\"{prefix}', h, '\",')), ']')")
        parts.append(f"CASE WHEN {count} > 0 AND {shards} > 0 THEN array_join(transform({hosts}, {item}), ',') END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


def endpoints_json_sql(section: str) -> str:
    """SQL text of :func:`endpoints_json` over the request columns."""
    n = "`nb_cws_instances`"
    n1 = f"CAST(({n} - pmod({n}, 2)) div 2 + pmod({n}, 2) AS INT)"
    n2 = f"CAST(({n} - pmod({n}, 2)) div 2 AS INT)"
    w, wk, k = "`nb_workers_instances`", "`nb_workers_per_instance`", "`nb_cws_per_instance`"
    items = []
    for name, s, hosts, port in SERVICES:
        if s != section:
            continue
        main = f"'[\"{MAIN_IP}\",{port}]'"
        if hosts == "main":
            body = main
        elif hosts == "all":
            body = (f"concat_ws(',', {main}, {_sql_ep_list('workers', w, port)}, "
                    f"{_sql_ep_list('cws1', n1, port)}, {_sql_ep_list('cws2', n2, port)})")
        elif hosts == "workers_shards":
            body = _sql_sharded_list([("workers", w)], wk, port)
        elif hosts == "cws_shards":
            body = _sql_sharded_list([("cws1", n1), ("cws2", n2)], k, port)
        else:
            raise ValueError(hosts)
        items.append(f"concat('\"{name}\":[', {body}, ']')")
    return "concat('{', concat_ws(',', " + ", ".join(items) + "), '}')"


_ENDPOINTS_SQL = {sec: endpoints_json_sql(sec) for sec in ("core", "other")}
_LISTEN_SQL = _listen_sql()


def endpoints_json(section: str) -> Column:
    """The section as the JSON text the configuration file holds, services
    in document order, each endpoint a two-element ``[ip, port]`` list
    (mixed types, so written as text rather than through a Spark array).
    Single-host services are constant strings; the expression is SQL text
    rendered once."""
    return F.expr(_ENDPOINTS_SQL[section])


# -- B15 ------------------------------------------------------------------------------------

def newest_observations(observed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row a machine ``(deployment_id, launch_pos, public_ip, private_ip)``
    of observations that may repeat: with a column ``observed_at`` the newest,
    not later than ``as_of`` if given; between observations of one time, and
    without the column, the one with the greatest addresses. An aggregate with
    partial results; machines with no observation in time have no row."""
    told = [F.col(c) for c in ("observed_at", "public_ip", "private_ip") if c in observed.columns]
    if as_of is not None:
        observed = observed.where(F.col("observed_at") <= as_of)
    last = observed.groupBy("deployment_id", "launch_pos").agg(F.max(F.struct(*told)).alias("o"))
    return last.select("deployment_id", "launch_pos", "o.public_ip", "o.private_ip")


def attach_addresses(instances: DataFrame, observed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The public and private address the cloud reports for each
    machine, matched on launch position; unobserved machines keep nulls.
    Of a machine observed several times the newest observation counts, as of
    a given time (:func:`newest_observations`), so there is a row a machine
    whatever is observed. A sort-merge join on (deployment_id, launch_pos), on
    which the observations are already partitioned. It is asked for by name:
    the static size of observations does not see how many machines a request
    has, so under Spark's default threshold the driver would collect them all
    for a broadcast."""
    obs = newest_observations(observed, as_of).withColumnRenamed("private_ip", "observed_private_ip")
    return instances.join(obs.hint("merge"), ["deployment_id", "launch_pos"], "left")


# -- B17 ------------------------------------------------------------------------------------

def container_services(contest_env: DataFrame) -> DataFrame:
    """What a container starts. The contest defaults to 1 when unset or
    empty; a positive integer starts the log and resource services (and the
    ranking server first when CMS_RWS is exactly ``ON``); anything else, a
    non-number included, starts a shell."""
    raw = F.col("cms_contest")
    contest = F.coalesce(F.nullif(raw, F.lit("")), F.lit(DEFAULT_CONTEST))
    runs = F.coalesce(contest.try_cast("bigint") > 0, F.lit(False))
    rws = F.coalesce(F.col("cms_rws") == RWS_ON, F.lit(False))
    services = F.when(runs, F.array_compact(F.array(
        F.when(rws, F.lit(RANKING_COMMAND)), F.lit(LOG_COMMAND), F.lit(RESOURCE_COMMAND))
    )).otherwise(F.array(F.lit(SHELL_COMMAND)))
    return contest_env.select("host_id", contest.alias("contest"),
                              F.when(runs, "services").otherwise("shell").alias("mode"),
                              services.alias("services"))


def container_service_rows(services: DataFrame) -> DataFrame:
    return services.select("host_id", "contest", "mode", F.posexplode("services").alias("pos", "service"))
