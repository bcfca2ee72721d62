"""The three commands of the deployment tool as fleet-wide plans.

Each function composes the operators for every deployment in its inputs and
returns a dict of lazy DataFrames (nothing runs until a caller acts on one);
the optional paths write the documents or the remaining state with Spark

* ``configure``: requests -> B1 -> B4 -> B12/B14 -> C5 -> C2 -> C3/C4 ->
  C7/C8 -> C9 -> A3;
* ``deploy``: requests -> B1 -> B4 -> B5/B6/B15, B8, B9/B10, B11;
* ``teardown``: A1 -> D6 -> D2/D3 -> D4 -> D5 -> A2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import config as C
from ..operators import planning as B
from ..operators import state as D
from ..sources import state_io as A


def configure(requests: DataFrame, overrides: DataFrame, out_path: str | None = None,
              mask: bool = True) -> dict[str, DataFrame]:
    """Configuration run: rejected requests, machines, service endpoints,
    listen lists, the configuration entries and documents, and the checks
    (missing required keys, secrets to generate). Writes both documents of
    every deployment whose configuration succeeds when ``out_path`` is set."""
    checked = B.validate_requests(requests)
    acc = B.accepted_requests(requests)
    ids = acc.select("deployment_id")
    merged = C.apply_forced(C.overrides_json(overrides), acc)
    out = {
        "rejected": checked.where(~F.col("accepted")).select("deployment_id", "reason"),
        "instances": B.expand_instances(acc),
        "endpoints": B.service_endpoints(acc),
        "listen": B.listen_rows(acc),
        "entries": C.config_entries(requests, overrides, mask),
        "files": C.config_files(requests, overrides, mask),
        "missing_required": C.missing_required(merged, ids),
        "generated_secrets": C.generated_secrets(merged, ids),
    }
    if out_path:
        A.write_config(out["files"], out_path)
    return out


def deploy(requests: DataFrame, allowed_cidrs: DataFrame, observed: DataFrame | None = None,
           ts_col: str = "requested_at") -> dict[str, DataFrame]:
    """Deployment run: placed machines in launch order (with the addresses
    the cloud reports when ``observed`` is given, and the state record's
    address keys), access rules, published ports and their flags,
    load-balancer targets, resource names, stamps."""
    acc = B.accepted_requests(requests)
    placed = B.place_instances(acc)
    out = {
        "rejected": B.validate_requests(requests).where(~F.col("accepted")).select("deployment_id", "reason"),
        "instances": placed,
        "ingress": B.ingress_rules(requests, allowed_cidrs),
        "ports": B.published_ports(acc),
        "port_flags": B.port_flags(acc),
        "targets": B.target_registrations(acc),
        "names": B.derive_names(acc),
        "stamps": B.deployment_stamp(acc, ts_col),
    }
    if observed is not None:
        out["addresses"] = B.attach_addresses(placed, observed)
        out["state"] = D.deployed_state(acc, observed)
    return out


def teardown(saved: DataFrame, outcomes: DataFrame, memory: DataFrame | None = None,
             state_out: str | None = None, top_k: int = 20, snapshot: int | None = None) -> dict[str, DataFrame]:
    """Teardown run over saved state (long form, e.g. from
    ``state_io.read_state``): the record used (memory first), machines to
    terminate, the plan, the state left after the outcomes, leaks and the
    top-k leak report. Writes the remaining state of every deployment (an
    empty record where nothing is left) when ``state_out`` is set; with
    ``snapshot``, as that snapshot of the append-only store ``state_out``,
    which may be the one ``saved`` was read from. Without it, ``state_out``
    must be another folder."""
    state = D.effective_state(memory, saved) if memory is not None else saved
    leaked = D.leaks(state, outcomes)
    out = {
        "state": state,
        "terminate": D.instances_to_terminate(state),
        "plan": D.teardown_plan(state),
        "residual": D.residual_state(state, outcomes),
        "leaks": leaked,
        "top_leaks": D.top_leaks(leaked.drop("leaked_keys"), top_k),
    }
    if state_out:
        ids = state.select("deployment_id").distinct()
        if snapshot is None:
            A.write_state(out["residual"], state_out, ids)
        else:
            A.append_state(out["residual"], state_out, snapshot, ids)
    return out
