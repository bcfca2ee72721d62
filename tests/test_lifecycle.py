"""The three commands as fleet plans: each output equals the operator it
composes, and the sinks round-trip."""

from helpers import SF_SMALL
from flotilla.operators import config as C
from flotilla.operators import planning as B
from flotilla.operators import state as D
from flotilla.plans import lifecycle as L
from flotilla.session import scratch_path
from flotilla.sources import fixtures as fx
from flotilla.sources import state_io as A


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_configure(spark):
    req, ov = fx.deployment_requests(spark, SF_SMALL), fx.config_overrides(spark, SF_SMALL)
    path = scratch_path(spark, "t-lc-conf")
    out = L.configure(req, ov, out_path=path)
    assert _same(out["entries"], C.config_entries(req, ov))
    rejected = req.count() - B.accepted_requests(req).count()
    assert out["rejected"].count() == rejected
    ok = out["files"].where("config is not null").count()
    assert A.read_config(spark, path, "config").select("deployment_id").distinct().count() == ok


def test_deploy(spark):
    req, cidrs = fx.deployment_requests(spark, SF_SMALL), fx.allowed_cidrs(spark, SF_SMALL)
    out = L.deploy(req, cidrs, fx.observed_addresses(spark, SF_SMALL))
    acc = B.accepted_requests(req)
    assert out["instances"].count() == B.expand_instances(acc).count() == out["addresses"].count()
    assert _same(out["targets"], B.target_registrations(acc))


def test_teardown(spark):
    st, oc = fx.state_entries(spark, SF_SMALL), fx.teardown_outcomes(spark, SF_SMALL)
    path = scratch_path(spark, "t-lc-state")
    out = L.teardown(st, oc, state_out=path)
    assert _same(out["residual"], D.residual_state(st, oc))
    assert _same(A.read_state(spark, path), out["residual"])
    assert out["top_leaks"].count() == 20
