"""The sample invocation of the deployment tool, worked out by hand
(FIXTURES.md §1): 3 CWS machines x 2, 2 workers x 2, one SSH and one admin
CIDR, overrides db_user, db_passwd, db_host."""

import json


from helpers import rows
from flotilla.operators import config as C
from flotilla.operators import planning as B
from helpers import cidrs_df, overrides_df, request, requests_df


def _req(spark):
    return requests_df(spark, request(spark))


def test_instance_total_and_launch_order(spark):
    r = _req(spark)
    assert rows(B.fleet_summary(r), "total") == [(6,)]
    inst = B.expand_instances(r).orderBy("launch_pos")
    assert [x[0] for x in rows(inst, "private_ip")] == [
        "10.0.1.5", "10.0.1.11", "10.0.1.12", "10.0.2.11", "10.0.2.12", "10.0.3.11"]
    assert [x[0] for x in rows(inst, "launch_pos")] == list(range(6))


def test_target_ports(spark):
    t = B.target_registrations(_req(spark)).orderBy("port")
    assert rows(t, "private_ip", "port") == [
        ("10.0.2.11", 9000), ("10.0.2.11", 9001), ("10.0.2.12", 9002), ("10.0.2.12", 9003),
        ("10.0.3.11", 9004), ("10.0.3.11", 9005)]


def test_listen_lists(spark):
    (addrs, ports), = rows(B.listen_lists(_req(spark)), "contest_listen_address", "contest_listen_port")
    assert addrs == ["10.0.2.11", "10.0.2.11", "10.0.2.12", "10.0.2.12", "10.0.3.11", "10.0.3.11"]
    assert ports == list(range(9000, 9006))


def test_endpoints(spark):
    ep = B.service_endpoints(_req(spark))
    worker = rows(ep.where("service = 'Worker'").orderBy("pos"), "ip", "port")
    assert worker == [("10.0.1.11", 26000), ("10.0.1.11", 26001), ("10.0.1.12", 26000), ("10.0.1.12", 26001)]
    cws = rows(ep.where("service = 'ContestWebServer'").orderBy("pos"), "ip", "port")
    assert cws == [(ip, p) for ip in ("10.0.2.11", "10.0.2.12", "10.0.3.11") for p in (21000, 21001)]
    counts = dict(rows(ep.groupBy("section").count()))
    assert counts == {"core": 23, "other": 1}


def test_published_ports(spark):
    pp = B.published_ports(_req(spark))
    assert pp.count() == 57
    (flags,), = rows(B.port_flags(_req(spark)), "port_flags")
    assert flags.startswith("-p 8888:8888 -p 8889:8889 -p 29000:29000")
    assert len(flags.split(" -p ")) == 57


def test_ingress_rows(spark):
    c = cidrs_df(spark, [(1, "ssh", 0, "1.2.3.4/32"), (1, "admin", 0, "1.2.3.4/32")])
    ing = B.ingress_rules(_req(spark), c).orderBy("rule")
    assert rows(ing, "security_group", "rule", "protocol", "from_port", "to_port", "cidr") == [
        ("main", 1, "tcp", 13800, 13800, "1.2.3.4/32"),
        ("main", 2, "tcp", 22, 22, "1.2.3.4/32"),
        ("main", 3, "tcp", 9000, 9005, "1.2.3.4/32"),
        ("main", 4, "-1", None, -1, "10.0.0.0/16"),
        ("lb", 5, "-1", None, -1, "0.0.0.0/0"),
    ]


def test_database_url_and_forced_config(spark):
    ov = overrides_df(spark, [(1, "db_user", "cmsuser"), (1, "db_passwd", "cmspasswd"),
                              (1, "db_host", "db.cms.host")])
    entries = C.config_entries(_req(spark), ov, mask=False)
    conf = {k: v for k, v in rows(entries, "key", "value")}
    assert json.loads(conf["database"]) == "postgresql+psycopg2://cmsuser:cmspasswd@db.cms.host:5432/cmsdb"
    assert conf["num_proxies_used"] == "1"
    assert conf["admin_listen_port"] == "13800"
    assert conf["rankings"] == "[]"
    core = json.loads(conf["core_services"])
    assert list(core) == ["LogService", "ResourceService", "ScoringService", "Checker", "EvaluationService",
                          "Worker", "ContestWebServer", "AdminWebServer", "ProxyService", "PrintingService"]
    assert core["Worker"] == [["10.0.1.11", 26000], ["10.0.1.11", 26001], ["10.0.1.12", 26000],
                              ["10.0.1.12", 26001]]
    assert json.loads(conf["other_services"]) == {"TestFileCacher": [["10.0.1.5", 27501]]}
    doc = rows(C.config_document(entries), "document", "error")
    parsed = json.loads(doc[0][0])
    assert doc[0][1] is None and parsed["db_passwd"] == "cmspasswd" and parsed["backdoor"] is False
    masked = {k: v for k, v in rows(C.config_entries(_req(spark), ov), "key", "value")}
    assert json.loads(masked["database"]) == "postgresql+psycopg2://cmsuser:********@db.cms.host:5432/cmsdb"
    assert masked["db_passwd"] == '"********"'
