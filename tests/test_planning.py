"""Planning operators: edge cases and properties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from flotilla.operators import planning as B
from flotilla.schemas import CONTEST_ENV
from flotilla.sources import fixtures as fx
from helpers import cidrs_df, request, requests_df


@pytest.mark.parametrize("n,accepted", [(0, False), (1, False), (2, True), (None, False)])
def test_validate_requests(spark, n, accepted):
    r = requests_df(spark, request(spark, nb_cws=n))
    (ok, reason), = rows(B.validate_requests(r), "accepted", "reason")
    assert ok is accepted
    assert (reason is None) == accepted


def test_split_subnets_and_zero_workers(spark):
    r = requests_df(spark, request(spark, deployment_id=1, nb_cws=2, workers=0),
                    request(spark, deployment_id=2, nb_cws=5, workers=0))
    assert sorted(rows(B.split_subnets(r))) == [(1, 1, 1), (2, 3, 2)]
    inst = B.expand_instances(r).where("deployment_id = 2").orderBy("launch_pos")
    assert rows(inst, "tier", "idx", "launch_pos") == [
        ("main", 0, 0), ("cws1", 0, 1), ("cws1", 1, 2), ("cws1", 2, 3), ("cws2", 0, 4), ("cws2", 1, 5)]
    assert B.service_endpoints(r).where("service = 'Worker'").count() == 0


def test_empty_allow_list_gives_no_rule(spark):
    r = requests_df(spark, request(spark))
    ing = B.ingress_rules(r, cidrs_df(spark, []))
    assert sorted(x[0] for x in rows(ing, "rule")) == [4, 5]


def test_rejected_request_gets_no_rules(spark):
    r = requests_df(spark, request(spark, nb_cws=1))
    ing = B.ingress_rules(r, cidrs_df(spark, [(1, "admin", 0, "1.2.3.4/32")]))
    assert ing.count() == 0


def test_endpoint_count_property(spark):
    acc = B.accepted_requests(fx.deployment_requests(spark, SF_SMALL))
    n = acc.join(B.service_endpoints(acc).where("section = 'core'").groupBy("deployment_id").count(),
                 "deployment_id")
    w, wk = F.col("nb_workers_instances"), F.col("nb_workers_per_instance")
    c, k = F.col("nb_cws_instances"), F.col("nb_cws_per_instance")
    bad = n.where(F.col("count") != 8 + w + c + w * wk + c * k)
    assert bad.count() == 0


def test_target_ports_contiguous_and_equal_listen_ports(spark):
    acc = B.accepted_requests(fx.deployment_requests(spark, SF_SMALL))
    t = B.target_registrations(acc)
    stats = t.groupBy("deployment_id").agg(F.min("port").alias("lo"), F.max("port").alias("hi"),
                                           F.count("*").alias("n"), F.countDistinct("port").alias("d"))
    assert stats.where("lo != 9000 or hi != 9000 + n - 1 or d != n").count() == 0
    listen = B.listen_rows(acc).select("deployment_id", "address", "port")
    assert t.select("deployment_id", F.col("private_ip").alias("address"), "port").exceptAll(listen).count() == 0
    assert listen.exceptAll(t.select("deployment_id", F.col("private_ip").alias("address"), "port")).count() == 0


def test_closed_form_launch_order_equals_row_number(spark):
    acc = B.accepted_requests(fx.deployment_requests(spark, SF_SMALL))
    inst = B.expand_instances(acc)
    rank = F.when(F.col("tier") == "main", 0).when(F.col("tier") == "workers", 1) \
        .when(F.col("tier") == "cws1", 2).otherwise(3)
    w = Window.partitionBy("deployment_id").orderBy(rank, "idx")
    assert inst.withColumn("rn", F.row_number().over(w) - 1).where("rn != launch_pos").count() == 0


def test_closed_form_target_port_equals_row_number(spark):
    acc = B.accepted_requests(fx.deployment_requests(spark, SF_SMALL))
    t = B.target_registrations(acc)
    w = Window.partitionBy("deployment_id").orderBy("tier", "idx", "shard")
    assert t.withColumn("rn", 9000 + F.row_number().over(w) - 1).where("rn != port").count() == 0


def test_derive_names(spark):
    r = requests_df(spark, request(spark, deployment_id=7))
    names = B.derive_names(r).first()
    assert names["keypair"] == "op-7_keypair" and names["pem"] == "op-7_keypair.pem"
    assert names["load_balancer"] == "op-7-lb" and names["target_group"] == "op-7-tg"
    assert names["lb_security_group"] == "Operation 7 - LB" and names["state_file"] == "op-7.json"


def test_deployment_stamp(spark):
    import datetime
    r = requests_df(spark, request(spark, requested_at=datetime.datetime(2017, 3, 4, 9, 5)))
    assert rows(B.deployment_stamp(r), "stamp") == [("04-03-17-09h05",)]


@pytest.mark.parametrize("contest,rws,expected", [
    (None, None, ("1", "services", ["cmsLogService", "cmsResourceService"])),
    ("", "ON", ("1", "services", ["cmsRankingWebServer", "cmsLogService", "cmsResourceService"])),
    ("0", "ON", ("0", "shell", ["/bin/bash"])),
    ("-3", None, ("-3", "shell", ["/bin/bash"])),
    ("abc", "ON", ("abc", "shell", ["/bin/bash"])),
    ("12", "on", ("12", "services", ["cmsLogService", "cmsResourceService"])),
])
def test_container_services(spark, contest, rws, expected):
    env = spark.createDataFrame([(1, contest, rws)], CONTEST_ENV)
    assert rows(B.container_services(env), "contest", "mode", "services") == [expected]


def test_attach_addresses_keeps_unobserved(spark):
    r = requests_df(spark, request(spark))
    obs = spark.createDataFrame([(1, 0, "3.3.3.3", "10.0.1.5")],
                                "deployment_id bigint, launch_pos int, public_ip string, private_ip string")
    a = B.attach_addresses(B.expand_instances(r), obs)
    assert a.count() == 6
    assert rows(a.where("public_ip is not null"), "launch_pos") == [(0,)]


def test_machines_observed_several_times_stay_one_row(spark):
    from pyspark.sql import functions as F
    inst = B.expand_instances(requests_df(spark, request(spark, nb_cws=2, workers=0)))
    machines = inst.count()
    seen = spark.createDataFrame([(1, 0, "1.1.1.1", "a"), (1, 0, "1.1.1.2", "b"), (1, 0, "1.1.1.2", "b"), (1, 9, "x", "y")],
                                 "deployment_id bigint, launch_pos int, public_ip string, private_ip string")
    got = {p: (pub, prv) for p, pub, prv in rows(B.attach_addresses(inst, seen), "launch_pos", "public_ip", "observed_private_ip")}
    assert len(got) == machines and got[0] == ("1.1.1.2", "b") and got[1] == (None, None)
    at = "2024-01-0{} 00:00:00".format
    told = spark.createDataFrame([(1, 0, "old", "a", at(1)), (1, 0, "new", "b", at(3)), (1, 0, "later", "c", at(5)), (1, 1, "late", "d", at(5)),
                                  (1, 2, None, None, at(2)), (1, 2, "early", "e", at(1))],
                                 "deployment_id bigint, launch_pos int, public_ip string, private_ip string, observed_at string")
    told = told.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    as_of = F.lit(at(3)).cast("timestamp_ntz")
    df = B.attach_addresses(inst, told, as_of)
    got = {p: pub for p, pub in rows(df, "launch_pos", "public_ip")}
    assert df.count() == machines and got == {0: "new", 1: None, 2: None}
    assert {p: pub for p, pub in rows(B.attach_addresses(inst, told), "launch_pos", "public_ip")} == {0: "later", 1: "late", 2: None}
