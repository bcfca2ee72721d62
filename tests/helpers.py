"""Hand-made inputs for unit tests (the registered queries read the driver's
tables; these small frames pin down single cases)."""

from flotilla.schemas import ALLOWED_CIDRS, CONFIG_OVERRIDES, DEPLOYMENT_REQUESTS

SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Collected rows as plain tuples (optionally of selected columns)."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]


def request(spark, deployment_id=1, nb_cws=3, k=2, workers=2, wk=2, config_phase=True, **extra):
    row = {
        "deployment_id": deployment_id, "id": f"op-{deployment_id}", "title": f"Operation {deployment_id}",
        "nb_workers_instances": workers, "nb_workers_per_instance": wk, "nb_cws_instances": nb_cws,
        "nb_cws_per_instance": k, "config_phase": config_phase, "main_instance_type": "t2.micro",
        "workers_instances_type": "t2.micro", "cws_instances_type": "t2.micro", "cms_contest": 1,
        "requested_at": None,
    }
    row.update(extra)
    return row


def requests_df(spark, *reqs):
    cols = [f.name for f in DEPLOYMENT_REQUESTS.fields]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in reqs], DEPLOYMENT_REQUESTS)


def cidrs_df(spark, rows):
    return spark.createDataFrame(rows, ALLOWED_CIDRS)


def overrides_df(spark, rows):
    return spark.createDataFrame(rows, CONFIG_OVERRIDES)
