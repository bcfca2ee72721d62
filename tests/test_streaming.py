"""Streaming parity: the stateless log operators on readStream with an
availableNow trigger give the batch result."""


from helpers import SF_SMALL
from flotilla.operators import logs as E
from flotilla.sources import fixtures as fx
from flotilla.streaming import logs as S


def test_format_stream_equals_batch(spark):
    out = S.run_to_parquet(S.formatted_log_stream(spark, SF_SMALL), spark, "t-e1")
    got = spark.read.parquet(out)
    want = E.format_log(fx.log_records(spark, SF_SMALL))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_parse_stream_equals_batch(spark):
    out = S.run_to_parquet(S.parsed_log_stream(spark, SF_SMALL), spark, "t-e4")
    got = spark.read.parquet(out).select("deployment_id", "seq", "ts", "status", "message")
    want = fx.log_records(spark, SF_SMALL)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_style_stream_equals_batch(spark):
    out = S.run_to_parquet(S.styled_log_stream(spark, SF_SMALL), spark, "t-e2")
    got = spark.read.parquet(out)
    want = E.style_log(fx.log_records(spark, SF_SMALL))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_status_count_stream_complete_mode(spark):
    out_q = (S.status_count_stream(spark, SF_SMALL).writeStream.format("memory").queryName("t_e5")
             .outputMode("complete").trigger(availableNow=True).start())
    out_q.awaitTermination()
    got = spark.table("t_e5")
    want = E.status_counts(fx.log_records(spark, SF_SMALL))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# -- counts by time window -------------------------------------------------------------

def _at(day, hour=0):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def _windows(spark, batches):
    """Feed the batches through both queries, each started anew: (counts, late, rows of state after each)."""
    from flotilla.schemas import LOG_RECORDS
    from flotilla.session import scratch_path
    base, held = scratch_path(spark, "t-windows"), []
    for recs in batches:
        spark.createDataFrame(recs, LOG_RECORDS).coalesce(1).write.mode("append").parquet(f"{base}/records")
        stream = spark.readStream.schema(LOG_RECORDS).parquet(f"{base}/records")
        q = S.start_window_counts(stream, f"{base}/counts", f"{base}/c1", "1 day", "1 day")
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        S.start_late_counts(stream, f"{base}/late", f"{base}/c2", "1 day", "1 day").awaitTermination()
    counts = {(r["deployment_id"], r["window_start"]): tuple(r[2:]) for r in spark.read.parquet(f"{base}/counts").collect()}
    late = {(r["deployment_id"], r["window_start"]): r["late"] for r in S.late_window_counts(spark, f"{base}/late").collect()}
    return counts, late, held


def test_windows_close_late_records_are_counted_apart_and_state_goes(spark):
    days = 12
    batches = [[(d, 10 * day + d, _at(day, d), "info" if d else "danger", "x") for d in range(5)] for day in range(days)]
    batches[6] += [(1, 900, _at(2, 3), "info", "late"), (1, 901, _at(5, 3), "info", "in time")]
    counts, late, held = _windows(spark, batches)
    closed = range(days - 2)  # the last watermark is within the day before the last
    want = {(d, _at(day)): ((1, 0, 0, 0, 0) if d else (0, 0, 0, 1, 0)) for d in range(5) for day in closed}
    want[1, _at(5)] = (2, 0, 0, 0, 0)
    assert counts == want
    assert late == {(1, _at(2)): 1}
    assert max(held) <= 5 * 3 and held[-1] <= 5 * 3  # open windows only, not 5 * 12


def test_windows_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        counts, late, _ = _windows(spark, [[(1, 1, _at(0, 1), "info", "x"), (1, 2, _at(0, 23), "info", "x")], [(1, 3, _at(9), "info", "x")]])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert counts == {(1, _at(0)): (2, 0, 0, 0, 0)} and late == {}
