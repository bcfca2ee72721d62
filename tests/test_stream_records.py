"""Records from a stream: parity with the batch result whatever the batches
are, restarts, repeated batches, idle deployments and late lines."""

import random

import pytest

from helpers import rows
from flotilla.operators import logs as E
from flotilla.schemas import LOG_LINES
from flotilla.session import scratch_path
from flotilla.streaming import records as SR

HEAD = "[2017-05-01T10:00:00] info: "


def lines_of(seed, deployments=5, n=30):
    r = random.Random(seed)
    return [(d, i, s, HEAD + f"{d}.{i}" if r.random() < 0.35 else f"  go on {i}.{s}")
            for d in range(deployments) for i in range(r.randrange(1, n)) for s in range(r.randrange(1, 3))]


def fed(spark, batches, idle=None):
    """Run the batches one by one through `carry`, as the stream does."""
    state, out = spark.createDataFrame([], SR.ROWS), []
    for lines in batches:
        got = SR.carry(spark.createDataFrame(lines, LOG_LINES), state, idle).select(*SR.COLUMNS).collect()
        out += [r for r in got if r["kind"] != "open"]
        state = spark.createDataFrame([(*r, 0) for r in got if r["kind"] == "open"], SR.ROWS)
    left = [r for r in state.collect() if r["text"] is not None]
    closed = sorted((r["deployment_id"], r["rec"], r["first_seq"], r["text"]) for r in [*out, *left] if r["kind"] in ("closed", "open"))
    return closed, sorted((r["deployment_id"], r["first_seq"], r["text"], r["reason"]) for r in out if r["kind"] == "late")


def whole(spark, lines):
    return sorted(rows(E.assemble_records(spark.createDataFrame(lines, LOG_LINES)), "deployment_id", "rec", "first_seq", "text"))


@pytest.mark.parametrize("seed,n_batches", [(1, 1), (2, 3), (3, 6)])
def test_parity_with_batch(spark, seed, n_batches):
    """Batches cut each deployment's lines anywhere, records included."""
    lines, r = lines_of(seed), random.Random(seed)
    batches = [[] for _ in range(n_batches)]
    for d in {x[0] for x in lines}:
        mine = [x for x in lines if x[0] == d]
        at = sorted(r.randrange(len(mine) + 1) for _ in range(n_batches - 1))
        for k, (a, b) in enumerate(zip([0, *at], [*at, len(mine)])):
            batches[k] += mine[a:b]
    for b in batches:
        r.shuffle(b)
    closed, late = fed(spark, batches)
    assert closed == whole(spark, lines) and late == []


def test_restarts_and_a_batch_tried_again(spark):
    """Four triggers, each in a query of its own; then the last batch runs again and changes nothing."""
    lines, base = lines_of(7), scratch_path(spark, "t-records")
    for k in range(4):
        part = [x for x in lines if x[1] // 8 == k]
        spark.createDataFrame(part, LOG_LINES).coalesce(1).write.mode("append").parquet(f"{base}/lines")
        q = SR.start(spark.readStream.schema(LOG_LINES).parquet(f"{base}/lines"), f"{base}/records", f"{base}/checkpoint")
        q.awaitTermination()
    got = sorted(rows(SR.records(spark, f"{base}/records")))
    assert got == whole(spark, lines)
    open_ones = SR._table(spark, f"{base}/records", "open").where("batch = 2").drop("batch")
    again = SR.carry(spark.createDataFrame([x for x in lines if x[1] // 8 == 3], LOG_LINES), open_ones)
    again.select(*SR.COLUMNS).write.mode("overwrite").partitionBy("kind").parquet(f"{base}/records/batch=3")
    assert sorted(rows(SR.records(spark, f"{base}/records"))) == got
    ended = rows(SR.records(spark, f"{base}/records", ended=False))
    assert set(ended) < set(got) and len(got) - len(ended) == len({x[0] for x in lines})


def test_late_lines_are_kept_apart(spark):
    first = [(1, 1, 0, HEAD + "a"), (1, 5, 0, HEAD + "b")]
    second = [(1, 5, 0, "again"), (1, 3, 0, HEAD + "late"), (1, 6, 0, "more"), (2, 1, 0, HEAD + "new")]
    closed, late = fed(spark, [first, second])
    assert closed == [(1, 1, 1, HEAD + "a"), (1, 2, 5, HEAD + "b\nmore"), (2, 1, 1, HEAD + "new")]
    assert late == [(1, 3, HEAD + "late", "order"), (1, 5, "again", "order")]


def test_idle_deployments_are_closed(spark):
    batches = [[(1, 1, 0, HEAD + "a"), (2, 1, 0, HEAD + "x")], [(2, 2, 0, "y")], [(2, 3, 0, "z")],
               [(1, 2, 0, "too late"), (1, 3, 0, HEAD + "b")]]
    closed, late = fed(spark, batches, idle=2)
    assert closed == [(1, 1, 1, HEAD + "a"), (1, 2, 3, HEAD + "b"), (2, 1, 1, HEAD + "x\ny\nz")]
    assert late == [(1, 2, "too late", "closed")]


def test_lines_before_the_first_header(spark):
    batches = [[(1, 1, 0, "lost")], [(1, 2, 0, "and more")], [(1, 3, 0, HEAD + "a")], []]
    closed, late = fed(spark, batches)
    assert closed == [(1, 0, 1, "lost\nand more"), (1, 1, 3, HEAD + "a")] and late == []


def test_empty_texts_stay_open(spark):
    closed, _ = fed(spark, [[(1, 1, 0, "")], [(1, 2, 0, "")], [(1, 3, 0, HEAD)]])
    assert closed == [(1, 0, 1, "\n"), (1, 1, 3, HEAD)]
