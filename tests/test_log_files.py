"""Raw log files: line numbers by splits, records over split and file edges."""

import os
import random
import re

import pytest

from helpers import SF_SMALL, rows
from flotilla.operators import logs as E
from flotilla.schemas import LOG_LINES
from flotilla.session import scratch_path
from flotilla.sources import fixtures as fx
from flotilla.sources.log_files import read_log_files, write_log_files

HEAD = "[2017-05-01T10:00:00] info: "


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few lines."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(logs):
    """[(id, rec, first line, text)] from {id: [lines]}."""
    out = []
    for d, lines in logs.items():
        rec, found = 0, {}
        for no, line in enumerate(lines, 1):
            rec += "] info: " in line
            found.setdefault(rec, []).append((no, line))
        out += [(d, r, ls[0][0], "\n".join(x for _, x in ls)) for r, ls in found.items()]
    return sorted(out)


def logs_of(seed, deployments, most):
    r = random.Random(seed)
    return {d: [HEAD + f"m{i}" if r.random() < 0.4 else r.choice(["  more", "", "a\rb", "x y", "é" * r.randrange(60)])
                for i in range(r.randrange(1, most))] for d in range(deployments)}


def written(spark, logs, per_file=None):
    data = [(d, i // 3, i % 3, line) for d, lines in logs.items() for i, line in enumerate(lines)]
    return write_log_files(spark.createDataFrame(data, LOG_LINES).repartition(5), scratch_path(spark, "t-logs"), per_file)


@pytest.mark.parametrize("per_file", [None, 4])
def test_records_over_splits_and_files(spark, small_splits, per_file):
    logs = logs_of(1, 4, 120)
    raw = read_log_files(spark, written(spark, logs, per_file))
    splits = raw.select("deployment_id", "file", "block").distinct().count()
    assert splits > 20 and raw.where("block > 0").count() > 0 or per_file
    assert sorted(rows(E.assemble_files(raw), "deployment_id", "rec", "first_line", "text")) == brute(logs)


def test_line_numbers_are_gapless(spark, small_splits):
    logs = logs_of(2, 3, 200)
    got = {}
    for d, no, line in sorted(rows(E.number_lines(read_log_files(spark, written(spark, logs, 9))), "deployment_id", "line_no", "line")):
        got.setdefault(d, []).append((no, line))
    assert got == {d: list(enumerate(lines, 1)) for d, lines in logs.items()}


def test_same_rows_as_numbered_lines(spark):
    """The files of the fixture give the records that its numbered lines give."""
    lines = fx.log_lines(spark, SF_SMALL)
    raw = read_log_files(spark, write_log_files(lines, scratch_path(spark, "t-logs"), 7))
    got = E.assemble_files(raw).select("deployment_id", "rec", "text")
    want = E.assemble_records(lines).select("deployment_id", "rec", "text")
    assert sorted(rows(got)) == sorted(rows(want))


def test_one_large_deployment_is_read_by_many_tasks(spark, small_splits):
    logs = {7: [HEAD + str(i) if i % 5 == 0 else "go on" for i in range(900)]}
    raw = read_log_files(spark, written(spark, logs))
    assert raw.rdd.getNumPartitions() > 10
    sizes = [r["count"] for r in raw.groupBy("file", "block").count().collect()]
    assert max(sizes) < 40  # what a window holds
    assert sorted(rows(E.assemble_files(raw), "deployment_id", "rec", "first_line", "text")) == brute(logs)


def test_no_window_without_a_key(spark):
    raw = read_log_files(spark, written(spark, {1: [HEAD + "a", "b"]}))
    plan = E.assemble_files(raw)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_lines_before_the_first_header_and_no_header(spark):
    logs = {1: ["lost", HEAD + "a"], 2: ["none", "at all"], 3: [""]}
    raw = read_log_files(spark, written(spark, logs))
    assert sorted(rows(E.assemble_files(raw), "deployment_id", "rec", "first_line", "text")) == brute(logs)


def test_more_than_a_thousand_files_follow_each_other(spark):
    """The names of a deployment's files keep their order, however many there are."""
    logs = {5: [HEAD + str(i) if i % 3 == 0 else f"go on {i}" for i in range(1100)]}
    raw = read_log_files(spark, written(spark, logs, 1))
    assert sorted(rows(E.assemble_files(raw), "deployment_id", "rec", "first_line", "text")) == brute(logs)


def test_tasks_write_the_files_and_leave_nothing_else(spark):
    """Spark's sink starts processes for each local file and its checksum file."""
    path = written(spark, logs_of(3, 5, 60), 4)
    base = path.replace("file:", "")
    found = sorted(os.path.relpath(os.path.join(f, n), base) for f, _, names in os.walk(base) for n in names)
    assert found[0] == "_SUCCESS" and all(re.fullmatch(r"deployment_id=\d+/part-\d{6}-\d{9}\.txt", n) for n in found[1:])
    with pytest.raises(FileExistsError):
        write_log_files(spark.createDataFrame([], LOG_LINES), path)


def test_lines_without_deployment_or_text(spark):
    path = write_log_files(spark.createDataFrame([(None, 1, 0, "a"), (3, 1, 0, None), (3, 2, 0, "é\r")], "deployment_id bigint, seq bigint, sub_no int, line string"), scratch_path(spark, "t-logs"))
    assert sorted(rows(read_log_files(spark, path), "deployment_id", "line"), key=repr) == [(3, ""), (3, "é\r"), (None, "a")]
