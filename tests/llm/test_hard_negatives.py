"""Hard negatives against scoring every pair, and exact products."""

import math

import numpy as np
import pytest
from flotilla.llm import hard_negatives
from flotilla.llm.hard_negatives import Best, NONE, mine, primes_for, products, residues
from texts import rng

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5):
    whole = []
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        whole.append((v, [math.floor(256 * float(np.float32(x))) for x in e], (lab + 1) % 10 if v % 7 == 0 else lab))
    out = []
    for a, va, la in whole:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, vb, lb in whole)
        for ps, p, _ in [s for s in scored if s[2] == la and s[1] != a][:k]:
            window = [s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:k]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(window, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(r, n, dim=6, labels=3, size=1.0, ids=None):
    return [(i if ids is None else ids[i], [r.uniform(-size, size) for _ in range(dim)], r.randrange(labels)) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(rng(), 700)
    got = result(mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows) and len(got) > 50


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BATCH", 13)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = vectors(rng(2), 300, dim=3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(mine(spark, df, every=10, anchors_a_block=4)) == brute(rows, 10)


def test_ties_go_by_id(spark):
    """Large groups of equal vectors, over several partitions."""
    r = rng(3)
    kinds = [[0.5, 0.25], [0.5, 0.2], [0.1, 0.9]]
    rows = [(v, kinds[r.randrange(3)], r.randrange(4)) for v in r.sample(range(2000), 400)] + [(100_000, kinds[0], 1)]
    r.shuffle(rows)
    assert result(mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 2), (2, [1.0, 0.5], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2),
            (6, [inf, 1.0], 2), (8, [1.0, 0.3], None), (9, [0.9, 0.5], 1), (None, [1.0, 0.5], 2), (200, None, 2), (10, [-inf, 0.0], 2)]
    got = result(mine(spark, spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)


def test_negative_and_zero_scores(spark):
    """A negative positive has no window; zero only meets zero."""
    rows = [(100, [0.5, 0.0], 1), (1, [-0.5, 0.0], 1), (2, [-0.5, 0.1], 2), (200, [0.5, 0.5], 3), (3, [0.0, 0.0], 3), (4, [0.5, -0.5], 4)]
    got = result(mine(spark, spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and any(g[4] == 0 for g in got) and not any(g[0] == 100 for g in got)


def test_no_positives_empty_table_empty_vectors(spark):
    lone = [(100, [1.0], 1), (1, [1.0], 2)]
    assert result(mine(spark, spark.createDataFrame(lone, SCHEMA))) == []
    out = mine(spark, spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = [(100, [], 1), (1, [], 1), (2, [], 2)]
    assert result(mine(spark, spark.createDataFrame(empty, SCHEMA))) == [(100, 1, 1, 2, 0, 0)]


def test_shorter_vectors_end_in_zeros(spark):
    rows = [(100, [1.0, 1.0, 1.0], 1), (1, [1.0], 1), (2, [0.9, 0.05], 2), (3, [1.0, 0.0, 0.0], 2), (4, [], 2)]
    padded = [(v, e + [0.0] * (3 - len(e)), lab) for v, e, lab in rows]
    assert result(mine(spark, spark.createDataFrame(rows, SCHEMA))) == brute(padded) != []


def test_repeated_rows(spark):
    """Every row counts: a repeated negative is drawn twice, a repeated anchor has its lists twice."""
    rows = [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2)]
    assert result(mine(spark, spark.createDataFrame(rows, SCHEMA))) == brute(rows) and len(brute(rows)) == 2
    twice = rows + [(100, [1.0], 1)]
    assert len(result(mine(spark, spark.createDataFrame(twice, SCHEMA)))) == 4


def test_other_columns_and_types(spark):
    rows = vectors(rng(5), 250, dim=4)
    df = spark.createDataFrame([(v, e, lab, 1, "x") for v, e, lab in rows],
                               "vec_id int, embedding array<float>, label long, score int, block string")
    assert result(mine(spark, df, every=50)) == brute(rows, 50)


def test_large_components(spark):
    """More primes where scores are larger; refused where longs could not hold them."""
    rows = vectors(rng(6), 120, dim=5, size=1e6)
    assert result(mine(spark, spark.createDataFrame(rows, SCHEMA), every=20)) == brute(rows, 20) != []
    with pytest.raises(ValueError):
        mine(spark, spark.createDataFrame([(100, [1e30], 1)], SCHEMA))


@pytest.mark.parametrize("dim,size", [(64, 140), (1, 5), (3, 10 ** 9), (2500, 256), (64, 10 ** 8), (0, 1)])
def test_products_are_exact(dim, size):
    r = np.random.default_rng(dim + size)
    a, b = r.integers(-size, size + 1, (30, dim)), r.integers(-size, size + 1, (20, dim))
    primes = primes_for(dim, max(1, dim * size * size))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert products(residues(a, primes), residues(b, primes), primes).tolist() == want


def test_best_keeps_order():
    best = Best(1, 3, np.array([0]))
    best.take(np.array([[5, 7, NONE, 5]]), np.array([4, 6, 7, 9]))
    best.take(np.array([[5, -1, 7]]), np.array([1, 2, 3]))
    assert list(zip(*(c.tolist() for c in best.rows()))) == [(0, 3, 7), (0, 6, 7), (0, 1, 5)]
