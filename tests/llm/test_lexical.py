"""Ranked search against scoring every document, and the bounds it rests on."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from flotilla.llm import lexical
from flotilla.llm.lexical import build_index, rank_documents, search
from texts import docs, frame, prose, rng

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, items, top=10):
    """[(item_id, rank, doc_id, score)] from rows of (doc_id, text), by item."""
    counted = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, rows, schema="item_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_against_brute_force(spark):
    r = rng()
    texts = [prose(r, r.randrange(0, 60), 90) for _ in range(150)] + [prose(r, 3000, 5000), None, "", "!!", "É é Wö-rd w1 W1"] + ["w1 w2 w3"] * 12
    items = [(i, prose(r, r.randrange(1, 25), 100)) for i in range(12)] + [(50, "w1 w1 W2 w3"), (51, None), (52, ""), (53, "unseen"), (54, "É é wö")]
    rows = list(enumerate(texts))
    got = found(rank_documents(spark, docs(spark, texts).repartition(5), items_of(spark, items)))
    assert got == sorted(brute(rows, items), key=repr)
    assert {g[0] for g in got} >= {50, 54} and not {51, 52, 53} & {g[0] for g in got}


def test_small_blocks_and_batches(spark, monkeypatch):
    """Blocks of few terms and narrow sketches: same result, more scans, looser bounds."""
    for name, value in (("BLOCK_TERMS", 15), ("BLOCK_QUERIES", 2), ("BATCH", 7), ("GATHER", 3)):
        monkeypatch.setattr(lexical, name, value)
    r = rng(9)
    texts = [prose(r, r.randrange(1, 40), 60) for _ in range(80)]
    items = [(i, prose(r, 10, 70)) for i in range(7)]
    got = found(rank_documents(spark, docs(spark, texts).coalesce(2), items_of(spark, items).coalesce(1)))
    assert got == sorted(brute(list(enumerate(texts)), items), key=repr)


def test_bounds_hold():
    r = rng(3)
    texts = [prose(r, r.randrange(1, 400), 300).encode() for _ in range(60)] + [b"w1 " * 700]
    counts = [lexical.term_counts(t) for t in texts]
    vocabulary = sorted({t for c in counts for t in c})[:200]
    weights = np.array([[r.randrange(0, 9000) for _ in range(5)] for _ in vocabulary], np.int64)
    q = lexical.Queries(vocabulary, weights, len(texts), sum(sum(c.values()) for c in counts))
    sketches, exact, norms = [], [], []
    for c in counts:
        tf = np.array(list(c.values()), "<i4")
        norms.append(lexical.norm(int(tf.sum()), q.n_docs, q.n_terms))
        sketches.append(lexical.packed(lexical.sketch_of(np.array([lexical.hashed(t) for t in c], np.uint64), tf)))
        exact.append(q.exact(b"\n".join(c), tf.tobytes(), norms[-1]))
    bounds = q.bounds(sketches, np.array(norms))
    assert (bounds >= np.array(exact)).all()
    assert (bounds[:60] <= 3 * np.array(exact)[:60] + 1e6).mean() > 0.9  # and are of use


def test_few_documents_are_scored(spark):
    """Documents whose bound is under the worst hit are never opened."""
    r = rng(4)
    texts = [prose(r, 50, 4000) for _ in range(400)]
    counts = [lexical.term_counts(t.encode()) for t in texts]
    vocabulary = sorted(lexical.term_counts(texts[7].encode()))
    q = lexical.Queries(vocabulary, np.full((len(vocabulary), 1), 5000, np.int64), 400, 400 * 50, top=1)

    class Column(list):
        opened = 0

        def __getitem__(self, i):
            Column.opened += 1
            return super().__getitem__(i)

    class Value:
        def __init__(self, v):
            self.v = v

        def as_py(self):
            return self.v
    tf = [np.array(list(c.values()), "<i4") for c in counts]
    sketches = [lexical.packed(lexical.sketch_of(np.array([lexical.hashed(t) for t in c], np.uint64), x)) for c, x in zip(counts, tf)]
    q.search(list(range(400)), [50] * 400, Column([Value(b"\n".join(c)) for c in counts]), [Value(x.tobytes()) for x in tf], sketches)
    assert q.hits[0][0][2] == 7 and Column.opened < 10


def test_ties_repeated_rows_and_nulls(spark):
    rows = [(5, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (5, "alpha beta"), (9, "gamma"), (1, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "alpha"), (1, "alpha"), (None, "gamma")]
    got = found(rank_documents(spark, d, items_of(spark, items)))
    assert got == sorted(brute(rows, items), key=repr)
    assert [g[2] for g in got if g[0] == 1][:2] == [3, 3]


def test_more_ties_than_places(spark):
    rows = [(100 - i, "alpha") for i in range(60)] + [(1000 + i, "beta gamma delta") for i in range(70)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(rank_documents(spark, d, items_of(spark, [(1, "alpha beta")])))
    assert got == sorted(brute(rows, [(1, "alpha beta")]), key=repr)


def test_empty_tables_and_other_columns(spark):
    some, none = docs(spark, ["alpha"]), docs(spark, [])
    assert found(rank_documents(spark, none, items_of(spark, [(1, "alpha")]))) == []
    assert found(rank_documents(spark, some, items_of(spark, []))) == []
    assert found(rank_documents(spark, docs(spark, [None, "!"]), items_of(spark, [(1, "alpha")]))) == []
    clash = frame(spark, [(1, "alpha beta", 7, "x")], "doc_id int, text string, n long, terms string")
    items = spark.createDataFrame([("a", "alpha alpha gamma", 3)], "item_id string, text string, score long")
    got = found(rank_documents(spark, clash, items))
    assert got == brute([(1, "alpha beta")], [("a", "alpha alpha gamma")])


def test_text_ids_are_refused(spark):
    with pytest.raises(ValueError):
        build_index(frame(spark, [("a", "b")], "doc_id string, text string"))


def test_very_long_text_and_query(spark):
    r = rng(6)
    long = prose(r, 60_000, 30_000)
    texts = [long, "w1 w2", prose(r, 400, 30_000)]
    items = [(1, prose(r, 30_000, 30_000)), (2, "w1")]
    got = found(rank_documents(spark, docs(spark, texts), items_of(spark, items)))
    assert got == sorted(brute(list(enumerate(texts)), items), key=repr)


def test_whole_numbers_beyond_float(spark):
    """Scores that floats cannot hold are still exact."""
    q = lexical.Queries([b"a", b"b"], np.array([[2 ** 42], [3]], np.int64), 10, 100)
    got = q.exact(b"a\nb", np.array([3, 1], "<i4").tobytes(), 40)
    assert int(got[0]) == 2 ** 42 * lexical.impact(3, 40) + 3 * lexical.impact(1, 40)


def test_index_is_reused(spark):
    index = build_index(docs(spark, ["alpha beta", "beta"]))
    for item in ("alpha", "beta"):
        assert found(search(spark, index, items_of(spark, [(1, item)]))) == brute([(0, "alpha beta"), (1, "beta")], [(1, item)])
