"""Line dedup against a quadratic brute-force version."""

import pytest
from flotilla.llm.line_dedup import dedup_lines, windows
from texts import docs, frame, prose, rng


def brute(rows, min_words):
    """Lines that lie in a run of >= min_words words occurring at an earlier place."""
    rows = sorted(rows, key=lambda r: r[0])
    out, seen = {}, set()
    for d, text in rows:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = tuple(lines[i:j + 1])
                if sum(len(x.encode().split()) for x in run) >= min_words:
                    if run in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(run)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rnd = rng(seed)
    lines = [prose(rnd, rnd.choice([0, 1, 2, 3, 5, 12])) for _ in range(14)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows, "doc_id long, text string"), min_words=8).collect()}
    assert got == brute(rows, 8)


def test_windows_cover_runs():
    lines = [b"a b c", b"d", b"", b"e f g h i j", b"k"]
    assert windows(lines, 4) == [(0, 1), (0, 2), (1, 3), (2, 3), (3, 3), (3, 4)]
    assert windows([], 4) == [] and windows([b"a"], 4) == []


def test_passage_is_cut_from_later_documents_only(spark):
    rnd = rng()
    passage = prose(rnd, 70, 10_000)
    own = [prose(rnd, 60, 10_000) for _ in range(5)]
    texts = [f"{own[i]}\n{passage}\nshort note" for i in range(4)] + [f"short note\n{own[4]}"]
    got = [r.text for r in dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[4] == texts[4]
    # the note behind the passage belongs to the repeated run; alone it stays
    assert got[1:4] == own[1:4]


def test_edge_cases(spark):
    long = "\n".join(f"line {i} " + "x " * 30 for i in range(3000))
    rows = [(None, "a b", "k"), (1, None, None), (2, "", "e"), (3, long, "x"), (4, long, None), (4, long, None), (None, None, None)]
    df = frame(spark, rows, "doc_id long, text string, N_lines string")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert found == sorted([(None, "a b", 1, 0), (1, None, 0, 0), (2, "", 1, 0), (3, long, 3000, 0), (4, "", 3000, 3000),
                            (4, "", 3000, 3000), (None, None, 0, 0)], key=str)
    assert dedup_lines(df.limit(0)).collect() == []


def test_matches_end_inside_extents(spark):
    """Shared runs that begin and end anywhere between lines, in many surroundings."""
    rnd = rng(12)
    shared = [prose(rnd, rnd.choice([1, 3, 6]), 10_000) for _ in range(12)]
    rows = []
    for i in range(80):
        a = rnd.randrange(12)
        own = [prose(rnd, rnd.choice([0, 2, 4, 9]), 10_000) for _ in range(6)]
        rows.append((i, "\n".join(own[:3] + shared[a:a + rnd.randint(1, 9)] + own[3:])))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows, "doc_id long, text string").repartition(3), min_words=10).collect()}
    assert got == brute(rows, 10) and sum(got[i] != t for i, t in rows) > 20


def test_positions_are_fewer_than_windows_and_cover_them():
    from flotilla.llm.line_dedup import select
    rnd = rng(3)
    texts = ["\n".join(prose(rnd, rnd.choice([0, 1, 4, 9])) for _ in range(60)).encode() for _ in range(5)] + [b"", b"a b", b"\n\n"]
    owner, _, _, _, start, stop, parts = select(texts, 12)
    every = {(t, *w) for t, text in enumerate(texts) for w in windows(text.split(b"\n"), 12)}
    got = [(int(o), int(a) + w["start"], int(a) + w["stop"] - 1) for o, a, ws in zip(owner, start, parts.to_pylist()) for w in ws]
    assert len(got) == len(set(got)) and set(got) == every and len(owner) < len(every) * 0.8
    assert all(a <= s and e < z for (_, s, e), a, z in zip(got, [a for a, ws in zip(start, parts.to_pylist()) for _ in ws], [z for z, ws in zip(stop, parts.to_pylist()) for _ in ws]))


def test_equal_runs_have_equal_hashes_and_others_not():
    import numpy as np
    from flotilla.llm.line_dedup import Runs, least
    rnd = np.random.default_rng(4)
    lines = rnd.integers(0, 3, 400)
    hashes = rnd.integers(0, 2 ** 63, (3, 2)).astype(np.uint64)[lines]
    first = rnd.integers(0, 400, 3000)
    last = np.minimum(first + rnd.integers(0, 6, 3000), 399)
    runs = Runs(hashes)
    found = {}
    for a, z, x, y in zip(first, last, *runs.of(first, last)):
        found.setdefault(tuple(lines[a:z + 1]), set()).add((int(x), int(y)))
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == len(found)
    got = least(hashes[:, 0], first, last)
    assert got.tolist() == [int(a + np.argmin(hashes[a:z + 1, 0])) for a, z in zip(first, last)]


def test_many_blank_lines_take_no_quadratic_time():
    import time
    from flotilla.llm.line_dedup import select
    start = time.process_time()
    select([b"\n" * 16_000 + b"x " * 80], 50)
    assert time.process_time() - start < 1
