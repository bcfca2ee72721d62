"""Passage dedup against a quadratic brute-force version."""

import pytest
from flotilla.llm.line_dedup import dedup_lines
from flotilla.llm.passages import dedup_passages
from texts import docs, frame, prose, rng


def brute(rows, min_words):
    """Lines all of whose words lie in windows of min_words words seen at an earlier place."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        words = text.split()
        hit = [False] * len(words)
        for k in range(len(words) - min_words + 1):
            window = tuple(words[k:k + min_words])
            if window in seen:
                hit[k:k + min_words] = [True] * min_words
            seen.add(window)
        kept, at = [], 0
        for line in text.split("\n"):
            a, at = at, at + len(line.split())
            near = hit[a:at] if a < at else hit[max(a - 1, 0):a + 1]
            if not near or not all(near):
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rnd = rng(seed)
    pool = [prose(rnd, rnd.choice([1, 2, 3, 5, 12]), 40) for _ in range(14)]
    rows = []
    for i in range(60):  # lines are broken anew, so passages begin and end inside them
        words = " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9))).split()
        rows.append((i, "".join(w + rnd.choice(["\n", "\n\n", " ", " ", " ", " "]) for w in words)))
    got = {r.doc_id: r.text for r in dedup_passages(frame(spark, rows, "doc_id long, text string"), min_words=8).collect()}
    assert got == brute(rows, 8)
    assert any(got[d] != t for d, t in rows)


def test_passage_that_begins_and_ends_inside_lines(spark):
    """63 shared words, 46 of them in whole lines: too few for whole lines, enough by words."""
    rnd = rng(9)
    head, tail = prose(rnd, 9, 10_000), prose(rnd, 8, 10_000)
    middle = [prose(rnd, 23, 10_000) for _ in range(2)]
    texts = [f"{prose(rnd, 5, 10_000)} {head}\n" + "\n".join(middle) + f"\n{tail} {prose(rnd, 5, 10_000)}" for _ in range(2)]
    first, last = texts[1].split("\n")[0], texts[1].split("\n")[-1]
    df = docs(spark, texts)
    assert [r.n_removed for r in dedup_lines(df).orderBy("doc_id").collect()] == [0, 0]
    assert [(r.text, r.n_removed) for r in dedup_passages(df).orderBy("doc_id").collect()] == [
        (texts[0], 0), (f"{first}\n{last}", 2)]


def test_edge_cases(spark):
    long = "\n".join(f"line {i} " + "x " * 30 for i in range(300))
    rows = [(None, "a b", "k"), (1, None, None), (2, "", "e"), (3, long, "x"), (4, long, None), (4, long, None), (None, None, None)]
    df = frame(spark, rows, "doc_id long, text string, N_lines string")
    got = dedup_passages(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert found == sorted([(None, "a b", 1, 0), (1, None, 0, 0), (2, "", 1, 0), (3, long, 300, 0), (4, "", 300, 300),
                            (4, "", 300, 300), (None, None, 0, 0)], key=str)
    assert dedup_passages(df.limit(0)).collect() == []
