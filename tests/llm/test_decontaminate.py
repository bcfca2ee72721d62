"""Wu-Manber search against looking everywhere."""

import re

import pytest
from flotilla.llm import decontaminate as D
from texts import docs, frame, prose, rng

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(text, items, window=10):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        grams = [iw[k:k + window] for k in range(max(1, len(iw) - window + 1))] if iw else []
        for g in grams:
            for k in range(len(ws) - len(g) + 1):
                if ws[k:k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    found.add("" if item is None else str(item))
    return len(ws), sorted(hit), sorted(found)


def check(got, texts, items):
    for r in got:
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, len(hit), found, bool(hit))
        assert [k for h in r.hits for k in range(h.start, h.stop)] == hit


def case(seed):
    rnd = rng(seed)
    items = [(i, prose(rnd, rnd.choice([1, 2, 3, 9, 10, 11, 30]), 6 if i % 3 == 0 else 60)) for i in range(40)]
    items += [(100, None), (101, ""), (102, "?! ..."), (7, items[3][1]), (103, items[8][1])]
    texts = []
    for _ in range(60):
        parts = [prose(rnd, rnd.randint(0, 30), rnd.choice([6, 60])) for _ in range(3)]
        parts.insert(1, rnd.choice(items)[1] or "")
        texts.append(rnd.choice([" ", ", ", "\n"]).join(parts).upper() if rnd.random() < .3 else " ".join(parts))
    return texts + [None, "", "w1"], items


@pytest.mark.parametrize("block", [5, 40, 10**6])
def test_random(spark, block):
    texts, items = case(block)
    got = D.mark(spark, docs(spark, texts), frame(spark, items, "item_id long, text string"), block=block).collect()
    assert len(got) == len(texts)
    check(got, texts, items)


def test_long_text_is_read_piece_by_piece(monkeypatch):
    texts, items = case(11)
    patterns = [(b" ".join(g).decode(), str(i)) for i, t in items for w in [words(t)] if w
                for g in [w[k:k + 10] for k in range(max(1, len(w) - 9))]]
    tables = D.build(patterns)
    text = " ".join(t or "" for t in texts)
    whole = D.scan_text(text.encode(), tables)
    import flotilla.llm.common as C
    monkeypatch.setattr(D, "alnum_words", lambda data: (C.ALNUM.findall(p.lower()) for p in C.pieces(data, C.NOT_ALNUM, 40)))
    assert D.scan_text(text.encode(), tables) == whole
    assert [k for a, z in whole[1] for k in range(a, z)] == brute(text, items)[1]


def test_edge_cases(spark):
    df = frame(spark, [(1, "one two", "x"), (1, "one two", "x"), (None, None, None)], "doc_id long, text string, Items string")
    items = frame(spark, [(None, "one two")], "item_id long, text string")
    got = D.mark(spark, df, items)
    assert [r.contaminated for r in got.orderBy("doc_id").collect()] == [False, True, True]
    assert "Items" not in got.columns
    none = items.limit(0)
    assert not any(r.contaminated for r in D.mark(spark, df, none).collect())
    assert D.mark(spark, df.limit(0), items).collect() == []
    kept = D.decontaminate(spark, df, items)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(None, None, None)]
