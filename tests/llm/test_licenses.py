"""License scan against comparing every block with every template."""

import pytest
from flotilla.llm import licenses as L
from texts import docs, frame, prose, rng


def brute(text, templates=L.TEMPLATES):
    words = L.ALNUM.findall((text or "").encode().lower())
    bases = [(k, label) for label, p in L.PHRASES for pw in [p.encode().split()]
             for k in range(len(words)) if words[k:k + len(pw)] == pw]
    best = {}
    for s in range(0, max(1, len(words)), L.STEP):
        if s and s + L.BLOCK - L.STEP >= len(words):
            break
        block = set(words[s:s + L.BLOCK])
        for label, threshold, t in templates:
            tokens = L.token_set(t)
            share = len(tokens & block) / len(tokens)
            if share >= threshold:
                key = (label, s, min(s + L.BLOCK, len(words)))
                best[key] = max(share, best.get(key, 0))
    labels = {b for _, b in bases}
    return (len(words), len(bases), min(bases)[0] if bases else None, max(bases)[0] if bases else None, ",".join(sorted(labels)),
            ",".join(sorted(labels | {k[0] for k in best})), 1.0 if bases else max(best.values(), default=0.0),
            [(*k, v) for k, v in sorted(best.items())])


def values(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
            [(b.label, b.start, b.stop, b.containment) for b in r.blocks])


def notice(rnd, drop):
    """A template's text without some of its words, between prose."""
    words = rnd.choice(L.TEMPLATES)[2].split()
    for _ in range(drop):
        words.pop(rnd.randrange(len(words)))
    return f"{prose(rnd, rnd.randint(0, 90))} {' '.join(words)} {prose(rnd, rnd.randint(0, 90))}"


def cases():
    rnd = rng(6)
    texts = [notice(rnd, k % 9) for k in range(90)]
    texts += ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
              "under the mit license under the MIT license, cc by nc", "under the mit", "", None, "...", "mit license under the"]
    texts += [prose(rnd, n) for n in (31, 32, 33, 63, 64, 65, 96, 97, 700)]
    return texts


def test_against_brute_force(spark):
    texts = cases()
    got = L.scan_licenses(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert values(r) == brute(texts[r.doc_id])
    assert sum(bool(r.labels) for r in got) > 40


def test_long_text_is_read_piece_by_piece(monkeypatch):
    text = " \n".join(t or "" for t in cases())
    index = L.build_index(L.TEMPLATES, {})
    spoken = [(label, p.encode().split()) for label, p in L.PHRASES]
    import flotilla.llm.common as C
    for size in (30, 1000):
        monkeypatch.setattr(L, "alnum_words", lambda data: (C.ALNUM.findall(p.lower()) for p in C.pieces(data, C.NOT_ALNUM, size)))
        r = L.scan_text(text.encode(), index, spoken)
        want = brute(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (*want[:4], want[5])
        assert [(b["label"], b["start"], b["stop"], b["containment"]) for b in r["blocks"]] == want[7]


def test_token_order_changes_nothing(spark):
    texts = [t for t in cases() if t]
    rnd = rng(8)
    spoken = [(label, p.encode().split()) for label, p in L.PHRASES]
    counts = {t: rnd.randrange(50) for x in L.TEMPLATES for t in L.token_set(x[2])}
    a, b = L.build_index(L.TEMPLATES, {}), L.build_index(L.TEMPLATES, counts)
    for t in texts:
        assert L.scan_text(t.encode(), a, spoken) == L.scan_text(t.encode(), b, spoken)


def test_token_counts(spark):
    df = docs(spark, ["a b a", "B c", None, "a"])
    assert L.token_counts(df, {b"a", b"b", b"z"}) == {b"a": 2, b"b": 2}


def test_edge_cases(spark):
    df = frame(spark, [(None, None, None), (1, "under the MIT license", "x"), (1, "under the MIT license", "x")],
               "doc_id long, text string, LABELS string")
    got = L.scan_licenses(df)
    assert "LABELS" not in got.columns and sorted(r.labels for r in got.collect()) == ["", "mit", "mit"]
    assert L.scan_licenses(df.limit(0)).collect() == []
    assert [r.score for r in L.scan_licenses(df, templates=(), phrases=()).collect()] == [0.0] * 3
    with pytest.raises(ValueError):
        L.scan_licenses(df, templates=L.TEMPLATES * 100)


def test_long_templates_are_found_at_any_offset(spark):
    """Full license texts: over 33 words, and over 64 distinct ones."""
    for size in (40, 64, 65, 300):
        template = " ".join(f"law{k}" for k in range(size))
        texts = [" ".join(["some"] * at + [template] + ["more"] * 70) for at in (0, 1, 20, 31, 33, 50, 63, 64, 250)] + ["law1 law2"]
        got = L.scan_licenses(docs(spark, texts), templates=[("long", 1.0, template), *L.TEMPLATES]).orderBy("doc_id").collect()
        assert [(r.labels, r.score) for r in got] == [("long", 1.0)] * 9 + [("", 0.0)]
        for r in got[:9]:
            at = texts[r.doc_id].split().index("law0")
            assert all(b.start <= at and b.stop >= at + size for b in r.blocks)
