"""Quality rules: counts against a plain version, verdicts on planted lines."""

import re
from collections import Counter

import pytest
from flotilla.llm import quality as Q
from texts import docs, frame, prose, rng


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search("[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_counts(spark):
    rnd = rng(4)
    texts = [None, "", " \n\t", "a", "é ü 日本 x y\x1cz", "a b c d e f a b c d e", "x " * 40]
    for _ in range(200):
        parts = [rnd.choice(["w1", "w2", "w3", "|", "#x", "日", "<b>", "é%"]) for _ in range(rnd.randint(0, 40))]
        texts.append("".join(p + rnd.choice([" ", "\n", "  ", "\t", "\r\n"]) for p in parts))
    got = Q.judge_documents(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), t
        assert not (r.kept and r.base_failed)


GOOD = "The river was high that spring, and nobody crossed it before May."


@pytest.mark.parametrize("line,rule", [
    (GOOD, ""), ("", ""), ("A heading", ""), ("Was that so? Yes!", ""), ("It cost $5, or 10% of it.", ""),
    ("Home | News | Sport | Contact |", "symbols"), ("the### of$$$ and%%% so&&& on***", "symbols"), ("Next page", "navigation"), ("# Title", ""), ("C# rules", ""),
    ("Next steps of the whole study", ""), ("Sûr du mûr", ""), ("News » Sport » Local", "navigation"), ("Back to the top", "navigation"),
    ("or a | b", "navigation"), ("He chose either the left | or the right one in the end.", ""),
    ("BUY!! NOW!! IT!! IS!! CHEAP!!", "shouting"), ("spam " * 30, "repeated word"), ("All rights reserved.", "boilerplate"),
    ("1 2 3 4 5 6 7", "no letters"), (" ".join(f"w{k}" for k in range(50)), "no punctuation")])
def test_lines(line, rule):
    assert Q.line_fails(line.encode()) == rule


def test_document_is_rejected_if_it_loses_too_much(spark):
    bad = "the### of$$$ and%%% so&&& on***"
    texts = [f"{GOOD}\n{bad}", f"{GOOD}\n" + "\n".join(f"{bad} x{k}###" for k in range(9))]
    got = Q.judge_documents(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False] and got[0].clean_text == GOOD
    assert 0 < got[0].lost <= Q.MAX_LOST < got[1].lost


def test_labels_agree(spark):
    """On the given documents the verdict is the planted quality label, base failures aside."""
    sf = "/root/testdata/sf0.01"
    judged = Q.judge_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    both = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    right = both.filter("kept = (quality = 1)").count() / both.count()
    assert right > 0.97 and both.filter("quality = 1 and not kept").count() == 0


def test_edge_cases(spark):
    long = (GOOD + "\n") * 1 + prose(rng(), 200_000, 10**6) + "."
    df = frame(spark, [(None, None, None), (1, long, True), (1, GOOD, False), (1, GOOD, False)], "doc_id long, text string, KEPT boolean")
    got = Q.judge_documents(df)
    assert got.columns.count("kept") == 1 and "KEPT" not in got.columns and got.count() == 4
    kept = Q.clean_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.KEPT) for r in kept.collect()) == sorted([(1, long, True), (1, GOOD, False), (1, GOOD, False)])
    assert Q.clean_documents(df.limit(0)).collect() == []
