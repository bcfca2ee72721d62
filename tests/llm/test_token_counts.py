"""Token counts against the library on whole texts."""

import pytest
from flotilla.llm import token_counts
from flotilla.llm.queries import QUERIES, TOKENIZER
from flotilla.llm.token_counts import BOUNDARY, Counter, byte_batches, count_tokens, pieces, spans, splits_at_blanks
from texts import docs, frame, prose, rng
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "é", "漢", "。", "1", "'s", "'", ".", "<|endoftext|>", "\x1c", "\x85",
       " ", "!", " '", "’s", "​", "😀", "The", "\x00", "\r\n"]


def library(texts, file=TOKENIZER):
    t = Tokenizer.from_file(file)
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(n, seed=1):
    r = rng(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(40))) for _ in range(n)]


def test_query_equals_library(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 512) for r, n in zip(texts, library([r["text"] for r in texts]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == want


def test_odd_texts():
    texts = odd_texts(8000)
    assert Counter(TOKENIZER).count(texts) == library(texts)


def test_small_spans_calls_and_memory(monkeypatch):
    """Every cut that may be made is made, and nothing is remembered for long."""
    monkeypatch.setattr(token_counts, "spans", lambda t: spans(t, 3))
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 50)
    texts = odd_texts(1500, 2)
    assert Counter(TOKENIZER, call_bytes=20, remembered=300).count(texts) == library(texts)


def test_pieces_and_spans_hold_everything():
    for t in odd_texts(3000, 5):
        assert " ".join(pieces(t)) == t and "".join(spans(t, 4)) == t
        assert all(s.startswith(" ") for s in list(spans(t, 4))[1:])
    assert BOUNDARY.search("a b") and not BOUNDARY.search("　 b")


def test_batches_of_equal_bytes():
    sizes = [3, 3, 3, 50, 1, 1, 1]
    got = list(byte_batches(enumerate(sizes), 6))
    assert got == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(byte_batches([], 6)) == []


def test_tokenizers_without_known_boundaries_read_whole_texts():
    other = "/opt/tokenizers/word_bpe_49k.json"
    assert not splits_at_blanks(Tokenizer.from_file(other).to_str()) and splits_at_blanks(Tokenizer.from_file(TOKENIZER).to_str())
    texts = odd_texts(500, 7) + ["Plain words, twice  over"]
    assert Counter(other).count(texts) == library(texts, other)


def test_nulls_long_texts_repeats_and_clashes(spark):
    r = rng()
    texts = [None, "", "a b", "a b", prose(r, 120_000, 50_000), "x" * 300_000, "字" * 50_000, " \n" * 20_000]
    df = frame(spark, [(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id int, text string, N_TOKENS int, other string")
    out = count_tokens(df, TOKENIZER, limit=2, batch_bytes=1000)
    assert out.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"]
    got = [(x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in sorted(out.collect())]
    assert got == [(len((t or "").encode()), n, n > 2) for t, n in zip(texts, library(texts))]


def test_empty_table(spark):
    out = count_tokens(docs(spark, []), TOKENIZER)
    assert out.collect() == [] and out.columns[-3:] == ["n_bytes", "n_tokens", "over_limit"]


def test_missing_tokenizer_fails(spark):
    with pytest.raises(Exception):
        count_tokens(docs(spark, ["a"]), "/nowhere.json").collect()
