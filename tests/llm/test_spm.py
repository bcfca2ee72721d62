"""The lattice against the sentencepiece library, for both kinds of model."""

import sys

import numpy as np
import pytest
from flotilla.llm import spm
from flotilla.llm.queries import PIECE_MODEL
from sentencepiece import sentencepiece_model_pb2 as proto
from texts import docs, frame, prose, rng

PARTS = ["a", "b", " ", " ", "\n", "é", "日", "the", "ing", "▁", ".", "\t", "​", "😀", "  ", "0", "12", "tion", "    ", "nd"]


@pytest.fixture(scope="module")
def bpe():
    return spm.Model(PIECE_MODEL)


@pytest.fixture(scope="module")
def unigram():
    """The same pieces as a unigram model, with scores that avoid ties."""
    spec = proto.ModelProto.FromString(open(PIECE_MODEL, "rb").read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    rnd = rng(1)
    for p in spec.pieces:
        if p.type == p.NORMAL:
            p.score = -4.0 - 8 * rnd.random() / len(p.piece)
    return spm.Model(spec.SerializeToString())


def texts(n, most):
    rnd = rng(n)
    for k in range(n):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most)))
        yield text.replace(" ", "").replace("▁", "") if k % 3 == 0 else text


def test_bpe_ids_are_the_library_s(bpe):
    for text in [*texts(600, 50), *texts(10, 3000), "", " ", "  ", "\n\n", "a" * 5000, " " * 500, "tion" * 2000]:
        want = bpe.library.encode(text)
        assert np.frombuffer(spm.Encoder(bpe).encode(text), "<i4").tolist() == want, text[:80]
        marked = (spm.SPACE if text else "") + text.replace(" ", spm.SPACE)
        assert spm.viterbi(bpe, marked) == want, text[:80]
        assert spm.joined(spm._pieces(PIECE_MODEL)[0], want, True) == text.replace(spm.SPACE, " ")  # as the library does


def test_unigram_ids_are_the_library_s(unigram):
    for text in texts(600, 40):
        marked = (spm.SPACE if text else "") + text.replace(" ", spm.SPACE)
        assert spm.viterbi(unigram, marked) == unigram.library.encode(text), text


def test_window_stays_short(bpe):
    """Ids leave the window as paths meet, long before the text ends."""
    text = spm.SPACE + "".join(c for t in texts(30, 400) for c in t if c not in " \n▁")
    peak = 0

    def trace(frame, event, arg):
        nonlocal peak
        if frame.f_code is not spm.viterbi.__code__:
            return None
        peak = max(peak, len(frame.f_locals.get("last", ())))
        return trace
    sys.settrace(trace)
    try:
        spm.viterbi(bpe, text)
    finally:
        sys.settrace(None)
    assert len(text) > 3000 and peak < 3 * spm.CHECK_EVERY


def test_round_trip(spark):
    rnd = rng(2)
    rows = [prose(rnd, 50), "", None, " lead", "two  blanks ", "ünï 日本\n\n😀", "x" * 40_000, "\x00\t"]
    got = spm.round_trip(docs(spark, rows), PIECE_MODEL).orderBy("doc_id").collect()
    assert all(r.lossless for r in got)
    assert [r.ids is None for r in got] == [t is None for t in rows]
    assert [r.n_ids for r in got][1:3] == [0, 0]


def test_edge_cases(spark):
    df = frame(spark, [(1, "a", "k"), (1, "a", "k"), (None, "b", None)], "doc_id long, text string, IDS string")
    got = spm.encode(df, PIECE_MODEL)
    assert got.columns == ["doc_id", "text", "ids"] and got.count() == 3
    assert spm.encode(df.limit(0), PIECE_MODEL).collect() == []
    back = spm.decode(got, PIECE_MODEL, "ids", "Text")
    assert back.columns == ["doc_id", "ids", "Text"] and sorted(r.Text for r in back.collect()) == ["a", "a", "b"]


def test_forgetting_parts_changes_nothing(bpe, monkeypatch):
    monkeypatch.setattr(spm, "REMEMBERED", 8)
    text = prose(rng(4), 500)
    assert np.frombuffer(spm.Encoder(bpe).encode(text), "<i4").tolist() == bpe.library.encode(text)
