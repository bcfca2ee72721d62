"""The pipeline against a brute-force version built from the slow versions of its operators."""

import corpus_pipeline
import sentencepiece
from flotilla.llm import quality as Q
from flotilla.llm.queries import PIECE_MODEL
from test_decontaminate import brute as slow_hits
from test_line_dedup import brute as slow_lines
from test_quality import counts
from test_simhash import near, slow_fingerprint, slow_groups
from texts import frame, prose, rng

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = rng(12)

    def lines(n):
        return "\n".join(prose(rnd, rnd.randint(8, 70), 5000) + "." for _ in range(n))

    texts = [lines(rnd.randint(1, 5)) for _ in range(40)]
    passage, item = prose(rnd, 80, 9000) + ".", prose(rnd, 30, 9000)
    texts += [texts[k] for k in (0, 1, 1, 2)]                             # copies
    texts += [near(rnd, texts[k], 1) for k in (3, 4, 5, 5)]               # near copies
    texts += [f"{lines(2)}\n{passage}\n{lines(1)}" for _ in range(5)]     # a shared passage
    texts += [f"{lines(1)} {item} {lines(1)}" for _ in range(3)]          # a benchmark item inside
    texts += [f"{lines(2)}\nHome | News | Sport | About | Help", "the### of$$$ and%%% so&&& on***\n" * 5, "too short", "", None, "x " * 60]
    rnd.shuffle(texts)
    items = [(1, item), (2, prose(rnd, 30, 9000)), (3, "w1 w2"), (4, None)]
    return texts, items


def brute(texts, items):
    docs = []
    for d, t in enumerate(texts):
        kept = [x for x in (t or "").split("\n") if not Q.line_fails(x.encode())]
        n = counts(t)
        lost = n[0] - sum(len(x.split()) for x in kept)
        if not n[5] and lost <= Q.MAX_LOST * n[0]:
            docs.append((d, "\n".join(kept)))
    cut = slow_lines(docs, 50)
    ids = sorted(cut)
    groups = slow_groups([slow_fingerprint(cut[d]) for d in ids], 2)
    ids = [d for k, d in enumerate(ids) if groups[k] == k]
    ids = [d for d in ids if not slow_hits(cut[d], items)[1]]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    return {d: lib.encode(cut[d]) for d in ids}


def test_pipeline(spark, tmp_path):
    texts, items = corpus()
    rows = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in enumerate(texts)]
    frame(spark, rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(texts, items)
    assert 20 < len(want) < len(texts) - 10
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.lossless for r in got)


def test_stages_keep_columns(spark, tmp_path):
    """Clashing extra columns, nulls anywhere and repeated rows pass through every stage but the last."""
    rnd = rng(3)
    rows = [(1, prose(rnd, 60) + ".", None, 5, "a"), (1, None, "x", None, None), (None, prose(rnd, 60) + ".", None, 7, "b"),
            (2, prose(rnd, 60) + ".", "y", 8, "c"), (2, prose(rnd, 60) + ".", "y", 8, "c")]
    schema = "doc_id long, text string, Kept string, n_chars long, fp string, N_Lines int, component_id string, items string, hits string"
    docs = frame(spark, [(*r, 1, None, "i", None) for r in rows], schema)
    frame(spark, [(1, "none of these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert 3 <= len(got) <= 5 and all(r.n_chars == (None if r.text is None else len(r.text)) or "simhash" in name or "bench" in name
                                          for r in got), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5
