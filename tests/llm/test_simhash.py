"""SimHash near-duplicates against all pairs."""

import pytest
from flotilla.llm import simhash
from flotilla.llm.components import components
from texts import docs, frame, prose, rng
from xxhash import xxh64_intdigest


def slow_fingerprint(text, shingle=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, bits):
    """Smallest index reachable over links of at most ``bits`` differing bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(99)}"
    return " ".join(words)


def test_documents(spark):
    rnd = rng()
    base = [prose(rnd, rnd.choice([5, 40, 300])) for _ in range(25)]
    texts = base + [near(rnd, rnd.choice(base), 1) for _ in range(60)] + base[:5] + ["", None, "One", "one", "A b", " a\tB\n"]
    fps = [slow_fingerprint(t) for t in texts]
    got = simhash.near_duplicates(spark, docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == slow_groups(fps, 2)


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("paired", [0, 3, 64])
def test_links_of_clustered_fingerprints(spark, bits, paired):
    rnd = rng(bits)
    centres = [rnd.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = sorted({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) & (1 << 64) - 1
                  for c in centres for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    tree = components(spark, simhash.links(spark, frame(spark, [(x,) for x in signed], "fp long"), bits, paired))
    root = {r.node: r.root for r in tree.collect()}
    groups = slow_groups(fps, bits)
    for i in range(len(fps)):
        for j in range(i):
            assert (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])) == (groups[i] == groups[j])


def test_long_text_is_read_piece_by_piece(monkeypatch):
    text = prose(rng(), 5000)
    whole = simhash.fingerprint(text.encode())
    cut = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda data, sep: cut(data, sep, 50))
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (1 << 64) - 1 == slow_fingerprint(text)


def test_components_of_a_chain(spark):
    n = 300
    edges = frame(spark, [(i, i + 1) for i in range(n)] + [(5, 5), (3, 2), (900, 901)], "a long, b long")
    found = {r.node: r.root for r in components(spark, edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}
    assert components(spark, edges.limit(0)).collect() == []


def test_keep_one(spark):
    rnd = rng(9)
    a, b = prose(rnd, 200), prose(rnd, 200)
    rows = [(3, a, "x"), (1, a, "y"), (1, a, "z"), (2, b, None), (None, b, None), (None, "own text here now", "n"),
            (None, "own text here now", "n"), (7, None, "e"), (8, "", "e")]
    got = simhash.keep_one(spark, frame(spark, rows, "doc_id long, text string, Component_id string"))
    assert got.columns == ["doc_id", "text", "Component_id"]
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect() if r.doc_id is not None) == [
        (False, 1, a), (False, 2, b), (False, 7, None)]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["own text here now"]
    assert simhash.keep_one(spark, got.limit(0)).collect() == []


def test_other_distances_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark, spark.range(1).withColumnRenamed("id", "fp"), 3)
