"""Chat formatting: exact read-back, spans, and templates that rewrite history."""

import hashlib

import pytest
from flotilla.llm import chat
from flotilla.llm.queries import op7_chat_formatting
from texts import frame, rng

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<s", "[", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "[[INST]]", "<<s>>", "s>", "INST]", "/INST]", "a", "\n", "é😀"]


def random_text(rnd):
    return "".join(rnd.choice(NASTY) for _ in range(rnd.randint(0, 7)))


def test_escape_is_reversible_and_leaves_no_control_string():
    rnd = rng(1)
    for _ in range(4000):
        text = random_text(rnd)
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


def test_render_and_parse():
    rnd = rng(2)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "", "<s>"]), random_text(rnd)) for _ in range(rnd.randint(0, 8))]
        text, spans, rewrites = chat.render(turns, chat.instruct)
        assert not rewrites and [(r, t) for r, t, _, _ in chat.parse(text)] == turns
        assert "".join(text[a:z] for a, z in spans) == text


def test_rewriting_templates_are_found():
    def last_only(turns):  # keeps thoughts in the last turn only
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t.replace('thought ', '')}" for k, (r, t) in enumerate(turns))

    turns = [("u", "hi"), ("a", "thought yes"), ("u", "and?"), ("a", "no")]
    text, spans, rewrites = chat.render(turns, last_only)
    assert rewrites and text == last_only(turns) and all(0 <= a <= z <= len(text) for a, z in spans)
    assert spans[-1] == (text.index("<a>no"), len(text))
    assert chat.render(turns[:1], last_only)[2] is False

    def counted(turns):  # the first line changes with every turn
        return f"{len(turns)} turns" + "".join(t for _, t in turns)
    assert chat.render(turns, counted)[2]
    assert chat.render([], chat.instruct) == ("", [], False)


def digest(turns, block):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(chat.instruct(turns[k:k + block]) for k in range(0, len(turns), block))
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), len(whole), False)


@pytest.mark.parametrize("block", [3, 64])
def test_conversations(spark, block):
    rnd = rng(3)
    convs = {c: [(rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, random_text(rnd)])) for _ in range(n)]
             for c, n in enumerate([1, 2, 3, 4, 7, 8, 200])}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    got = chat.read_back(chat.format_conversations(frame(spark, rows, SCHEMA), block=block)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: digest(t, block) for c, t in convs.items()}


def test_query_has_the_control_case(spark, tmp_path):
    frame(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in op7_chat_formatting(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got == {1: digest([("user", "a"), ("assistant", "b")], 64), -7: digest([("user", said), ("assistant", said)], 64)}


def test_edge_cases(spark):
    """Null ids and turns, equal turn numbers, repeated rows, other columns, no rows."""
    rows = [(None, None, "user", "x", 1), (None, 0, "assistant", "y", 2), (2, 5, "user", "b", 3), (2, 5, "assistant", "a", 4),
            (2, 5, "assistant", "a", 4)] + [(3, 1, "assistant", "r", k) for k in range(70)]
    df = frame(spark, rows, SCHEMA + ", formatted long")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    assert got == {None: digest([("user", "x"), ("assistant", "y")], 64),
                   2: digest([("assistant", "a"), ("assistant", "a"), ("user", "b")], 64),
                   3: digest([("assistant", "r")] * 70, 64)}
    assert sorted(r.n_turns for r in formatted.filter("conv_id = 3").collect()) == [6, 64]
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


@pytest.mark.parametrize("step", [1, 1000])
def test_black_boxes_see_the_whole_conversation(spark, step):
    """Past 64 turns and with sparse turn numbers: one start, spans of the whole, rewrites across any edge."""
    def started(turns):
        return "<start>" + "".join(f"<{r}>{t}" for r, t in turns)

    def forgets(turns):  # what was said 70 turns ago is shortened
        return "".join(f"<{r}>{t if k > len(turns) - 70 else t[:1]}" for k, (r, t) in enumerate(turns))

    turns = [("assistant" if k % 2 else "user", f"said {k}") for k in range(150)]
    df = frame(spark, [(c, k * step, r, t) for c in (1, None) for k, (r, t) in enumerate(turns)], SCHEMA)
    for template in (started, forgets):
        text, spans, rewrites = chat.render(turns, template)
        got = chat.format_conversations(df, template).collect()
        assert sorted(r.conv_id or 0 for r in got) == [0, 1] and rewrites == (template is forgets)
        for r in got:
            assert (r.n_turns, r.formatted, r.rewrites) == (150, text, rewrites)
            assert [(x.start, x.stop) for x in r.spans] == spans
