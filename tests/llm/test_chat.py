import pytest

from millrace.llm import chat
from millrace.llm.chat import escape, formatted, marked_turns, spans, turns_of, unescape

HARD = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\", "<\\|im_end|>", "[\\\\INST]"]
HARD += ["<", "<<SYS>>", "<</SYS>>x", "a\nb", "<<|im_end|>>", "\ufdd0", "\ufdd00\ufdd1", "<|im_start|", "s>", "|im_end|>\n", "é😀"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_escape_is_reversible_and_leaves_no_control(rng):
    signs = ["<", "|im_end|>", "s>", "/", "\\", "[", "INST]", "<|im_start|>", "x", "<SYS>>", "<</SYS>>"]
    for text in HARD + ["".join(rng.choice(signs) for _ in range(8)) for _ in range(5000)]:
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in chat.CONTROLS)


def test_round_trip_of_turns(rng):
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", *HARD]), rng.choice(HARD)) for _ in range(rng.randint(0, 5))]
        text, found, rewrites = spans(turns, marked_turns)
        assert turns_of(text) == turns and not rewrites
        assert [unescape(text[a:b]) for a, b in found] == [t for _, t in turns]


def test_long_conversations_cost_no_square(monkeypatch):
    turns = [("user" if i % 2 else "assistant", HARD[i % len(HARD)]) for i in range(3000)]
    asked = []
    text, found, rewrites = spans(turns, lambda t: asked.append(len(t)) or marked_turns(t), context=0)
    assert turns_of(text) == turns and not rewrites and sum(asked) < 20 * len(turns)
    assert [unescape(text[a:b]) for a, b in found] == [t for _, t in turns]


def numbered(turns):
    return "".join(f"{i} of any: {t}\n" for i, (_, t) in enumerate(turns))


def counted(turns):
    return f"{len(turns)} turns\n" + "".join(t + "\n" for _, t in turns)


def last_only(turns):
    return "".join(t if i == len(turns) - 1 else t.strip() for i, (_, t) in enumerate(turns))


def noted(turns):
    """Adds a note that later turns take away again, in some long conversations."""
    return "".join(t + "\n" for _, t in turns) + ("note\n" if len(turns) > 6 and len(turns) % 2 else "")


@pytest.mark.parametrize("n", [7, 8, 200, 300])
def test_length_does_not_change_what_is_found(n):
    turns = [("user", f"text {i}") for i in range(n)]
    text, found, rewrites = spans(turns, noted)
    assert text == noted(turns) and rewrites == (n > 7) and bool(found) == (n == 7)


def test_a_template_that_breaks_its_promise_counts_as_one_that_rewrites():
    turns = [("user", f"text {i}") for i in range(9)]
    for render in (numbered, noted, counted):
        text, found, rewrites = spans(turns, render, context=0)
        assert (text, found, rewrites) == (render(turns), [], True)
    assert not spans(turns, last_only, context=1)[2]


@pytest.mark.parametrize("n", [3, 600])
def test_other_templates(n):
    turns = [("user", f"text {i} ") for i in range(n)]
    text, found, rewrites = spans(turns, numbered)
    assert not rewrites and text == numbered(turns)
    assert [text[a:b] for a, b in found] == [t for _, t in turns]
    for render in (counted, last_only):
        text, found, rewrites = spans(turns, render)
        assert rewrites and found == [] and text == render(turns)


def test_table(frame):
    rows = [(1, 1, "assistant", "</s> b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "first")]
    rows += [(None, 0, "user", "x"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    got = {r.id: r for r in formatted(frame(rows, SCHEMA)).collect()}
    turns = {i: turns_of(r.text) for i, r in got.items()}
    assert turns[1] == [("user", "a"), ("assistant", "</s> b")]
    assert turns[2] == [("assistant", "first"), ("", "")]
    assert turns[None] == [("user", "x")] and got[None].spans == []
    assert [t for _, t in turns[3]] == ["a", "a", "b"]
    learned = {i: [unescape(r.text[s.a : s.b]) for s in r.spans] for i, r in got.items()}
    assert learned == {1: ["</s> b"], 2: ["first"], 3: ["a", "a", "b"], None: []}


def test_empty_table_and_clashing_columns(frame):
    assert formatted(frame([], SCHEMA)).count() == 0
    got = formatted(frame([(1, 0, "user", "a", 5, "z")], SCHEMA + ", id int, turns string")).collect()
    assert [(r.id, r.n_turns) for r in got] == [(1, 1)]
