"""Chat formatting with any template, seen as a black box.

A template is a function from a list of (role, text) to a string. To find where
each turn stands, successive prefixes of a conversation are rendered: what a
prefix adds to the one before is the span of its last turn. A template that does
not leave the earlier output as it was rewrites history, and the conversation is
marked. Within its span a text is found by rendering the same prefix with a mark
in its place: what stands before and after the mark is the template's.

Rendering every prefix costs the square of a conversation's length, whatever the
template. The author of a template whose output for a turn depends only on the few
turns before it can say how many, as `context`: then a turn is rendered after those
only, in conversations of any length, and one rendering of the whole must be what
the parts add up to.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import arrow_batches, column

Turn = tuple[str, str]
# Code points that no text has by right; a number between them makes a mark.
MARK_START, MARK_END = "\ufdd0", "\ufdd1"

# Strings that mean something to chat models.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_RAW = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
# Turns of up to so many characters are kept as rendered, as each prefix has those before it again.
KEPT, KEPT_CHARS = 4096, 2048
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """The text with a backslash more after the first sign of each control string."""
    return _RAW.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _marked(role: str, text: str) -> str:
    return f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n"


_kept = lru_cache(KEPT)(_marked)


def marked_turns(turns: list[Turn]) -> str:
    """The template: each turn between marks, control strings in it escaped."""
    return "".join((_kept if len(r) + len(t) <= KEPT_CHARS else _marked)(r, t) for r, t in turns)


def turns_of(text: str) -> list[Turn]:
    """The turns read back from `marked_turns`."""
    return [(_role_back(r), unescape(t)) for r, t in _TURN.findall(text)]


def _part(render: Callable, before: list[Turn], turn: Turn, prefix: str):
    """What a turn adds to `prefix`, and where in it its text begins and ends; None if it rewrites."""
    whole = render([*before, turn])
    if not whole.startswith(prefix):
        return None
    role, number = turn[0], 0
    while (mark := f"{MARK_START}{number}{MARK_END}") in whole:
        number += 1
    probe = render([*before, (role, mark)])
    at = probe.find(mark, len(prefix)) if probe.startswith(prefix) else -1
    if at < 0:
        return whole, len(whole), len(whole)
    after = len(probe) - at - len(mark)
    if whole[:at] != probe[:at] or whole[len(whole) - after :] != probe[len(probe) - after :]:
        return None
    return whole, at, len(whole) - after


def spans(turns: list[Turn], render: Callable[[list[Turn]], str], context: int | None = None):
    """The rendered conversation, (start, end) of each turn's text in it, and whether it rewrites.

    With `context`, a template that does not keep to it counts as one that rewrites.
    """
    parts, size, found, text = [], 0, [], ""
    for i, turn in enumerate(turns):
        before = turns[:i] if context is None else turns[max(0, i - context) : i]
        if context is not None:
            text = render(before) if before else ""
        part = _part(render, before, turn, text)
        if part is None:
            return render(turns), [], True
        whole, a, b = part
        found.append((size + a - len(text), size + b - len(text)))
        parts.append(whole[len(text) :])
        size += len(parts[-1])
        text = whole
    text = "".join(parts)
    if context is not None and (whole := render(turns)) != text:
        return whole, [], True
    return text, found, False


def formatted(
    conversations: DataFrame,
    render: Callable[[list[Turn]], str] = marked_turns,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: tuple[str, ...] = ("assistant",),
    context: int | None = None,
) -> DataFrame:
    """id, text, spans of learned turns, n_turns, rewrites: one row for each conversation.

    Turns are in the order of `turn_col` (null first), ties by role and text;
    repeated rows are turns of their own. Null roles and texts are empty. Rows
    with a null id are one conversation. Spans are (start, end) in code points; a
    template that rewrites history gives no spans. `context` is a promise of the
    template; see above. A conversation is put together
    in one task, as its output is one string.
    """
    arrow_batches(conversations.sparkSession, 500)
    one = [column(conversations, c) for c in (turn_col, role_col, text_col)]
    turn = F.struct(
        one[0].alias("turn"),
        F.coalesce(one[1].cast("string"), F.lit("")).alias("role"),
        F.coalesce(one[2].cast("string"), F.lit("")).alias("text"),
    )
    rows = conversations.select(column(conversations, id_col).alias("id"), turn.alias("turn"))
    rows = rows.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for turns in batch.column("turns").to_pylist():
                turns = [(t["role"], t["text"]) for t in turns]
                text, found, rewrites = spans(turns, render, context)
                mask = [{"a": a, "b": b} for (a, b), (r, _) in zip(found, turns) if r in learn]
                out.append((text, mask, len(turns), rewrites))
            kinds = (pa.string(), span, pa.int64(), pa.bool_())
            values = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *values], ["id", "text", "spans", "n_turns", "rewrites"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"id {kind}, text string, spans array<struct<a:bigint,b:bigint>>, n_turns bigint, rewrites boolean",
    )
