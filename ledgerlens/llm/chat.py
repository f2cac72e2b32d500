"""Chat formatting in budgeted windows.

A conversation longer than the budget is cut into windows of whole turns.
The running sums of the turns' tokens choose the spans: a window takes turns
as long as system turn, repeated history and new turns fit the budget.  Every
window begins with the conversation's system turn and a limited number of
turns of the window before; what is repeated is marked and masked, so each
assistant turn is a target once.

Template, a turn: ``<turn ROLE>`` or ``<again ROLE>`` (repeated), newline,
text, ``</turn>``, newline.  In roles and texts ``\\``, ``<`` and ``>`` are
escaped by ``\\``, so no text can look like the template and every text comes
back exactly.  Masks are [start, end) ranges of code points of the window.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, functions as F

from .common import map_rows

BUDGET = 1024        # tokens a window
HISTORY_TURNS = 2    # turns repeated from the window before, at most
HISTORY_SHARE = 0.25  # of the budget that they may take
TARGET = "assistant"
END = "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    # a run of backslashes begins where an escape does, so pairs are found in step
    return "\\".join(part.replace("\\<", "<").replace("\\>", ">") for part in text.split("\\\\"))


def _bare(text: str, char: str, at: int) -> int:
    """Place of the first ``char`` from ``at`` on that no backslash escapes."""
    while True:
        at = text.index(char, at)
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1


def turns_of(text: str):
    """``kind, escaped role, escaped text`` of a window's turns: "turn" or
    "again".  What a turn holds is found by its unescaped marks alone, in one
    pass and without a copy but the parts'."""
    at = 0
    while at < len(text):
        role = text.index(" ", at) + 1
        close = _bare(text, ">", role)
        stop = _bare(text, "<", close + 2)
        yield text[at + 1:role - 1], text[role:close], text[close + 2:stop]
        at = stop + len(END)


def _turn(role: str, body: str, again: bool) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head = f"<{'again' if again else 'turn'} {escape(role)}>\n"
    return f"{head}{body}{END}", len(head), len(head) + len(body)


class Window:
    """One window as it fills: formatted text, targets, new turns."""

    def __init__(self, repeated):
        self.parts, self.size, self.tokens, self.mask, self.new = [], 0, 0, [], 0
        for role, body, tokens in repeated:
            self.add(role, body, tokens, True)

    def add(self, role, body, tokens, again=False):
        text, start, end = _turn(role, body, again)
        if not again:
            self.new += 1
            if role == TARGET:
                self.mask.append([self.size + start, self.size + end])
        self.parts.append(text)
        self.size += len(text)
        self.tokens += tokens


def windows(turns, budget=BUDGET, history=HISTORY_TURNS, share=HISTORY_SHARE):
    """Windows of one conversation's turns ``(role, escaped text, tokens)`` in
    order, as they fill: what is held is one window, whatever the number of
    turns.  A turn beyond the budget stands alone with what is repeated."""
    system, recent, window, first = None, deque(maxlen=max(history, 1)), None, True
    for role, body, tokens in turns:
        if window is not None and window.new and window.tokens + tokens > budget:
            yield window
            again, left = [], budget * share
            for turn in reversed(recent if history else ()):
                left -= turn[2]
                if left < 0:
                    break
                again.insert(0, turn)
            window = Window(([system] if system else []) + again)
        if window is None:
            window = Window([])
        window.add(role, body, tokens)
        if first and role == "system":
            system = (role, body, tokens)
        else:
            recent.append((role, body, tokens))
        first = False
    if window is not None:
        yield window


def token_counter(tokenizer: str):
    """Column expression: tokens of a text by a public tokenizer (null: 0)."""

    @F.pandas_udf("int", F.PandasUDFType.SCALAR_ITER)
    def count(batches):
        import pandas as pd

        from .tokens import encoder

        own = encoder(tokenizer)  # the task's
        for texts in batches:
            yield pd.Series([len(x) for x in own.encode([t or "" for t in texts])], dtype="int32")

    return count


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY_TURNS,
                   share: float = HISTORY_SHARE, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, window, n_new, n_tokens, text, mask`` (array of [start, end)).

    Turns go by ``turn`` (nulls first); equal turn numbers, repeated rows
    too, by role and text.  Null text and null role count as empty.  Rows
    with a null conv_id are one conversation.  No rows give no windows.

    Texts are tokenized where they lie; only sorting and cutting needs a
    conversation's turns in one place, and that is streamed."""
    counted = turns.select(turns[id_col].alias("conv_id"), turns[turn_col].alias("turn"),
                           F.coalesce(turns[role_col], F.lit("")).alias("role"),
                           F.coalesce(turns[text_col], F.lit("")).alias("text")
                           ).withColumn("tokens", token_counter(tokenizer)("text"))
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches):
        for cols in batches:
            yield from zip(cols["conv_id"], cols["role"], cols["text"], cols["tokens"])

    def run(batches):
        for conv, own in _runs(rows(batches)):
            cut = windows(((role, escape(text), tokens) for role, text, tokens in own), budget, history, share)
            for k, w in enumerate(cut):
                yield conv, k, w.new, w.tokens, "".join(w.parts), w.mask

    return map_rows(ordered, run, "conv_id long, window long, n_new long, n_tokens long, text string,"
                                  " mask array<array<int>>")


def _runs(rows):
    """``(key, iterator of the rest)`` for runs of rows with equal first field."""
    from itertools import groupby

    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in own)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``; repeated turns count once."""
    ordered = formatted.select("conv_id", "window", "text", "mask").repartition("conv_id").sortWithinPartitions(
        "conv_id", "window")

    def rows(batches):
        for cols in batches:
            yield from zip(cols["conv_id"], cols["text"], cols["mask"])

    def run(batches):
        for conv, own in _runs(rows(batches)):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for text, mask in own:
                chars += len(text)
                for kind, role, body in turns_of(text):
                    if kind == "turn":
                        n += 1
                        turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for start, end in mask:
                    target = unescape(text[start:end])
                    loss_chars += len(target)
                    loss.update(target.encode())
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    return map_rows(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
                                  " loss_sha256 string, formatted_chars long")
