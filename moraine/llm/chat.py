"""Operator 6: conversations as token-budgeted training windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_tokenizer, word_encoder

WINDOW_SCHEMA = (
    "conv_id long, window int, text string, n_tokens long, over_budget boolean,"
    " turns array<struct<turn: long, start: long, end: long, repeated: boolean, loss: boolean>>"
)
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)\n</turn>\n", re.S)
_BACK = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}


def escape(text: str) -> str:
    """Text without the template's control strings: ``\\`` is doubled and the ``<`` of a control string becomes ``\\l``."""
    return text.replace("\\", "\\\\").replace("<turn", "\\lturn").replace("</turn", "\\l/turn")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m.group(1)], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and ends."""
    head = f"<turn {escape_role(role)}>\n"
    body = escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


class _Windows:
    """Windows of one conversation, built turn by turn: no more than the open window and the history are held."""

    def __init__(self, conv: int | None, budget: int, history: int, roles: frozenset[str]):
        self.conv, self.budget, self.roles = conv, budget, roles
        self.system: list[tuple] = []
        self.last: deque = deque(maxlen=history) if history else deque(maxlen=0)
        self.open: list[tuple] = []
        self.prefix = self.opened = 0  # tokens of all turns so far, and of those before the open window's new turns
        self.carried = 0
        self.number = self.turn = 0

    def add(self, role: str, formatted: tuple[str, int, int], tokens: int) -> Iterator[dict]:
        turn = (self.turn, role, *formatted, tokens)
        self.turn += 1
        if role == "system" and len(self.system) == turn[0]:
            self.system.append(turn)
        self.prefix += tokens
        if self.carried + self.prefix - self.opened > self.budget and any(not repeated for _, repeated in self.open):
            yield self.close()
            # the system turns always, then as many of the last turns as leave room for the new one
            room = self.budget - tokens - sum(t[-1] for t in self.system)
            kept: list[tuple] = []
            for t in reversed(self.last):
                if t in self.system or t[-1] > room:
                    break
                room -= t[-1]
                kept.insert(0, t)
            self.open = [(t, True) for t in (*self.system, *kept) if t[0] != turn[0]]
            self.carried, self.opened = sum(t[-1] for t, _ in self.open), self.prefix - tokens
        self.open.append((turn, False))
        self.last.append(turn)

    def close(self) -> dict:
        at, texts, spans = 0, [], []
        for (number, role, text, start, end, _), repeated in self.open:
            spans.append({"turn": number, "start": at + start, "end": at + end, "repeated": repeated, "loss": role in self.roles and not repeated})
            texts.append(text)
            at += len(text)
        total = sum(t[-1] for t, _ in self.open)
        self.number += 1
        return {"conv_id": self.conv, "window": self.number - 1, "text": "".join(texts), "n_tokens": total, "over_budget": total > self.budget, "turns": spans}


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
     ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("repeated", pa.bool_()), ("loss", pa.bool_())])))]
)


def format_windows(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 1024, history: int = 2, target_roles: tuple[str, ...] = ("assistant",), tokenizer: str | None = None,
) -> DataFrame:
    """Conversations as windows of whole turns of at most ``budget`` tokens.

    The running sum of turn tokens closes a window before the turn that would pass the budget.  Each later window starts
    with the conversation's leading system turns and up to ``history`` of the turns before it, as far as they leave room for
    the next turn; these repeated turns are masked, so every target text bears loss exactly once.  ``turns`` gives, for each
    turn of a window, the code points of its escaped text and whether it bears loss.  A single turn above the budget has a
    window of its own (``over_budget``), with the system turns; no turn is cut or dropped.

    Turns go by ``turn_col``, then role and text; nulls first.  Null texts and roles are empty; rows with a null
    conversation are one conversation; repeated rows are turns of their own.  An empty table gives no window.  Other columns
    are ignored.  A conversation is read as a stream in one task, which holds a window and the history, not the conversation.
    """
    tokenizer, roles = tokenizer or default_tokenizer(), frozenset(target_roles)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now = word_encoder(tokenizer), None
        for batch in batches:
            convs, all_roles, texts = (batch.column(k).to_pylist() for k in ("conv", "role", "text"))
            formatted = [format_turn(r, t) for r, t in zip(all_roles, texts, strict=True)]
            tokens = encoder.encode(pa.array([x[0] for x in formatted], pa.string()))[1].tolist()
            done: list[dict] = []
            for conv, role, turn, n in zip(convs, all_roles, formatted, tokens, strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.close())
                    now = _Windows(conv, budget, history, roles)
                done.extend(now.add(role, turn, n))
            yield pa.RecordBatch.from_pylist(done, _ARROW)
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], _ARROW)

    return rows.mapInArrow(form, WINDOW_SCHEMA)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns and loss text parsed back from the template, with their SHA-256."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state = none, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv or conv is none:
                    if state:
                        done.append(state)
                    conv, state = row["conv_id"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["text"]
                for (role, body), span in zip(_TURN.findall(text), row["turns"], strict=True):
                    if not span["repeated"]:
                        state[1] += 1
                        state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                    if span["loss"]:
                        target = unescape(text[span["start"] : span["end"]])
                        state[3] += len(target)
                        state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            if done:
                yield _digest_batch(done, names)
        if state:
            yield _digest_batch([state], names)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, schema)


def _digest_batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in rows]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*plain, strict=True), kinds, strict=True)], names)
