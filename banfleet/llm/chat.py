"""Conversations rebuilt from event logs and rendered as training text.

A log row is an event of a conversation: ``message`` opens a turn with a text, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` empties it for new deltas, ``delete`` drops it. Logs
are partitioned by conversation and sorted by sequence; a task folds them one event at a time and
holds one conversation's open turn, so a conversation of any length passes through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
#: The role whose texts a model learns to write.
LEARNED = "assistant"
_ROWS = 2048
_CHARS = 1 << 22


def escape(text: str) -> str:
    """Text in which no control string can occur: each of their first signs follows a backslash."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out.append(text[at:i])
        out.append(text[i + 1 : i + 2])
        at = i + 2
    out.append(text[at:])
    return "".join(out)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends in it."""
    head = f"{OPEN}{escape(role).replace(':', ESCAPE + ':')}:\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(f"{CLOSE}\n")):
        raise ValueError("not a formatted turn")
    end = formatted.index(":\n", len(OPEN))
    while _escaped_before(formatted, end):
        end = formatted.index(":\n", end + 1)
    return unescape(formatted[len(OPEN) : end]), unescape(formatted[end + 2 : -len(CLOSE) - 1])


def _escaped_before(text: str, end: int) -> bool:
    return (len(text[:end]) - len(text[:end].rstrip("\\"))) % 2 == 1


def log_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log of one ``message`` per row."""
    c = conversations
    turn = F.col("turn").cast("long")
    return c.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), turn.alias("seq"),
        F.lit("message").alias("kind"), "role", "text",
    )


class _Fold:
    """Applies events in order; ``done`` gets each message once no event can change it."""

    def __init__(self):
        self.at, self.role, self.parts, self.live = None, "", [], False

    def add(self, conv, turn, kind, role, text) -> tuple | None:
        done = None
        if kind == "message" or (conv, turn) != self.at:
            done = self.close()
            self.at, self.role, self.parts, self.live = (conv, turn), role, [text], True
        elif kind == "delta":
            self.parts.append(text)
        elif kind == "edit":
            self.parts = [text]
        elif kind == "regenerate":
            self.parts, self.live = [text], True
        if kind == "delete":
            self.live = False
        return done

    def close(self) -> tuple | None:
        if self.at is None or not self.live:
            return None
        return (*self.at, self.role, "".join(self.parts))


_RENDERED = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_end int"


def render_conversations(log: DataFrame) -> DataFrame:
    """One row per final message: its text, its rendering, and its span under the loss mask.

    Rows of a conversation are together and in order. Events are sorted by conversation, turn and
    sequence; equal ones by role, text and kind, nulls first. An event of another kind than those named changes
    nothing; one for a turn never opened opens it; a second ``message`` for a turn is a message of
    its own, so repeated rows stay repeated. Null texts and roles are empty; null conversations are one conversation.
    Spans are code points within ``formatted``, null where nothing is learned. Other columns are not
    read, and an empty log gives no rows.
    """
    order = ["conv_id", "turn", "seq", "role", "text", "kind"]
    rows = log.select(*order).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, out, size = _Fold(), [], 0
        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            for conv, turn, _, role, text, kind in plain.itertuples(index=False, name=None):
                if (done := fold.add(conv, turn, kind, role or "", text or "")) is not None:
                    out.append(_row(*done))
                    size += len(out[-1][4])
                    if len(out) >= _ROWS or size > _CHARS:
                        yield _frame(out)
                        out, size = [], 0
        if (done := fold.close()) is not None:
            out.append(_row(*done))
        if out:
            yield _frame(out)

    return rows.mapInPandas(run, _RENDERED)


def _row(conv, turn, role: str, text: str) -> tuple:
    formatted, start, end = render(role, text)
    return (conv, turn, role, text, formatted, *((start, end) if role == LEARNED else (None, None)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])
    return frame.astype({"conv_id": "Int64", "turn": "Int64", "loss_start": "Int32", "loss_end": "Int32"})


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from ``formatted`` and the loss spans alone: turns, digests and sizes.

    Needs the rows as :func:`render_conversations` leaves them, and adds no shuffle. Digests are
    fed turn by turn, so that no conversation is held as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            for conv, formatted, start, end in plain.itertuples(index=False, name=None):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                now.add(formatted, start, end)
                if len(out) >= _ROWS:
                    yield _digests(out)
                    out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield _digests(out)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rendered.select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, schema)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        role, text = read(formatted)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        if start is not None:
            learned = unescape(formatted[int(start) : int(end)])
            self.loss += len(learned)
            self.learned.update(learned.encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table, and conversation -7, whose texts look like the template itself."""
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    probe = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
