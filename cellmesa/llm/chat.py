r"""Chat formatting by event-sourced reconstruction.

A log has events ``(conv_id, seq, message, kind, role, text)``. The events of a conversation are brought together, sorted by
``seq`` and folded:

- ``open``: a new message with a role and, if any, text; the same ``message`` again opens another one,
- ``delta``: text added to the end of the message's latest opening,
- ``edit``: text that replaces the message's,
- ``regenerate``: the message's text starts anew, and with it all later messages are dropped,
- ``delete``: the message is dropped.

Events of unknown kinds, and those for messages that were never opened or are gone, have no effect. Each message is rendered
as ``<turn:role>``, a line end, its text, a line end and ``</turn>`` with a line end. In texts a backslash stands before each
backslash and ``<``, and in roles also before ``>``, with ``\n`` for a line end, so any text comes back unchanged. The loss
mask lists the code point ranges of assistant texts in the rendered string.

Folding streams over sorted rows and holds one conversation's messages at a time; a conversation is one string of less than 2 GB
in one task, and more is an error. Null texts and roles are empty; rows without a conversation are one conversation with a null
id; an empty log gives no rows. Ties of ``seq`` are broken by message, kind,
role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TURN = re.compile(r"<turn:((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)\n</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
LEARNT = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def fold(events: Iterable[tuple[int | None, str, str | None, str | None]]) -> list[tuple[str, str]]:
    """Final (role, text) of each message from events ``(message, kind, role, text)`` in order."""
    order: list[list] = []  # [message, role, pieces of text]
    latest: dict[int | None, list] = {}
    for message, kind, role, text in events:
        if kind == "open":
            latest[message] = entry = [message, role or "", [text or ""]]
            order.append(entry)
            continue
        entry = latest.get(message)
        if entry is None:
            continue
        if kind == "delta":
            entry[2].append(text or "")
        elif kind == "edit":
            entry[2] = [text or ""]
        elif kind == "regenerate":
            entry[2] = [text or ""]
            at = next(i for i, x in enumerate(order) if x is entry)
            for gone in order[at + 1 :]:
                if latest.get(gone[0]) is gone:
                    del latest[gone[0]]
            del order[at + 1 :]
        elif kind == "delete":
            order = [x for x in order if x is not entry]
            del latest[message]
    return [(role, "".join(pieces)) for _, role, pieces in order]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and its loss mask."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn:{escape_role(role)}>\n", escape(text)
        if role == LEARNT:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a rendered conversation")
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations: each row opens a message and streams its text as two deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    none = F.lit(None).cast("string")
    parts = [("open", F.col("role"), none), ("delta", none, F.substring(text, F.lit(1), half)), ("delta", none, F.substring(text, half + 1, F.length(text)))]
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(kind).alias("kind"), role.alias("role"), piece.alias("text")) for i, (kind, role, piece) in enumerate(parts)))
    return rows.select("conv_id", "message", F.explode(each).alias("e")).select("conv_id", (F.col("message") * 4 + F.col("e.k")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_starts, loss_ends)`` for every conversation of an event log."""
    schema = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv: int | None, held: list) -> pa.RecordBatch:
            messages = fold(held)
            formatted, mask = render(messages)
            lists = [pa.array([[m[i] for m in mask]], pa.list_(pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([len(messages)], pa.int64()), pa.array([formatted]), *lists], names=["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])

        held, now, done = [], None, []
        for batch in batches:
            for conv, *event in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and conv != now:
                    done.append(row(now, held))
                    held = []
                    if len(done) >= 200:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done = []
                now = conv
                held.append(event)
        if held:
            done.append(row(now, held))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    named = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), "kind", "role", "text", "seq")
    ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text")
    return ordered.select("conv_id", "message", "kind", "role", "text").mapInArrow(work, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the rendered strings and masks finds in them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(work, schema)
