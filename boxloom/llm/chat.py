"""Chat formatting from an event log.

A conversation's log holds events by sequence number, each for one turn:

* ``message`` sets the turn's text (and role),
* ``delta`` appends to it,
* ``edit`` replaces it and voids what later turns said before the edit,
* ``regenerate`` empties it for a new stream and voids later turns alike.

Events of one turn may differ in ``slot``: each slot is a message of its own, in
the slots' order (:func:`logged` gives every row of a table of messages one).

The log is dealt by conversation, sorted by turn, slot and sequence number, and
folded as it streams by: whether an event is void depends only on the latest
edit of the turns before, so that a task holds one turn at a time, however long
the conversation. Each final turn is rendered as it is complete::

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts a backslash becomes two, and ``<|`` becomes ``<\\|``, so
that no control string can arise there and every text can be had back; a line
feed in a role becomes ``\\n``. The loss mask has the places of the assistants'
texts in the formatted conversation.

Defined results: a null text or role counts as empty; null turns sort last, null
slots and sequence numbers first; equal ones are taken by kind, role and text; a
null conversation is one of its own; a turn whose events are all void is left
out; an unknown kind counts as ``message``; an empty log gives no rows. All rows
of one conversation (or of none) are folded by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
EVENTS = ("conv_id", "turn", "slot", "seq", "kind", "role", "text")
TURNS = "conv_id long, turn long, role string, formatted string, at long, loss_start long, loss_end long"
_ROWS = 2048


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def events(messages: DataFrame) -> DataFrame:
    """A log with one ``message`` event a row of (conv_id, turn, role, text): of a turn's rows the last replaces the others."""
    turn = F.col("turn").cast("long")
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), turn.alias("seq"), F.lit("message").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def logged(messages: DataFrame) -> DataFrame:
    """A log, as a chat service would have written it, whose final messages are the rows of (conv_id, turn, role, text), each once.

    By a hash of the row it is said at once, streamed as deltas, corrected by an
    edit, or broken off and regenerated. Rows of one turn get slots in the order
    of role and text; like rows are numbered.
    """
    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = plain.groupBy(*plain.columns).count().select("*", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    role, text = F.coalesce("role", F.lit("")), F.col("text")
    slot = F.concat_ws("\0", role, F.substring(text, 1, 32), F.hex(F.xxhash64(role, text)), F.lpad(F.col("copy").cast("string"), 12, "0"))
    n, none = F.char_length(text), F.lit(None).cast("string")
    part = lambda i: F.substring(text, F.floor(n * i / 3).cast("int") + 1, (F.floor(n * (i + 1) / 3) - F.floor(n * i / 3)).cast("int"))
    said = lambda kind, who, what: F.struct(F.lit(kind).alias("kind"), who.alias("role"), what.alias("text"))
    deltas = [said("delta", none, part(i)) for i in range(3)]
    begun, draft = said("message", F.col("role"), F.lit("")), F.concat(F.reverse(text), F.lit("?"))
    ways = [[said("message", F.col("role"), text)], [begun, *deltas], [said("message", F.col("role"), draft), said("edit", none, text)], [begun, deltas[0], said("delta", none, draft), said("regenerate", none, none), *deltas]]
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text", "copy"), F.lit(len(ways)))
    chosen = F.array(*ways[0])
    for i, w in enumerate(ways[1:], 1):
        chosen = F.when(way == i, F.array(*w)).otherwise(chosen)
    # sequence numbers run on from turn to turn, those of null turns at the end
    base = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(str(10**19)).cast("decimal(20,0)")) * F.lit(8).cast("decimal(2,0)")
    steps = each.select("conv_id", "turn", slot.alias("slot"), base.alias("base"), F.posexplode(chosen).alias("step", "e"))
    return steps.select("conv_id", "turn", "slot", (F.col("base") + F.col("step").cast("decimal(2,0)")).alias("seq"), "e.kind", "e.role", "e.text")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_TURN_NAMES = ["conv_id", "turn", "role", "formatted", "at", "loss_start", "loss_end"]
_TURN_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, str, str]]:
    """(conv_id, turn, role, text) of final messages, from events sorted by conversation, turn, slot and sequence number."""
    conv = turn = slot = object()
    role, parts, alive = "", [], False
    cut_before = cut_here = None  # the latest edit of the turns before, and of this one
    for batch in batches:
        for c, t, place, seq, kind, who, text in zip(*(batch.column(n).to_pylist() for n in EVENTS), strict=True):
            if c != conv or t != turn or place != slot:
                if alive:
                    yield conv, turn, role, "".join(parts)
                if c != conv:
                    cut_before = cut_here = None
                elif t != turn:
                    cut_before = max((x for x in (cut_before, cut_here) if x is not None), default=None)
                    cut_here = None
                conv, turn, slot, role, parts, alive = c, t, place, "", [], False
            if cut_before is not None and (seq is None or seq < cut_before):
                continue
            if kind in ("edit", "regenerate") and seq is not None:
                cut_here = seq if cut_here is None else max(cut_here, seq)
            if who is not None:
                role = who
            if kind == "delta":
                parts.append(text or "")
            else:
                parts = [text or ""]
            alive = True
    if alive:
        yield conv, turn, role, "".join(parts)


def _formatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, conv, at = [], object(), 0
    for c, turn, role, text in _finals(batches):
        if c != conv:
            conv, at = c, 0
        shown, begin, end = render(role, text)
        loss = (at + begin, at + end) if role == ASSISTANT else (None, None)
        rows.append((c, turn, role, shown, at, *loss))
        at += len(shown)
        if len(rows) == _ROWS:
            yield _batch(rows, _TURN_NAMES, _TURN_TYPES)
            rows = []
    if rows:
        yield _batch(rows, _TURN_NAMES, _TURN_TYPES)


def format_log(log: DataFrame) -> DataFrame:
    """Final turns in order: formatted text, its place in the conversation, and the loss mask's places (null: none).

    A conversation's rows are one after the other in one partition; its
    formatted text is their ``formatted`` joined.
    """
    slot = log["slot"].cast("string") if "slot" in log.columns else F.lit(None).cast("string")
    named = log.select(*[slot.alias("slot") if n == "slot" else F.col(n) for n in EVENTS])
    return named.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "slot", "seq", "kind", "role", "text").mapInArrow(_formatter, TURNS)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_DIGEST_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text; ValueError if anything else is in it."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, conv, state = [], object(), None

    def close():
        n, turns, chars, loss, length = state
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length)

    for batch in batches:
        for c, shown, at, begin, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "at", "loss_start", "loss_end")), strict=True):
            if c != conv:
                if state:
                    rows.append(close())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(shown):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if begin is not None:
                learned = unescape(shown[begin - at : end - at])
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
            state[4] += len(shown)
        if len(rows) >= _ROWS:
            yield _batch(rows, _DIGEST_NAMES, _DIGEST_TYPES)
            rows = []
    if state:
        rows.append(close())
    if rows:
        yield _batch(rows, _DIGEST_NAMES, _DIGEST_TYPES)


def read_back(formatted: DataFrame) -> DataFrame:
    """A conversation's digests, from its formatted rows as :func:`format_log` leaves them."""
    return formatted.mapInArrow(_digester, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
