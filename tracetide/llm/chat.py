"""Chat formatting from an event log.

Events (conversation, turn, message, seq, kind, role, text) are partitioned by
conversation and message, sorted by sequence, and folded into final messages:

* ``open``        starts a message with its role,
* ``delta``       appends text (a streamed piece),
* ``edit``        replaces the text so far,
* ``regenerate``  drops the text so far; deltas of the new answer follow,
* ``delete``      takes the message back.

The messages are rendered with control strings around each turn.  Inside texts
and roles the backslash and the opening of a control string are escaped, and
line feeds in roles, so the output can be read back exactly.  Spans of
assistant texts (code points of the output) are the loss mask.

The messages are then dealt to tasks by ranges of their place, so one conversation
may hold any part of all rows; its output is a series of segments. Only a
single message must stay below Spark's 2 GB for a value.

Defined results: null texts and roles are empty; turns are ordered by turn
(null first), then role, then a hash of the text, as the message's first event has them; repeated
rows are repeated turns; events of one message and seq are taken in order of kind and text; an event
of an unknown kind is ignored; events of a message that was never opened open
it with an empty role; a null conversation id is a conversation of its own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
DELTA_CHARS = 256
SEGMENT_CHARS = 1 << 14
BATCH_CHARS, BATCH_ROWS = 1 << 22, 4096
_PARSE = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(output, loss spans) of messages (role, text)."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = OPEN + escape_role(role) + "\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(output: str) -> list[tuple[str, str]]:
    """Messages of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(output)]


def masked_text(output: str, spans) -> str:
    """Unescaped text under the loss mask."""
    return "".join(unescape(output[a:b]) for a, b in spans)


def events_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of a table of whole turns (conv_id, turn, role, text): an open and its streamed deltas."""
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("message", F.monotonically_increasing_id()).withColumn("tie", F.sha2("text", 256))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / delta_chars).cast("int")),
                         lambda i: F.struct(i.alias("seq"), F.when(i == 0, "open").otherwise("delta").alias("kind"),
                                            F.when(i == 0, "").otherwise(F.substring("text", (i - 1) * delta_chars + 1, F.lit(delta_chars))).alias("text")))
    return t.select("conv_id", "turn", "role", "tie", "message", F.explode(pieces).alias("e")).select("conv_id", "turn", "role", "tie", "message", "e.*")


def fold(state: dict, order: list, event: tuple) -> None:
    """Apply one event (message, kind, role, text) to the messages so far."""
    message, kind, role, text = event
    if kind not in ("open", "delta", "edit", "regenerate", "delete"):
        return
    if message not in state:
        state[message] = [role if kind == "open" else "", []]
        order.append(message)
    if kind == "delta":
        state[message][1].append(text)
    elif kind == "edit":
        state[message][1] = [text]
    elif kind == "regenerate":
        state[message][1] = []
    elif kind == "delete":
        order.remove(message)
        del state[message]


LOSS = "array<struct<start:bigint,end:bigint>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PLACE = ["conv_id", "turn", "role", "tie", "message"]


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, message, said (role as opened), text of each message that is left.

    Events are partitioned by (conversation, message), so a long conversation is folded by many tasks.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()),
                        ("message", pa.int64()), ("said", pa.string()), ("text", pa.string())])

    def run(batches):
        last, place, state, order, rows, held = None, None, {}, [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        for batch in batches:
            for conv, message, turn, role, tie, kind, text in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if place is None or (conv, message) != last:
                    if order:
                        rows.append((*place, state[order[0]][0], "".join(state[order[0]][1])))
                        held += len(rows[-1][-1])
                        if held >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                            yield flush()
                            rows, held = [], 0
                    last, place, state, order = (conv, message), (conv, turn, role, tie, message), {}, []
                fold(state, order, (message, kind, role or "", text or ""))
        if order:
            rows.append((*place, state[order[0]][0], "".join(state[order[0]][1])))
        if rows:
            yield flush()

    parts = events.select(F.col("conv_id").cast("bigint"), F.col("message").cast("bigint"), F.col("turn").cast("bigint"), "role", "tie", "kind", "text", "seq")
    parts = parts.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "turn", "role", "tie", "kind", "text")
    return parts.drop("seq").mapInArrow(run, "conv_id bigint, turn bigint, role string, tie string, message bigint, said string, text string")


def _segments_of_tasks(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of a task rendered together: part (the task's range), number and start within it."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("start", pa.int64()),
                        ("formatted", pa.string()), ("loss", SPANS), ("n_turns", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        part, conv, number, start, held, size = TaskContext.get().partitionId(), None, 0, 0, [], 0

        def segment():
            text, spans = render(held)
            row = {"conv_id": conv, "part": part, "number": number, "start": start, "formatted": text,
                   "loss": [{"start": start + a, "end": start + b} for a, b in spans], "n_turns": len(held)}
            return len(text), pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for own, said, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (own != conv or size >= SEGMENT_CHARS):
                    chars, out = segment()
                    yield out
                    number, start, held, size = number + 1, start + chars, [], 0
                if own != conv:
                    conv, number, start = own, 0, 0
                held.append((said, text))
                size += len(text) + 1
        if held:
            yield segment()[1]

    placed = messages.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select("conv_id", "said", "text")
    return placed.mapInArrow(run, f"conv_id bigint, part int, number bigint, start bigint, formatted string, loss {LOSS}, n_turns bigint")


def format_segments(events: DataFrame) -> DataFrame:
    """conv_id, segment (0, 1, ... in a conversation), start, formatted, loss, n_turns of each piece of a conversation.

    A conversation is its segments one after the other. A segment holds whole turns, at least 16K characters of
    them if more follow; ``start`` and the spans of ``loss`` are code points of the whole conversation. Ranges of
    (conversation, turn, ...) are dealt to tasks, and the sums of each (conversation, range) are carried
    to the later ranges: no task and no value holds a whole conversation.

    ``events``: conv_id, turn, role, tie, message, seq, kind, text.
    """
    own = stored(_segments_of_tasks(final_messages(events)))
    sums = own.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")) \
        .agg(F.sum(F.length("formatted")).alias("chars"), F.count(F.lit(1)).alias("segments"))
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("c", "p", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"),
                        F.coalesce(F.sum("segments").over(before), F.lit(0)).alias("segments"))
    out = own.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    shifted = F.transform("loss", lambda x: F.struct((x["start"] + F.col("chars")).alias("start"), (x["end"] + F.col("chars")).alias("end")))
    return out.select("conv_id", (F.col("number") + F.col("segments")).alias("segment"), (F.col("start") + F.col("chars")).alias("start"),
                      "formatted", shifted.alias("loss"), "n_turns")


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans), n_turns: each conversation as one value, which must stay
    below 2 GB. Longer ones are read as segments."""
    parts = format_segments(events).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "formatted", "loss"))).alias("s"), F.sum("n_turns").alias("n_turns"))
    return parts.select("conv_id", F.array_join(F.col("s.formatted"), "").alias("formatted"), F.flatten("s.loss").alias("loss"), "n_turns")
