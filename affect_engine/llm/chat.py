"""Chat formatting: a role machine that emits text segments with loss flags.

A template names, for every role, the marks around its text and whether the text
counts in the loss. Conversations are dealt by id and sorted by turn inside
their partition; one pass then walks the turns as they stream by. It holds one
turn at a time, so a conversation of any length needs no more memory than its
longest turn.

The machine: an optional ``system`` turn, then ``user`` and ``assistant`` in
turn, beginning with ``user``, ending with ``assistant``. A turn that breaks the
order is flagged (``in_order`` false), is formatted all the same, and the
machine goes on from the state its role leads to. Roles outside the template
(null and empty too) use the marks of ``other`` with the escaped role inside.

Texts are escaped reversibly: a backslash is doubled, and a backslash is put
after the first character of every mark found in the text, so no mark of the
template can occur in a formatted text but as a mark.

Null texts are empty. Rows with equal conversation and turn are ordered by role,
then text. Rows without a conversation id form one conversation of their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mark:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role. ``other`` marks roles outside the template: ``open`` role ``close``."""

    roles: dict[str, Mark] = field(
        default_factory=lambda: {
            "system": Mark("<<SYS>>", "<</SYS>>"),
            "user": Mark("[INST]", "[/INST]"),
            "assistant": Mark("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    #: Allowed next roles by state; the empty state is the beginning.
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def control(self) -> list[str]:
        marks = {m for r in self.roles.values() for m in (r.before, r.after)} | set(self.other)
        return sorted(marks - {""}, key=lambda m: (-len(m), m))

    def escaper(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, self.control())) + ")(.)", re.S)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn_no", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.StringType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("in_order", T.BooleanType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("complete", T.BooleanType()),
    ]
)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _packed(rows, schema: pa.Schema, limit: int = 2 << 20):
    """Record batches of about ``limit`` characters of segment text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of ``turns (conv_id, turn, role, text)``: three per turn.

    Part 0 is the mark before, 1 the escaped text, 2 the mark after. ``last``
    marks the last segment of a conversation and ``complete``, on that row,
    whether all turns were in order and the last one may end a conversation.
    Segments of a conversation are contiguous and in order in one partition.
    """
    template = template or Template()
    pattern = template.escaper()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("segment", pa.string())]
        + [(n, pa.bool_()) for n in ("loss", "in_order", "last", "complete")]
    )

    def machine(rows):
        state, conv, turn_no, good, held = "", None, 0, True, None
        started = False
        for conv_id, role, text in rows:
            if not started or conv_id != conv:
                if held:
                    yield (*held, True, good and state in template.final)
                state, conv, turn_no, good, held, started = "", conv_id, 0, True, None, True
            elif held:
                yield (*held, False, None)
            role = role or ""
            fits = role in template.order.get(state, ())
            good &= fits
            state = role if role in template.order else state
            mark = template.roles.get(role)
            if mark is None:
                opening, middle, closing = template.other
                mark = Mark(opening + escape(role, pattern) + middle, closing)
            yield conv, turn_no, 0, mark.before, False, fits, False, None
            yield conv, turn_no, 1, escape(text or "", pattern), mark.loss, fits, False, None
            held = (conv, turn_no, 2, mark.after, False, fits)
            turn_no += 1
        if held:
            yield (*held, True, good and state in template.final)

    def run(batches):
        yield from _packed(machine(_rows(batches)), schema)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


SUMMARY = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("in_order", T.BooleanType()),
        T.StructField("complete", T.BooleanType()),
    ]
)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, parsed from the formatted segments alone.

    Takes the output of ``format_chats`` as it is dealt and sorted there: roles
    come from the marks, texts from unescaping what stands between them. Digests
    grow segment by segment.
    """
    template = template or Template()
    by_mark = {m.before: role for role, m in template.roles.items()}
    opening, middle, _ = template.other
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
        + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_()), ("complete", pa.bool_())]
    )

    def role_of(mark: str) -> str:
        if mark in by_mark:
            return by_mark[mark]
        return unescape(mark[len(opening) : len(mark) - len(middle)])

    def summaries(rows):
        turns = loss = None
        for conv, part, segment, is_loss, in_order, last, complete in rows:
            if turns is None:
                turns, loss, n, chars, total, ordered = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
            total += len(segment)
            ordered &= in_order
            if part == 0:
                n += 1
                turns.update(f"{role_of(segment)}\n".encode())
            elif part == 1:
                text = unescape(segment)
                turns.update(f"{text}\n".encode())
                if is_loss:
                    loss.update(text.encode())
                    chars += len(text)
            if last:
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, ordered, complete
                turns = None

    def run(batches):
        yield from _packed(summaries(_rows(batches)), schema)

    return segments.select("conv_id", "part", "segment", "loss", "in_order", "last", "complete").mapInArrow(run, SUMMARY)
