"""Chat formatting: a finite-state machine over roles and a declarative template give text segments with loss flags."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``{role}`` in ``opening`` stands for the role. Roles in ``trained`` carry loss on their text.

    Inside texts and roles the escape sign and the first character of every control string are escaped, so no control
    string can occur there and the original comes back exactly.
    """

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a conversation may end in the states of ``final``.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def control(self) -> list[str]:
        head, _, tail = self.opening.partition("{role}")
        return [x for x in (head.strip(), self.closing.strip()) if x]


def escape(text: str, template: Template) -> str:
    """Break every control string by an escape sign after its first character, and double the sign itself."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in sorted({x[0] for x in template.control()}):
        text = text.replace(c, ESCAPE + "u" + c + ESCAPE + "e")
    return text


def unescape(text: str, template: Template) -> str:
    out, i = [], 0
    while (at := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:at])
        if text[at + 1] == ESCAPE:
            out.append(ESCAPE)
            i = at + 2
        else:  # \u c \e
            out.append(text[at + 2])
            i = at + 5
    return "".join([*out, text[i:]])


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(text, loss flag) of one turn: opening, text, closing."""
    head, _, tail = template.opening.partition("{role}")
    return [(head + escape(role, template) + tail, False), (escape(text, template), role in template.trained), (template.closing, False)]


def parse(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    head, _, tail = template.opening.partition("{role}")
    turns, i = [], 0
    while i < len(formatted):
        if not formatted.startswith(head, i):
            raise ValueError(f"no turn begins at {i}")
        at = formatted.index(tail, i + len(head))
        end = formatted.index(template.closing, at + len(tail))
        turns.append((unescape(formatted[i + len(head) : at], template), unescape(formatted[at + len(tail) : end], template)))
        i = end + len(template.closing)
    return turns


SEGMENTS = "conv_id long, turn long, part int, text string, loss boolean, state string"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per segment: conv_id, turn, part (0 opening, 1 text, 2 closing), text, loss, state.

    Rows stand in order of turn within each conversation; equal turns by role and text, null turns first, null texts
    and roles count as empty. ``state`` is the machine's state after the turn, ``error`` from the first turn that its
    role may not take. Invalid conversations are formatted all the same, with ``state`` telling them.
    """
    template = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), "start"
        for batch in batches:
            rows: list[tuple] = []
            for c, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))):
                if c != conv:
                    conv, state = c, "start"
                role, text = role or "", text or ""
                state = template.transitions.get(state, {}).get(role, "error")
                rows += [(c, turn, k, s, loss, state) for k, (s, loss) in enumerate(segments(role, text, template))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv_id", "turn", "part", "text", "loss", "state"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests per conversation, parsed back from the segments of ``format_conversations``.

    Works on a stream of turns in the order in which the formatter left them, one turn in memory at a time.
    """
    template = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, out = None, False, []

        def close():
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, losses.hexdigest(), chars, state in template.final))

        pending: list[tuple[str, bool]] = []
        for batch in batches:
            for c, part, text, loss, now in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "text", "loss", "state"))):
                if not begun or c != conv:
                    if begun:
                        close()
                    begun, conv = True, c
                    n_turns, loss_chars, chars = 0, 0, 0
                    turns, losses = hashlib.sha256(), hashlib.sha256()
                state = now
                chars += len(text)
                pending.append((text, loss))
                if part < 2:
                    continue
                for role, said in parse("".join(t for t, _ in pending), template):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for t, flag in pending:
                    if flag:
                        plain = unescape(t, template)
                        loss_chars += len(plain)
                        losses.update(plain.encode())
                pending = []
            if len(out) > 5000:
                yield _digests(out)
                out = []
        if begun:
            close()
        yield _digests(out)

    return formatted.mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)
