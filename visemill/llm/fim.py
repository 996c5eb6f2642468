"""Fill-in-middle: prefix, middle and suffix change places inside one buffer, and back again.

A document's bytes stand in a bytearray. The cuts come from one scan over it, the sentinels are inserted at the cuts, and
the pieces are exchanged where they are by rotations, each made of three reversals. A rotation by the complement of its
shift undoes it, so the way back needs the output and its form only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULT = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def token_ends(text: bytes | bytearray) -> np.ndarray:
    """Where each token ends: a run of other bytes with the white space before it, or white space at the very end."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    space = SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = True
    return np.flatnonzero(ends) + 1


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange ``buffer[start:middle]`` and ``buffer[middle:end]`` in place by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        half = (b - a) // 2
        left, right = view[a : a + half], view[b - half : b]
        held = left.copy()
        left[:] = right[::-1]
        right[:] = held[::-1]


def plan(doc_id: int | None, n: int, text: bytes, seed: int, percent: int, percent_spm: int) -> tuple[str, int, int]:
    """Form, and after how many tokens the prefix and the middle end, from a hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < percent_spm else PSM, a, b


def exchange(text: bytes, form: str, a: int, b: int) -> bytearray:
    """``text``, whose prefix ends at byte ``a`` and whose middle at ``b``, in its form."""
    buffer = bytearray(text)
    if form == PLAIN:
        return buffer
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = a + 3, b + 6
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str | None) -> bytearray:
    """The text that became ``output``."""
    buffer = bytearray(output)
    if form not in (PSM, SPM):
        return buffer
    start = buffer.index(SUFFIX)
    tail = buffer.index(MIDDLE if form == PSM else PREFIX) - start
    rotate(buffer, start, start + tail, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + 3]
    return buffer


def _characters(data: bytes) -> int:
    """Code points of UTF-8 bytes: all but the continuation bytes."""
    return int((np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80).sum())


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80) -> DataFrame:
    """The columns of ``docs(doc_id, text)`` but its text, and n, form, prefix_chars, middle_chars and output.

    Texts are cut between tokens, at two places drawn from a hash of ``seed`` and doc_id. A row is ``plain``, its output
    the text, if it is empty or holds a sentinel or by the draw (100 - ``percent`` in a hundred); of the others
    ``percent_spm`` in a hundred are ``spm`` and the rest ``psm``. A null text counts as empty, a null id as an id without
    digits; repeated rows come out alike; a prefix, middle or suffix may be empty. Columns of ``docs`` that are named like
    a result give way to it, whatever their case. Texts are handled whole, one at a time.
    """
    taken = {name for name, _ in RESULT} | {"text"}
    rest = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*rest, *(T.StructField(name, kind) for name, kind in RESULT)])
    own = [f.name for f in rest if f.name.lower() == "doc_id"][0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(len(rest))]
            for first, part in _slices(batch.column(batch.num_columns - 1)):
                rows = []
                for doc_id, text in zip(batch.column(own).slice(first, len(part)).to_pylist(), part):
                    text = text.as_py() or b""
                    ends = token_ends(text)
                    form, a, b = plan(doc_id, len(ends), text, seed, percent, percent_spm)
                    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
                    counts = (None, None) if form == PLAIN else (_characters(text[:a]), _characters(text[a:b]))
                    rows.append((len(ends), form, *counts, exchange(text, form, a, b).decode()))
                new = [pa.array([r[k] for r in rows], pa.int64() if kind == T.LongType() else pa.string()) for k, (_, kind) in enumerate(RESULT)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(part)) for c in kept), *new], [f.name for f in schema.fields])

    return docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def restore_text(formed: DataFrame) -> DataFrame:
    """The columns of ``formed(output, form)`` but output and form, and ``text`` as it was before ``fill_in_middle``.

    Only output and form are read. A null output gives an empty text; a column named text gives way.
    """
    taken = {"output", "form", "text"}
    rest = [f for f in formed.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*rest, T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = batch.column(batch.num_columns - 2)
            for first, part in _slices(batch.column(batch.num_columns - 1)):
                texts = [restore(o.as_py() or b"", f.as_py()).decode() for o, f in zip(part, form.slice(first, len(part)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(part)) for i in range(len(rest))), pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return formed.select(*(F.col(f"`{f.name}`") for f in rest), "form", F.col("output").cast("binary").alias("_output")).mapInArrow(run, schema)


def _slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a binary column, each of one value or of at most ``most`` bytes, with the number of their first."""
    size = np.array([0 if v is None else v for v in pc.binary_length(column).to_pylist()], dtype=np.int64)
    first, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield first, column.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < len(column):
        yield first, column.slice(first)
