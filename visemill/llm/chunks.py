"""Documents as compressed chunks, and a compact shuffle that tells which keys of a chunk occur elsewhere.

A chunk holds about a megabyte of text. It is one row, so the texts cross a shuffle compressed, and what a chunk
asks of the corpus crosses it as sorted, packed keys: one row for each chunk and part of the key space. The answer is a
bit for each key. A key comes once from each chunk, however often it occurs there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import SLICE_BYTES, U64, Slice, give_back, slices
from .scratch import cut

CHUNKS = "chunk long, n_bytes long, lens binary, text binary, rows binary"


def pack_bytes(data, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level, write_content_size=True).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunk_documents(docs: DataFrame, text: str = "text", target: int = SLICE_BYTES) -> DataFrame:
    """``docs`` as chunk rows, written to the checkpoint folder; every other column travels along unread."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() << 32
        held: list[Slice] = []

        def close() -> pa.RecordBatch:
            lens = np.concatenate([np.where(s.null, -1, np.diff(s.off)) for s in held])
            data = np.concatenate([s.buf for s in held])
            rows = pa.Table.from_batches([s.rows for s in held]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            blobs = [pack_bytes(lens.astype("<i8").tobytes()), pack_bytes(data.tobytes(), 3), pack_bytes(sink.getvalue().to_pybytes())]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "n_bytes", "lens", "text", "rows"])

        for s in slices(batches, text, target):
            if held and sum(len(x.buf) for x in held) + len(s.buf) > target * 5 // 4:
                yield close()
                held, number = [], number + 1
            held.append(s)
        if held:
            yield close()

    return cut(docs.mapInArrow(run, CHUNKS))


def open_chunk(lens: bytes, text: bytes, rows: bytes) -> Slice:
    n = np.frombuffer(unpack_bytes(lens), dtype="<i8")
    off = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
    table = pa.ipc.open_stream(unpack_bytes(rows)).read_all().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    return Slice(np.frombuffer(unpack_bytes(text), dtype=np.uint8), off, n < 0, pa.RecordBatch.from_arrays(columns, schema=table.schema))


def each_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Slice, dict]]:
    """(chunk, slice, the row's further columns) for each chunk row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pydict()
            yield row.pop("chunk")[0], open_chunk(row.pop("lens")[0], row.pop("text")[0], row.pop("rows")[0]), {k: v[0] for k, v in row.items()}
    give_back()


def key_bits(chunks: DataFrame, keys_per_byte: float, keys_at_once: int = 1_000_000) -> int:
    """Bits that number the parts of the key space, so that a task handles about ``keys_at_once`` keys."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return int(min(24, max(3, np.ceil(np.log2(max(1.0, total * keys_per_byte / keys_at_once))))))


def split_by_part(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that hold any of the sorted ``keys``, and the border of each within them."""
    part = (keys >> U64(64 - bits)).astype(np.int64)
    border = np.flatnonzero(np.diff(part, prepend=-1))
    return part[border], np.append(border, len(keys))


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one part: counts by their first 16 bits, then 6 bytes each."""
    if bits > 16:
        return b"" + keys.astype("<u8").tobytes()
    count = np.bincount(((keys >> U64(48)) & U64((1 << (16 - bits)) - 1)).astype(np.int64), minlength=1 << (16 - bits))
    head = pack_bytes(count.astype("<u4").tobytes())
    return len(head).to_bytes(4, "little") + head + np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(data: bytes, part: int, bits: int) -> np.ndarray:
    if bits > 16:
        return np.frombuffer(data, dtype="<u8")
    n = int.from_bytes(data[:4], "little")
    count = np.frombuffer(unpack_bytes(data[4 : 4 + n]), dtype="<u4").astype(np.int64)
    low = np.frombuffer(data, dtype=np.uint8, offset=4 + n).reshape(-1, 6)
    wide = np.zeros((len(low), 8), dtype=np.uint8)
    wide[:, :6] = low
    return wide.view("<u8").ravel() | (np.repeat(np.arange(len(count), dtype=U64), count) << U64(48)) | (U64(part) << U64(64 - bits))


def occurring_elsewhere(chunks: DataFrame, keys_of: Callable[[Slice, dict], np.ndarray], bits: int, name: str = "shared") -> DataFrame:
    """``chunks`` with a column ``name``: for each part, the bits that tell which keys other chunks have too.

    ``keys_of`` gives a chunk's distinct 64-bit keys, sorted, from its slice and further columns; they must look uniform.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s, row in each_chunk(batches):
            keys = keys_of(s, row)
            parts, border = split_by_part(keys, bits)
            data = [pack_keys(keys[a:b], bits) for a, b in zip(border[:-1], border[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), chunk), pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["chunk", "part", "data"])

    def compare(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        each = [unpack_keys(x.as_py(), part, bits) for x in table.column("data")]
        keys = np.concatenate(each)
        by = np.argsort(keys, kind="stable")
        same = keys[by][1:] == keys[by][:-1]
        shared = np.zeros(len(keys), dtype=bool)
        shared[by[1:][same]] = True
        shared[by[:-1][same]] = True
        flags = np.split(shared, np.cumsum([len(x) for x in each])[:-1])
        any_ = [bool(x.any()) for x in flags]
        found = [np.packbits(x).tobytes() for x in flags if x.any()]
        return pa.table({"chunk": table.column("chunk").filter(pa.array(any_)), "shared": pa.array([{"part": part, "bits": x} for x in found], pa.struct([("part", pa.int64()), ("bits", pa.binary())]))})

    sent = chunks.mapInArrow(send, "chunk long, part long, data binary")
    told = sent.groupBy("part").applyInArrow(compare, "chunk long, shared struct<part: long, bits: binary>")
    return chunks.join(told.groupBy("chunk").agg(F.collect_list("shared").alias(name)), "chunk", "left")


def shared_flags(keys: np.ndarray, shared: list[dict] | None, bits: int) -> np.ndarray:
    """The answer for each of the sorted ``keys``."""
    flags = np.zeros(len(keys), dtype=bool)
    if shared:
        parts, border = split_by_part(keys, bits)
        at = {int(p): (a, b) for p, a, b in zip(parts, border[:-1], border[1:])}
        for x in shared:
            a, b = at[x["part"]]
            flags[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return flags


def with_columns(docs_schema: T.StructType, text: str, extra: list[T.StructField]) -> T.StructType:
    """Schema of the rows that travel in a chunk, and ``extra`` ones after them; a clashing name gives way to the new one."""
    new = {f.name for f in extra}
    return T.StructType([f for f in docs_schema.fields if f.name != text and f.name not in new] + extra)


def rows_with(s: Slice, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(s.rows.schema.names) if n not in extra]
    return pa.RecordBatch.from_arrays([*(s.rows.column(i) for i in keep), *extra.values()], [*(s.rows.schema.names[i] for i in keep), *extra])
