"""Documents as numpy byte arrays: slices of Arrow batches, word bounds, prefix hashes.

A ``Slice`` holds the UTF-8 bytes of some documents back to back. Everything below works on whole slices, so Python
runs per slice or per document, not per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
NULL_ID = np.iinfo(np.int64).max
SLICE_BYTES = 1 << 20

_all = np.arange(256)
SPACE = (_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D))
NOT_SPACE = ~SPACE
LOWER = np.where((_all >= 0x41) & (_all <= 0x5A), _all + 32, _all).astype(np.uint8)
#: Letters a-z, digits and every byte of a character beyond ASCII.
WORDLIKE = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_LANE_KEYS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Strings beyond this many bytes are hashed one at a time.
LONG_STRING = 1024


def lanes_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on as a little-endian word; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))


def string_hashes(lanes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings start[i]:end[i] of the buffer that ``lanes`` are of.

    Eight bytes at a time are mixed into the state by a bijection that is no polynomial, so that strings of a regular
    build do not collide by their build; strings of up to eight bytes never do among those of their length.
    """
    size = end - start
    h = mix(size.astype(U64) * _LANE_KEYS[0] + U64(seed))
    some, at, left = np.arange(len(start)), start, size
    long = np.flatnonzero(size > LONG_STRING)
    if len(long):
        raw = np.ascontiguousarray(lanes[::8])  # whole words from place 0 on
        raw = raw.view(np.uint8)
        for i in long.tolist():
            digest = hashlib.blake2b(raw[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(digest, "little")
        some = np.flatnonzero(size <= LONG_STRING)
        at, left = start[some], size[some]
    while len(some):
        lane = lanes[at] & _LANE_MASK[np.minimum(left, 8)]
        h[some] = mix(h[some] ^ (lane * _LANE_KEYS[1]))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return h


#: A prime and a base for rolling hashes over words that are hashes already.
PRIME = U64((1 << 61) - 1)
RADIX = 0x0B7E151628AED2A6


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(x: np.ndarray, by: int) -> np.ndarray:
    """x * by modulo the prime, in halves of 31 bits."""
    low, high = x & U64(0x7FFFFFFF), x >> U64(31)
    b0, b1 = U64(by & 0x7FFFFFFF), U64(by >> 31)
    middle = high * b0 + low * b1
    return _reduced(U64(2) * high * b1 + (middle >> U64(30)) + ((middle & U64(0x3FFFFFFF)) << U64(31)) + low * b0)


def window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**61 - 1, of each ``width`` successive values: those of windows of 1, 2, 4, ... values, put
    together by the bits of ``width``."""
    n, size, done = len(values), 1, 0
    if n < width:
        return np.zeros(0, dtype=U64)
    block, out = _reduced(values), None
    while True:
        if width & size:
            step = n - done - size + 1
            out = block if out is None else _reduced(_times(out[:step], pow(RADIX, size, int(PRIME))) + block[done : done + step])
            done += size
        if done == width:
            return out
        block = _reduced(_times(block[:-size], pow(RADIX, size, int(PRIME))) + block[size:])
        size *= 2


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then those of the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after a task, next to others of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


@dataclass
class Slice:
    buf: np.ndarray  # uint8, all texts back to back
    off: np.ndarray  # int64, len = documents + 1
    null: np.ndarray  # bool, text was null
    rows: pa.RecordBatch  # the other columns

    def __len__(self) -> int:
        return len(self.off) - 1

    def ids(self, column: str = "doc_id") -> np.ndarray:
        """int64 ids; a null id counts as larger than any other."""
        return self.rows.column(column).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null mask of a string or binary array."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    blob = column.cast(pa.large_binary()).fill_null(b"") if null.any() else column.cast(pa.large_binary())
    off = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = blob.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[off[0] : off[-1]], off - off[0], null) if len(blob) else (np.zeros(0, np.uint8), np.zeros(1, np.int64), null)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", target: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut Arrow batches at document borders into slices of about ``target`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        buf, off, null = text_bytes(batch.column(at))
        rest = batch.select([i for i in range(batch.num_columns) if i != at])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(off, off[first] + target, "right")) - 1)
            last = min(last, first + 200_000, batch.num_rows)
            yield Slice(buf[off[first] : off[last]], off[first : last + 1] - off[first], null[first:last], rest.slice(first, last - first))
            first = last
    give_back()


def word_bounds(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in ``kind`` that do not cross documents, and words before each document."""
    inside = kind[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def join_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (of non-decreasing ``doc``) joined by one space within each document.

    Returns the joined bytes, the offset of each document, and the new start of each word.
    """
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64)
    more = np.empty(len(start), dtype=np.int64)  # a space follows unless it is the document's last word
    more[:-1] = doc[1:] == doc[:-1]
    more[-1] = 0
    size = end - start
    new = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size + more, out=new[1:])
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = np.full(new[-1], 0x20, dtype=np.uint8)
    place = np.ones(new[-1], dtype=bool)
    place[new[1:][more == 1] - 1] = False
    out[place] = buf[keep]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    return out, new[bounds], new[:-1]
