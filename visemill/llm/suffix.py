"""Exact substring dedup by suffix sorting.

Every substring of ``depth`` bytes contains one anchor: the position whose 16 bytes hash lowest, the first of equals.
Equal substrings have equal anchors at equal places, so only substrings around anchors that occur twice can repeat. One
exchange of packed anchor keys tells which do. A second one, of hashes of the text around them, finds candidates: those
whose whole surrounding a smaller document seems to have too. The text around what is left is shuffled by anchor and
sorted as suffixes within each anchor, and runs with a common prefix of ``depth`` bytes give the document that holds each
substring first. The candidates' text meets the text that they are said to equal and is compared byte for byte. A
candidate that differs betrays a collision, and everything begins anew with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LONG_STRING, U64, Slice, give_back, lanes_of, mix, ragged, string_hashes
from .chunks import chunk_documents, each_chunk, key_bits, occurring_elsewhere, pack_bytes, pack_keys, rows_with, shared_flags, split_by_part, unpack_bytes, unpack_keys, with_columns
from .scratch import cut

ANCHOR = 16
#: Windows of a text whose anchors are found at once.
ANCHORS_AT_ONCE = 4 << 20
RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
#: Suffixes that a task compares at once.
SUFFIXES_AT_ONCE = 200_000
#: Surroundings of anchors that a task unpacks at once.
CONTEXTS_AT_ONCE = 20_000
#: Short texts that are compared with others at once.
TEXTS_AT_ONCE = 8192


# ---------------------------------------------------------------- suffix sort
class Suffixes:
    """Prefixes of ``depth`` bytes of the suffixes of ``buf``, sorted by eight bytes at a time."""

    def __init__(self, buf: np.ndarray, depth: int):
        self.lanes, self.depth = lanes_of(buf), depth

    def _sorted(self, start: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of ``start`` by bucket, then suffix, and whether each there differs from the one before it.

        Suffixes that agree so far are a group, whose next eight bytes part it; those that are alone in theirs are left out.
        """
        order = np.argsort(bucket, kind="stable")
        head = np.ones(len(order), dtype=bool)
        head[1:] = bucket[order[1:]] != bucket[order[:-1]]
        at = np.arange(len(order))
        for done in range(0, self.depth, 8):
            alone = head[at]
            alone[:-1] &= head[at[1:]]  # places left out stand before a head
            at = at[~alone]
            if not len(at):
                break
            word = self.lanes[start[order[at]] + done].byteswap()
            if self.depth - done < 8:
                word &= U64((1 << 64) - (1 << 8 * (8 - self.depth + done)))
            group = np.cumsum(head[at])
            by = np.lexsort((word, group))
            order[at] = order[at[by]]
            head[at[1:]] |= word[by[1:]] != word[by[:-1]]
        return order, head

    def sort(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of ``start`` by bucket, then suffix."""
        return self._sorted(start, bucket)[0]

    def classes(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Number of the class of each suffix: those of a bucket that share their first ``depth`` bytes."""
        order, head = self._sorted(start, bucket)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(head) - 1
        return out


# ---------------------------------------------------------------- anchors
def anchors(s: Slice, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows of ``depth`` bytes with the same anchor: key, anchor position, first and last window.

    A long text is worked through in overlapping pieces, and a run that goes on in the next piece is put together.
    """
    runs = [_anchors(s.buf[at : at + ANCHORS_AT_ONCE + depth - 1], s.off - at, depth, at) for at in range(0, max(len(s.buf) - depth + 1, 1), ANCHORS_AT_ONCE)]
    key, anchor, first, last = (np.concatenate(x) for x in zip(*runs))
    if len(runs) > 1:
        goes_on = np.zeros(len(key), dtype=bool)
        goes_on[1:] = (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1) & (first[1:] % ANCHORS_AT_ONCE == 0) & ~np.isin(first[1:], s.off)
        key, anchor, first, last = key[~goes_on], anchor[~goes_on], first[~goes_on], last[np.append(np.flatnonzero(~goes_on)[1:] - 1, len(last) - 1)]
    return key, anchor, first, last


def _anchors(buf: np.ndarray, off: np.ndarray, depth: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a piece of a slice that begins at ``base``; ``off`` are the documents' borders as seen from there."""
    none = np.zeros(0, np.int64)
    n = len(buf) - depth + 1
    if n <= 0:
        return none.astype(U64), none, none, none
    lanes = lanes_of(buf)
    at = len(buf) - ANCHOR + 1
    key = mix(mix(lanes[:at]) ^ lanes[8 : at + 8])
    low = (key & U64(0xFFFFFFFF00000000)) | np.arange(at, dtype=U64)
    span, width = depth - ANCHOR + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    anchor = (low[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    a = np.clip(off[:-1], 0, n)
    b = np.clip(np.maximum(off[1:] - depth + 1, off[:-1]), 0, n)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    inside = np.cumsum(edge[:-1]) > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    # the lowest of many hashes crowd at the low end: mixed once more they fill all parts of the key space alike
    return mix(key[anchor[first]]), base + anchor[first], base + first, base + np.flatnonzero(tail)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as maximal disjoint ones."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    head = np.concatenate([[True], start[1:] > end[:-1]])
    return start[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]


def pack_intervals(start: np.ndarray, end: np.ndarray) -> bytes:
    return pack_bytes(np.stack([np.diff(start, prepend=0), end - start]).astype("<i4").tobytes())


def unpack_intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, size = np.frombuffer(unpack_bytes(data), dtype="<i4").astype(np.int64).reshape(2, -1)
    start = np.cumsum(step)
    return start, start + size


def pack_contexts(key, doc, first, count, shift, text) -> bytes:
    """Anchor keys, document ids, chunk positions of the first windows, their number, anchor minus first window, texts."""
    n = len(key).to_bytes(4, "little")
    return pack_bytes(n + key.astype("<u8").tobytes() + doc.astype("<i8").tobytes() + first.astype("<i8").tobytes() + count.astype("<i4").tobytes() + shift.astype("<i4").tobytes() + text.tobytes())


def unpack_contexts(data: bytes):
    data = unpack_bytes(data)
    n = int.from_bytes(data[:4], "little")
    wide = [np.frombuffer(data, dtype=t, count=n, offset=4 + 8 * n * k) for k, t in enumerate(("<u8", "<i8", "<i8"))]
    short = [np.frombuffer(data, dtype="<i4", count=n, offset=4 + 24 * n + 4 * n * k).astype(np.int64) for k in range(2)]
    return [*wide, *short, np.frombuffer(data, dtype=np.uint8, offset=4 + 32 * n)]


def pack_claims(buf, first, size, holder) -> bytes:
    """Texts ``size`` bytes from ``first`` on, bytes that several cover once, and the chunk that each is said to be in."""
    by = np.argsort(first, kind="stable")
    first, size, holder = first[by], size[by], holder[by]
    text = [buf[a:b] for a, b in zip(*(x.tolist() for x in union(first, first + size)))]
    numbers = np.stack([np.diff(first, prepend=0), size, holder]).astype("<i8")
    return pack_bytes(len(first).to_bytes(8, "little") + numbers.tobytes() + np.concatenate(text).tobytes())


def unpack_claims(data: bytes):
    """First bytes in the sender's chunk, sizes, chunks, the texts, and where in them each begins."""
    data = unpack_bytes(data)
    n = int.from_bytes(data[:8], "little")
    step, size, holder = np.frombuffer(data, dtype="<i8", count=3 * n, offset=8).reshape(3, -1)
    first = np.cumsum(step)
    start, end = union(first, first + size)
    run = np.searchsorted(start, first, "right") - 1
    return first, size, holder, np.frombuffer(data, dtype=np.uint8, offset=8 + 24 * n), (np.cumsum(end - start) - (end - start))[run] + first - start[run]


def same_texts(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``at`` of a and from ``to`` of b on are equal, for each."""
    out = np.ones(len(size), dtype=bool)
    for i in np.flatnonzero(size > LONG_STRING).tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[to[i] : to[i] + size[i]])
    short = np.flatnonzero((size <= LONG_STRING) & (size > 0))
    for some in np.split(short, range(TEXTS_AT_ONCE, len(short), TEXTS_AT_ONCE)):
        if len(some):
            n = size[some]
            out[some] = np.logical_and.reduceat(a[ragged(at[some], n)] == b[ragged(to[some], n)], np.cumsum(n) - n)
    return out


def verified(claims: Iterable[bytes], evidence: list[tuple[int, bytes]], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Starts and ends of each sender's claimed texts, and whether the chunk named for each does lend that very text."""
    lent = [(chunk, *unpack_claims(data)) for chunk, data in evidence]
    text = np.concatenate([np.zeros(0, np.uint8), *(x[4] for x in lent)])
    base = np.cumsum([0, *(len(x[4]) for x in lent)])
    start = np.concatenate([np.zeros(0, np.int64), *(x[5] + b for x, b in zip(lent, base))])
    size = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in lent)])
    chunk = np.repeat(np.array([x[0] for x in lent], dtype=np.int64), [len(x[1]) for x in lent])
    h = string_hashes(lanes_of(text), start, start + size, seed) ^ mix(chunk.astype(U64))
    by = np.argsort(h)
    h, start, size = h[by], start[by], size[by]
    for data in claims:
        first, n, holder, mine, at = unpack_claims(data)
        asked = string_hashes(lanes_of(mine), at, at + n, seed) ^ mix(holder.astype(U64))
        k = np.searchsorted(h, asked)
        ok = k < len(h)
        ok[ok] = (h[k[ok]] == asked[ok]) & (size[k[ok]] == n[ok])
        yield first, first + n, bool(ok.all() and same_texts(mine, at, text, start[k], n).all())


def settle_in_chunk(s: Slice, doc: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Occurrences (of equal text around equal anchors) of which a smaller document of the chunk has the same."""
    h = string_hashes(lanes_of(s.buf), first, first + size) ^ key
    by = np.lexsort((doc, h))
    h, d, f, z = h[by], doc[by], first[by], size[by]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    least = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = np.flatnonzero((d > d[least]) & (z == z[least]))
    if len(later):
        same = s.buf[ragged(f[later], z[later])] == s.buf[ragged(f[least[later]], z[later])]
        later = later[np.logical_and.reduceat(same, np.cumsum(z[later]) - z[later])]
    out = np.zeros(len(h), dtype=bool)
    out[by[later]] = True
    return out


def covered(key, doc, count, shift, text, depth: int) -> np.ndarray:
    """For each window of each context: does a document with a smaller id have the same ``depth`` bytes?

    Contexts are sorted by anchor key; a part's worth of them is judged a bounded number of suffixes at a time.
    """
    size = count + depth - 1
    place = np.cumsum(size) - size
    window = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=bool)
    group = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    first = 0
    while first < len(key):
        want = np.searchsorted(window, window[first] + SUFFIXES_AT_ONCE, "right")
        k = np.searchsorted(group, want, "right") - 1
        last = int(group[k]) if group[k] > first else int(group[k + 1]) if k + 1 < len(group) else len(key)
        if want >= len(key):
            last = len(key)
        own = np.arange(first, last)
        base = place[first]
        buf = text[base : place[last - 1] + size[last - 1]]
        at = place[own] - base
        # equal contexts once, with their smallest document
        h = string_hashes(lanes_of(buf), at, at + size[own]) ^ mix(key[own] + shift[own].astype(U64))
        kind, one, back = np.unique(h, return_index=True, return_inverse=True)
        agree = size[own] == size[own][one[back]]
        agree[agree] = np.logical_and.reduceat(buf[ragged(at[agree], size[own][agree])] == buf[ragged(at[one[back[agree]]], size[own][agree])], np.cumsum(size[own][agree]) - size[own][agree])
        if not agree.all():  # two texts of one hash: leave each for itself
            odd = np.flatnonzero(~agree)
            back[odd] = len(one) + np.arange(len(odd))
            one = np.concatenate([one, odd])
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, back, doc[own])
        n = count[own][one]
        start = ragged(at[one], n)
        offset = np.repeat(shift[own][one], n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        bucket = mix(np.repeat(key[own][one], n) + offset.astype(U64))
        kinds = Suffixes(buf, depth).classes(start, bucket)
        holder = np.full(int(kinds.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(holder, kinds, np.repeat(least, n))
        by_window = holder[kinds]
        of_kind = np.cumsum(n) - n
        out[window[first] : window[last - 1] + count[last - 1]] = by_window[ragged(of_kind[back], count[own])] < np.repeat(doc[own], count[own])
        first = last
    return out


# ---------------------------------------------------------------- the job
def covered_spans(chunks: DataFrame, depth: int, bits: int, seed: int, hash_bits: int) -> DataFrame:
    """Packed intervals of chunk bytes to remove, and whether a candidate was none (collided). Candidates are found by
    hashes of ``hash_bits`` bits (whole texts: twice as many)."""
    mask = U64((1 << hash_bits) - 1)

    def keys_of(s: Slice, _: dict) -> np.ndarray:
        return np.unique(anchors(s, depth)[0])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s, _ in each_chunk(batches):
            data = s.buf.tobytes()
            at = np.flatnonzero(np.diff(s.off) >= depth)
            marks = [hashlib.blake2b(data[s.off[i] : s.off[i + 1]], digest_size=max(1, hash_bits // 4), salt=seed.to_bytes(8, "little")).digest() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk), pa.int64()), pa.array(at, pa.int32()), pa.array(s.ids()[at], pa.int64()), pa.array(marks, pa.binary())], ["chunk", "at", "doc", "digest"])

    # of texts that are alike as a whole only the one with the smallest id needs judging
    marked = chunks.mapInArrow(digests, "chunk long, at int, doc long, digest binary")
    first_of = marked.groupBy("digest").agg(F.min(F.struct("doc", "chunk", "at")).alias("least"))
    none = F.lit(None)
    alike = marked.join(first_of, "digest").filter("doc > least.doc").select(F.explode(F.array(
        F.struct("chunk", F.struct("at", F.col("least.chunk").alias("to"), F.col("least.at").alias("of")).alias("copy"), none.cast("int").alias("lent")),
        F.struct(F.col("least.chunk").alias("chunk"), none.cast("struct<at: int, to: long, of: int>").alias("copy"), F.col("least.at").alias("lent")),
    )).alias("x")).select("x.*")
    copies = alike.groupBy("chunk").agg(F.collect_list("copy").alias("copies"), F.collect_set("lent").alias("lent"))

    def open_questions(s: Slice, row: dict):
        """Anchors left to judge, by key: key, anchor, first and last window, document; and what the chunk settles alone."""
        key, anchor, first, last = anchors(s, depth)
        keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
        copied = np.zeros(len(s), dtype=bool)
        copied[[x["at"] for x in row["copies"] or []]] = True
        own = np.searchsorted(s.off, first, "right") - 1
        take = ((count > 1) | shared_flags(keys, row["shared"], bits))[at] & ~copied[own]
        key, anchor, first, last, doc = key[take], anchor[take], first[take], last[take], s.ids()[own[take]]
        settled = settle_in_chunk(s, doc, first, last - first + depth, key) if len(key) else np.zeros(0, dtype=bool)
        left = np.flatnonzero(~settled)
        left = left[np.argsort(key[left], kind="stable")]
        gone = first[settled], last[settled] + depth
        return key[left], anchor[left], first[left], last[left], doc[left], gone

    def send_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s, row in each_chunk(batches):
            key, anchor, first, last, doc, _ = open_questions(s, row)
            h = (string_hashes(lanes_of(s.buf), first, last + depth, seed) ^ mix((anchor - first).astype(U64))) & mask
            parts, border = split_by_part(key, bits)
            data = [pack_keys(key[a:b], bits) for a, b in zip(border[:-1], border[1:])]
            more = [h[a:b].astype("<u8").tobytes() + pack_bytes(doc[a:b].astype("<i8").tobytes()) for a, b in zip(border[:-1], border[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), chunk), pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], ["chunk", "part", "data", "more"])

    def compare(table: pa.Table) -> pa.Table:
        """For each anchor: whole (its surrounding seems to be in a smaller document, in a chunk that is named), in need of
        its text (other surroundings of the same anchor exist), or neither; and lent (what others are whole by)."""
        part = table.column("part")[0].as_py()
        each = [unpack_keys(x.as_py(), part, bits) for x in table.column("data")]
        size = [len(x) for x in each]
        key = np.concatenate(each)
        more = [x.as_py() for x in table.column("more")]
        h = np.concatenate([np.frombuffer(x, "<u8", count=n) for x, n in zip(more, size)])
        doc = np.concatenate([np.frombuffer(unpack_bytes(x[8 * n :]), "<i8") for x, n in zip(more, size)])
        by = np.lexsort((doc, h, key))
        k, g, d = key[by], h[by], doc[by]
        kind = np.ones(len(by), dtype=bool)
        kind[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        head = np.flatnonzero(kind)[np.cumsum(kind) - 1]
        least = d[head]
        new = np.ones(len(by), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        whole, text, lent, holder = (np.zeros(len(by), dtype=t) for t in (bool, bool, bool, np.int64))
        whole[by] = d > least
        text[by] = (d == least) & (kinds > 1)
        lent[by[head[d > least]]] = True
        holder[by] = np.repeat(table.column("chunk").to_numpy(), size)[by][head]
        cuts = np.cumsum(size)[:-1]
        states = [{"part": part, "bits": np.packbits(np.concatenate([a, b, c])).tobytes(), "holders": pack_bytes(to[a].astype("<i8").tobytes())} for a, b, c, to in zip(*(np.split(x, cuts) for x in (whole, text, lent, holder)))]
        return pa.table({"chunk": table.column("chunk"), "state": pa.array(states, pa.struct([("part", pa.int64()), ("bits", pa.binary()), ("holders", pa.binary())]))})

    def part_of(chunk: int) -> int:
        return int(mix(np.array([chunk], dtype=U64))[0] >> U64(64 - bits))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s, row in each_chunk(batches):
            key, anchor, first, last, doc, gone = open_questions(s, row)
            parts_of, border = split_by_part(key, bits)
            whole, text, lent = np.zeros((3, len(key)), dtype=bool)
            holder = np.zeros(len(key), dtype=np.int64)
            at = {int(p): (a, b) for p, a, b in zip(parts_of, border[:-1], border[1:])}
            for x in row["states"] or []:
                a, b = at[x["part"]]
                flags = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=3 * (b - a)).astype(bool)
                whole[a:b], text[a:b], lent[a:b] = flags.reshape(3, -1)
                holder[a:b][whole[a:b]] = np.frombuffer(unpack_bytes(x["holders"]), "<i8")
            parts, data = [], []
            # of copies of one text the chunk claims the first, and compares the others with that
            ones, others, like = {}, [], []
            for x in row["copies"] or []:
                one = x["of"] if x["to"] == chunk else ones.setdefault((x["to"], x["of"]), x["at"])
                if one != x["at"]:
                    others.append(x["at"])
                    like.append(one)
            others, like = np.array(others, dtype=np.int64), np.array(like, dtype=np.int64)
            length = np.diff(s.off)
            alike = length[others] == length[like]
            if not (alike.all() and same_texts(s.buf, s.off[others], s.buf, s.off[like], length[others]).all()):
                parts.append(0)
                data.append(b"x")
            start, end = union(np.concatenate([gone[0], s.off[others]]), np.concatenate([gone[1], s.off[others + 1]]))
            if len(start):
                parts.append(part_of(chunk))
                data.append(b"i" + pack_intervals(start, end))
            copy, docs_lent = np.array(list(ones.values()), dtype=np.int64), np.array(sorted(row["lent"] or []), dtype=np.int64)
            mine = np.concatenate([first[whole], s.off[copy]]), np.concatenate([(last - first + depth)[whole], length[copy]]), np.concatenate([holder[whole], np.array([to for to, _ in ones], dtype=np.int64)])
            part = (mix(mine[2].astype(U64)) >> U64(64 - bits)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            for of in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
                if len(of):
                    parts.append(int(part[of[0]]))
                    data.append(b"v" + pack_claims(s.buf, *(x[of] for x in mine)))
            begin, size = np.concatenate([first[lent], s.off[docs_lent]]), np.concatenate([(last - first + depth)[lent], length[docs_lent]])
            if len(begin):
                parts.append(part_of(chunk))
                data.append(b"e" + pack_claims(s.buf, begin, size, np.zeros_like(begin)))
            left = np.flatnonzero(text)
            part = (key[left] >> U64(64 - bits)).astype(np.int64)
            for of in np.split(left, np.flatnonzero(np.diff(part)) + 1):
                if len(of):
                    size = last[of] - first[of] + 1
                    parts.append(int(key[of[0]] >> U64(64 - bits)))
                    data.append(b"c" + pack_contexts(key[of], doc[of], first[of], size, anchor[of] - first[of], s.buf[ragged(first[of], size + depth - 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), chunk), pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["chunk", "part", "data"])

    def judge(table: pa.Table) -> pa.Table:
        to, spans, rows, claims, evidence, collided = [], [], [], [], [], False
        for c, data in zip(table.column("chunk").to_pylist(), table.column("data")):
            data = data.as_py()
            if data[:1] == b"i":
                to.append(c)
                spans.append(data[1:])
            elif data[:1] == b"v":
                claims.append((c, data[1:]))
            elif data[:1] == b"e":
                evidence.append((c, data[1:]))
            elif data[:1] == b"x":
                collided = True
                to.append(c)
                spans.append(pack_intervals(np.zeros(0, np.int64), np.zeros(0, np.int64)))
            else:
                rows.append((c, unpack_contexts(data[1:])))
        for (c, _), (start, end, ok) in zip(claims, verified((x for _, x in claims), evidence, seed)):
            collided |= not ok
            to.append(c)
            spans.append(pack_intervals(*union(start, end)))
        if rows:
            key, doc, first, count, shift = (np.concatenate([r[1][k] for r in rows]) for k in range(5))
            text = np.concatenate([r[1][5] for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(r[1][0]) for r in rows])
            size = count + depth - 1
            place = np.cumsum(size) - size
            by = np.argsort(key, kind="stable")
            window, whose = [], []
            group = np.append(np.flatnonzero(np.diff(key[by], prepend=~key[by][:1])), len(by))
            low = 0
            while low < len(by):  # whole anchors, a bounded number of windows at a time
                high = int(group[min(np.searchsorted(group, low + CONTEXTS_AT_ONCE), len(group) - 1)])
                some = by[low:high]
                hit = covered(key[some], doc[some], count[some], shift[some], text[ragged(place[some], size[some])], depth)
                window.append(ragged(first[some], count[some])[hit])
                whose.append(np.repeat(own[some], count[some])[hit])
                low = high
            window, whose = np.concatenate(window), np.concatenate(whose)
            order = np.argsort(whose, kind="stable")
            window, whose = window[order], whose[order]
            for x in np.split(np.arange(len(whose)), np.flatnonzero(np.diff(whose)) + 1):
                if len(x):
                    to.append(rows[whose[x[0]]][0])
                    spans.append(pack_intervals(*union(window[x], window[x] + depth)))
        give_back()
        return pa.table({"chunk": pa.array(to, pa.int64()), "spans": pa.array(spans, pa.binary()), "collided": pa.array(np.full(len(to), collided))})

    asked = occurring_elsewhere(chunks, keys_of, bits).join(copies, "chunk", "left")
    hashes = asked.mapInArrow(send_hashes, "chunk long, part long, data binary, more binary")
    states = hashes.groupBy("part").applyInArrow(compare, "chunk long, state struct<part: long, bits: binary, holders: binary>")
    states = states.groupBy("chunk").agg(F.collect_list("state").alias("states"))
    sent = asked.join(states, "chunk", "left").mapInArrow(send, "chunk long, part long, data binary")
    return sent.groupBy("part").applyInArrow(judge, "chunk long, spans binary, collided boolean")


def remove_covered_bytes(docs: DataFrame, depth: int = 50, with_text: bool = True, hash_bits: int = 64) -> DataFrame:
    """Remove each byte of the UTF-8 texts covered by a ``depth``-byte string that also starts in a document with a
    smaller doc_id. Overlaps count; strings are judged on the input; matches never cross documents.

    Returns the other columns of ``docs``, n_bytes, n_removed, n_spans (maximal removed runs), kept_text (the
    remaining bytes as text, halves of cut characters left out; null unless ``with_text``) and kept_sha256 (of the
    remaining bytes). Columns of ``docs`` named like a result give way to it. A null text is empty. A null doc_id counts as larger
    than any other; rows of equal doc_id, repeated rows among them, take nothing from each other. Every removed byte has
    been compared with an equal one; ``hash_bits`` only sets how often comparisons are in vain.
    """

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, row in each_chunk(batches):
            edge = np.zeros(len(s.buf) + 1, dtype=np.int32)
            for data in row["spans"] or []:
                start, end = unpack_intervals(data)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = s.off[:-1][s.off[:-1] < len(s.buf)]
            begins[inner] = gone[inner]
            total = np.concatenate([[0], np.cumsum(gone)])[s.off]
            spans = np.concatenate([[0], np.cumsum(begins)])[s.off]
            kept = s.buf[~gone].tobytes()
            off = (s.off - total).tolist()
            parts = [kept[a:b] for a, b in zip(off[:-1], off[1:])]
            rows = rows_with(s, {
                "n_bytes": pa.array(np.diff(s.off), pa.int64()),
                "n_removed": pa.array(np.diff(total), pa.int64()),
                "n_spans": pa.array(np.diff(spans), pa.int64()),
                "kept_text": pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string()) if with_text else pa.nulls(len(s), pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
            })

            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([pack_bytes(sink.getvalue().to_pybytes())], pa.binary()), pa.array([bool(row["collided"])])], ["data", "collided"])

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield from pa.ipc.open_stream(unpack_bytes(data.as_py()))
        give_back()

    chunks = chunk_documents(docs)
    bits = key_bits(chunks, 1 / 18)
    seed = 0
    while True:
        spans = covered_spans(chunks, depth, bits, seed, min(64, hash_bits << seed))
        spans = spans.groupBy("chunk").agg(F.collect_list("spans").alias("spans"), F.max("collided").alias("collided"))
        done = cut(chunks.join(spans, "chunk", "left").mapInArrow(finish, "data binary, collided boolean"))
        if done.filter("collided").isEmpty():
            return done.select("data").mapInArrow(unpack, with_columns(docs.schema, "text", RESULT))
        seed += 1  # a comparison betrayed a collision: all anew
