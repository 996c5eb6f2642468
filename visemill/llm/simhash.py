"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some word lies within r bits of both. So every fingerprint stands
for all words of its ball of radius r, and words that two balls share link them. The shuffle is by a few bits of those
words: a fingerprint goes once to each bucket that any word of its ball falls into, and the task that owns the bucket
spells out the words of the ball that belong there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, U64, give_back, join_words, slices, word_bounds
from .components import EDGE, connected_components, forest
from .scratch import cut

LANES = U64(0x0001000100010001)
#: Ball words that a task holds at once, and aims at for a bucket.
WORDS_AT_ONCE = 4_000_000


def fingerprints(batches: Iterable[pa.RecordBatch], width: int = 4, seed: int = 42) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The other columns and the 64-bit fingerprint of each text. No words (or null): zero. Under ``width`` words: the
    whole sequence is the only shingle. Repeated shingles count as often as they occur."""
    for s in slices(batches):
        start, end, bounds = word_bounds(s.buf, s.off, NOT_SPACE)
        n_words = np.diff(bounds)
        doc = np.repeat(np.arange(len(s)), n_words)
        joined, _, at = join_words(LOWER[s.buf], start, end, doc, len(s))
        stop = at + (end - start)
        n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        last = np.minimum(first + width, np.repeat(bounds[1:], n)) - 1
        text, digest = joined.tobytes(), xxhash.xxh64_digest
        h = np.frombuffer(b"".join([digest(text[a:b], seed) for a, b in zip(at[first].tolist(), stop[last].tolist())]), dtype=">u8").astype(U64)
        prints = np.zeros(len(s), dtype=U64)
        if len(h):
            cut_at = np.unique(np.concatenate([(np.cumsum(n) - n)[n > 0], np.arange(0, len(h), 60_000)]))  # a 16-bit lane can't overflow
            owner = np.searchsorted(np.cumsum(n), cut_at, "right")
            ones = np.zeros((len(s), 64), dtype=np.int64)
            for i in range(16):
                lane = np.add.reduceat((h >> U64(i)) & LANES, cut_at)
                for k in range(4):
                    np.add.at(ones[:, 16 * k + i], owner, ((lane >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64))
            bit = (2 * ones > n[:, None]).astype(U64)
            prints = (bit << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
        yield s.rows, prints


def masks(bits: list[int], most: int) -> np.ndarray:
    """All words with at most ``most`` of ``bits`` set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], dtype=U64)


def ball_links(word: np.ndarray, left: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose balls share a word. Position i's ball: ``word[i]`` with up to ``left[i]`` of the bits
    ``free`` flipped. Each shared word links its holders to the first; repeats are left out."""
    origin = np.arange(len(word))
    found: list[np.ndarray] = []
    most = int(left.max(initial=0))
    weigh = np.array([len(masks(free, k)) for k in range(most + 1)])

    def walk(word, left, origin, free):
        if len(word) < 2:
            return
        if weigh[left].sum() > WORDS_AT_ONCE and len(free) > 8:
            b, rest = free[0], free[1:]
            for value in (0, 1):
                same = (word >> U64(b)) & U64(1) == U64(value)
                turn = ~same & (left > 0)
                walk(np.concatenate([word[same], word[turn] ^ U64(1 << b)]), np.concatenate([left[same], left[turn] - 1]), np.concatenate([origin[same], origin[turn]]), rest)
            return
        ball, own = [], []
        for k in range(most + 1):
            if (at := left == k).any():
                m = masks(free, k)
                ball.append((word[at][:, None] ^ m[None, :]).ravel())
                own.append(np.repeat(origin[at], len(m)))
        ball, own = np.concatenate(ball), np.concatenate(own)
        by = np.argsort(ball)
        ball, own = ball[by], own[by]
        equal = np.flatnonzero(ball[1:] == ball[:-1])
        if len(equal):
            pair = np.stack([own[equal], own[equal + 1]])
            pair.sort(axis=0)
            found.append(np.unique(pair, axis=1))

    walk(word, left, origin, free)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(found, axis=1), axis=1)
    return pair[0], pair[1]


def route(word: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket): the buckets, numbered by the values of ``bits``, into which words of each ball fall."""
    m = masks(bits, radius)
    moved = (word[:, None] ^ m[None, :]).ravel()
    bucket = np.zeros(len(moved), dtype=np.int64)
    for i, b in enumerate(bits):
        bucket |= ((moved >> U64(b)) & U64(1)).astype(np.int64) << i
    return np.repeat(np.arange(len(word)), len(m)), bucket


def link_fingerprints(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (src, dst) that connect the distinct fingerprints (column ``print``, signed 64-bit) which differ in at most
    ``distance`` bits. Not all such pairs come out, but every such pair is connected by them. ``distance`` must be even."""
    radius = distance // 2
    if distance % 2 or radius < 1:
        raise ValueError("distance must be even and positive")
    spread = [F.avg(F.shiftright(F.col("print"), b).bitwiseAND(F.lit(1))) for b in range(64)]
    n, *share = prints.agg(F.count("*"), *spread).first()
    balanced = sorted(range(64), key=lambda b: abs((share[b] or 0) - 0.5))
    ball = len(masks(list(range(64)), radius))
    n_bits = max(4, min(24, int(np.ceil(np.log2(max(1, n * ball / WORDS_AT_ONCE))))))
    bits = balanced[:n_bits]
    free = balanced[n_bits:]

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                word = batch.column(0).slice(first, 20_000).to_numpy().view(U64)
                at, bucket = route(word, bits, radius)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(word[at].view(np.int64))], ["bucket", "print"])

    def link(table: pa.Table) -> pa.Table:
        word = table.column("print").to_numpy().view(U64)
        value, at = U64(0), int(table.column("bucket")[0].as_py())
        there = word.copy()
        for i, b in enumerate(bits):
            value = U64((at >> i) & 1)
            there = (there & ~U64(1 << b)) | (value << U64(b))
        left = radius - np.bitwise_count(word ^ there).astype(np.int64)
        a, b = ball_links(there, left, free)
        near = np.bitwise_count(word[a] ^ word[b]) <= distance
        src, dst = forest(word[a][near].view(np.int64), word[b][near].view(np.int64))
        give_back()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return prints.select("print").mapInArrow(send, "bucket long, print long").groupBy("bucket").applyInArrow(link, EDGE)


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``distance`` bits are linked; component_id is the smallest doc_id reachable over
    links, itself included. Null and empty texts have fingerprint zero, linked like any other. A null doc_id gets the
    component's smallest id (null if the component has none). Repeated rows are returned as often as they occur.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, prints in fingerprints(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    marked = cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long"))
    kinds = cut(marked.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected_components(link_fingerprints(kinds, distance)).select(F.col("node").alias("print"), "root")
    kinds = kinds.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = kinds.groupBy("root").agg(F.min("least").alias("component_id"))
    kinds = kinds.select("print", "root").join(least, "root").select("print", "component_id")
    return marked.join(kinds, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
