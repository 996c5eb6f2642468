"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node has a context tree over the bytes before it, whose nodes hold
counts of zeros and ones. A node's weighted probability is half its Krichevsky-Trofimov estimate and half the product of
its children's, so the prediction mixes the estimates of all depths, each with its posterior weight.

Spark counts the distinct grams (context and next byte) of bounded blocks of text, merges them by their contexts, builds the
subtrees below the last two bytes side by side, and sends every block the log-probabilities of its own grams. What
passes through the driver are the nodes of depth one, at most 256 * 255.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LOWER, NOT_SPACE, U64, Slice, join_words, lanes_of, mix, string_hashes, word_bounds
from .chunks import chunk_documents, each_chunk, key_bits, pack_bytes, pack_keys, rows_with, split_by_part, unpack_bytes, unpack_keys, with_columns
from .scratch import cut

EDGE = 0xFF  # not a byte of UTF-8: stands before and after every text
HALF = math.log(0.5)
RESULT = [
    T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_text_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType()),
]
GRAM, WORD = 0, 1
#: Chunks to a block: about this many megabytes of text.
BLOCK_BITS = 4


def held_out_rows(s: Slice) -> np.ndarray:
    ids = s.rows.column("doc_id").to_pylist()
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], dtype=bool)


def words_of(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space, offset of each text in them, word hashes, words before each text."""
    low = LOWER[s.buf]
    start, end, bounds = word_bounds(low, s.off, NOT_SPACE)
    doc = np.repeat(np.arange(len(s)), np.diff(bounds))
    text, off, _ = join_words(low, start, end, doc, len(s))
    return text, off, string_hashes(lanes_of(low), start, end), bounds


#: Grams that are made at once.
GRAMS_AT_ONCE = 2 << 20


def grams_of(text: np.ndarray, off: np.ndarray, depth: int) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """The gram at each predicted byte (the closing edge included), in blocks, and the number of grams before each text.

    From the highest byte on: the last context byte, the one before it, ... and the predicted byte.
    """
    n = np.diff(off)
    begin = off[:-1] + np.arange(len(n)) * (depth + 1) + depth  # of each text in a line with edges around it
    line = np.full(len(text) + len(n) * (depth + 1), EDGE, dtype=np.uint8)
    for i in range(len(n)) if len(n) == 1 else ():
        line[begin[i] : begin[i] + n[i]] = text
    if len(n) > 1:
        line[np.repeat(begin - off[:-1], n) + np.arange(len(text))] = text
    before = off + np.arange(len(off))

    def blocks() -> Iterator[np.ndarray]:
        for first in range(0, int(before[-1]), GRAMS_AT_ONCE):
            place = np.arange(first, min(first + GRAMS_AT_ONCE, int(before[-1])))
            own = np.searchsorted(before, place, "right") - 1
            at = place - before[own] + begin[own]
            key = line[at].astype(U64)
            for k in range(1, depth + 1):
                key |= line[at - k].astype(U64) << U64(8 * (depth + 1 - k))
            yield key

    return blocks(), before


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - math.log(math.pi) - _lgamma_one(zeros + ones)


_tables: dict[str, np.ndarray] = {}


def _steps(name: str, top: int, first: float, shift: float) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) <= top:
        n = np.arange(max(top + 1, 4096), dtype=np.float64)
        have = _tables[name] = np.concatenate([[first], first + np.cumsum(np.log(n + shift))])
    return have


def _stirling(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2): a table for small counts, Stirling's series beyond."""
    table = _steps("half", 4096, 0.5 * math.log(math.pi), 0.5)
    return np.where(n < 4096, table[np.minimum(n, 4096)], _stirling(np.maximum(n, 1) + 0.5))


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1)."""
    table = _steps("one", 4096, 0.0, 1.0)
    return np.where(n < 4096, table[np.minimum(n, 4096)], _stirling(np.maximum(n, 1) + 1.0))


class Level:
    """Decision nodes of one context depth: index by (context, node), counts, weighted log-probability."""

    def __init__(self, zeros, ones, below: np.ndarray | None):
        self.zeros, self.ones = zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.weighted, self.share = own, np.ones(len(own))
        else:
            self.weighted = np.logaddexp(HALF + own, HALF + below)
            self.share = np.exp(HALF + own - self.weighted)

    def estimate(self, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        a, b = self.zeros[node], self.ones[node]
        return (np.where(bit == 1, b, a) + 0.5) / (a + b + 1.0)


def subtree(key: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[np.ndarray, Level, np.ndarray]:
    """For sorted grams that share their last ``top`` context bytes: the probability of each of a gram's eight decisions
    by the subtree (nan where training never came to its root), the root's level, and its node numbers."""
    bit = ((key[:, None] >> U64(7) - np.arange(8, dtype=U64)) & U64(1)).astype(np.int64).ravel()
    prefix = ((U64(1) << np.arange(8, dtype=U64)) | ((key[:, None] & U64(0xFF)) >> (U64(8) - np.arange(8, dtype=U64)))).astype(np.int64).ravel()
    count = np.repeat(n, 8)
    levels, index = [], []
    child_of: np.ndarray | None = None
    for d in range(depth, top - 1, -1):
        context = key >> U64(8 * (depth + 1 - d))
        number = np.cumsum(np.concatenate([[0], (context[1:] != context[:-1]).astype(np.int64)]))
        name = np.repeat(number, 8) * 256 + prefix
        nodes, at = np.unique(name, return_inverse=True)
        if child_of is None:
            zeros = np.bincount(at, weights=count * (bit == 0), minlength=len(nodes)).astype(np.int64)
            ones = np.bincount(at, weights=count * (bit == 1), minlength=len(nodes)).astype(np.int64)
            level = Level(zeros, ones, None)
        else:
            parent = np.empty(len(levels[-1].zeros), dtype=np.int64)
            parent[index[-1]] = at
            add = lambda v: np.bincount(parent, weights=v, minlength=len(nodes))
            level = Level(add(levels[-1].zeros).astype(np.int64), add(levels[-1].ones).astype(np.int64), add(levels[-1].weighted))
        child_of = at
        levels.append(level)
        index.append(at)
    p = np.full(len(bit), np.nan)
    for level, at in zip(levels, index):
        p = mixed(level, at, bit, p)
    return p.reshape(-1, 8), levels[-1], nodes & 255


def mixed(level: Level, at: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The weighted mixture at a node. Depths that training never came to carry no weight."""
    own = level.estimate(at, bit)
    share = level.share[at]
    seen = level.zeros[at] + level.ones[at] > 0
    return np.where(seen, np.where(np.isnan(below), own, share * own + (1 - share) * below), np.nan)


def _whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Slice]]]:
    from itertools import groupby

    for block, chunks in groupby(each_chunk(batches), key=lambda c: c[0] >> BLOCK_BITS):
        yield block, (s for _, s, _ in chunks)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and summed counts."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, U64)
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]) if parts else None, minlength=len(keys)).astype(np.int64)


def _tally(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=trained, minlength=len(keys)).astype(np.int64)


def score_documents(docs: DataFrame, depth: int = 6) -> DataFrame:
    """Score every row of ``docs``: its other columns, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_text_bytes and bits_per_byte.

    Rows with crc32(doc_id as text) mod 5 equal to 1 are held out; all others train. A text is lower-cased (A-Z), its
    words are joined by one space, and a closing edge is predicted after it; ``score`` is the log10 probability of all
    these bytes given ``depth`` bytes of context at most. base_score is the smoothed unigram score of its words and one
    end. A null text is empty and scores its end alone; a null doc_id trains. Repeated rows count as often as they occur.
    Columns of ``docs`` named like a result give way to it.
    """
    if not 2 < depth <= 7:
        raise ValueError("depth must be 3 to 7")
    chunks = chunk_documents(docs)
    bits = key_bits(chunks, 0.07)

    def part_of(gram: np.ndarray) -> np.ndarray:
        """Grams after the same four bytes are of one part, so that they compress well beside each other."""
        return (mix(gram >> U64(8 * max(depth - 3, 0))) >> U64(64 - bits)).astype(np.int64)

    def request_rows(kind: int, block: int, parts: np.ndarray, keys: pa.Array, counts: pa.Array) -> Iterator[pa.RecordBatch]:
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(parts, pa.int64()), pa.array(np.full(n, block), pa.int64()), keys, counts, pa.array(np.zeros(n), pa.int64())], ["kind", "part", "block", "keys", "counts", "ends"])

    def request(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, slices in _whole_blocks(batches):
            grams, words, ends = [], [], 0
            for s in slices:
                train = ~held_out_rows(s)
                ends += int(train.sum())
                text, off, word, bounds = words_of(s)
                blocks, at = grams_of(text, off, depth)
                trained, done = np.repeat(train, np.diff(at)), 0
                for key in blocks:
                    grams.append(_tally(key, trained[done : done + len(key)]))
                    done += len(key)
                words.append(_tally(word, np.repeat(train, np.diff(bounds))))
            keys, count = _distinct(grams)
            sent = _packed("part", keys, part_of(keys), count.astype("<i4"), "counts")
            yield from request_rows(GRAM, block, sent.column("part").to_numpy(), sent.column("grams").combine_chunks(), sent.column("counts").combine_chunks())
            keys, count = _distinct(words)
            parts, border = split_by_part(keys, bits)
            pairs = list(zip(border[:-1], border[1:]))
            yield from request_rows(WORD, block, parts, pa.array([pack_keys(keys[a:b], bits) for a, b in pairs], pa.binary()), pa.array([pack_bytes(count[a:b].astype("<i4").tobytes()) for a, b in pairs], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([block], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["kind", "part", "block", "keys", "counts", "ends"])

    requests = cut(chunks.mapInArrow(request, "kind int, part long, block long, keys binary, counts binary, ends long"))
    asked = requests.filter("kind >= 0").select("kind", "part", "block", "keys", "counts")

    def opened(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        part = table.column("part")[0].as_py()
        return [unpack_keys(k.as_py(), part, bits) for k in table.column("keys")], [np.frombuffer(unpack_bytes(c.as_py()), "<i4") for c in table.column("counts")]

    def merge(table: pa.Table) -> pa.Table:
        gram, count = _distinct([(_unpack_grams(k.as_py()), np.frombuffer(unpack_bytes(c.as_py()), "<i4")) for k, c in zip(table.column("keys"), table.column("counts"))])
        return _packed("last", gram, (gram >> U64(8 * (depth - 1))).astype(np.int64), count.astype("<i8"), "n")

    grams = asked.filter(f"kind = {GRAM}").groupBy("part").applyInArrow(merge, "last long, grams binary, n binary")

    def grow(table: pa.Table) -> pa.Table:
        key = np.concatenate([_unpack_grams(x.as_py()) for x in table.column("grams")])
        n = np.concatenate([np.frombuffer(unpack_bytes(x.as_py()), "<i8") for x in table.column("n")])
        by = np.argsort(key)
        key, n = key[by], n[by]
        p, root, node = subtree(key, n, depth)
        told = _packed("part", key, part_of(key), p.astype("<f4"), "p")
        up = pa.table({
            "c1": pa.array(np.full(len(node), int(key[0] >> U64(8 * depth)) & 255), pa.int32()),
            "node": pa.array(node, pa.int32()),
            "zeros": pa.array(root.zeros),
            "ones": pa.array(root.ones),
            "weighted": pa.array(root.weighted),
        })
        return pa.concat_tables([told, up], promote_options="default").select(["part", "grams", "p", "c1", "node", "zeros", "ones", "weighted"])

    grown = cut(grams.groupBy("last").applyInArrow(grow, "part long, grams binary, p binary, c1 int, node int, zeros long, ones long, weighted double"))
    near = grown.filter("node is not null").groupBy("c1", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()
    top = docs.sparkSession.sparkContext.broadcast(top_levels(near))

    def finish(key: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte."""
        one, zero = top.value
        c1 = (key >> U64(8 * depth)).astype(np.int64) & 255
        total = np.zeros(len(key))
        for j in range(8):
            bit = ((key >> U64(7 - j)) & U64(1)).astype(np.int64)
            node = (1 << j) | ((key & U64(0xFF)) >> U64(8 - j)).astype(np.int64)
            q = mixed(one, c1 * 256 + node, bit, p[:, j])
            q = mixed(zero, node, bit, q)
            total += np.log10(np.where(np.isnan(q), 0.5, q))
        return total

    def answer_grams(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        found = [(_unpack_grams(g.as_py()), np.frombuffer(unpack_bytes(p.as_py()), "<f4").reshape(8, -1).T) for g, p in zip(known.column("grams"), known.column("p"))]
        gram = np.concatenate([key for key, _ in found])
        value = np.concatenate([finish(key, p.astype(np.float64)).astype("<f4") for key, p in _few(found)])
        by = np.argsort(gram)
        gram, value = gram[by], value[by]
        return _answers(asked, GRAM, [_planes(value[np.searchsorted(gram, _unpack_grams(k.as_py()))]) for k in asked.column("keys")])

    told = grown.filter("node is null").select("part", "grams", "p")
    to_grams = asked.filter(f"kind = {GRAM}").select("part", "block", "keys").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer_grams, ANSWER)

    def answer_words(table: pa.Table) -> pa.Table:
        keys, counts = opened(table)
        distinct, count = _distinct(list(zip(keys, counts)))
        data = [pack_bytes(count[np.searchsorted(distinct, k)].astype("<i8").tobytes()) for k in keys]
        out = _answers(table, WORD, data)
        stats = pa.table({"block": pa.array([-1], pa.int64()), "kind": pa.array([int((count > 0).sum())], pa.int32()), "part": pa.array([int(count.sum())], pa.int64()), "data": pa.array([b""], pa.binary())})
        return pa.concat_tables([out, stats])

    to_words = cut(asked.filter(f"kind = {WORD}").groupBy("part").applyInArrow(answer_words, ANSWER))
    vocabulary, tokens = to_words.filter("block = -1").agg(F.sum("kind"), F.sum("part")).first()
    ends = requests.filter("kind = -1").agg(F.sum("ends")).first()[0] or 0
    vocabulary, tokens = (vocabulary or 0) + (ends > 0), (tokens or 0) + ends
    denominator = tokens + 0.5 * (vocabulary + 1)

    def score(chunk_rows: pa.Table, answers: pa.Table) -> pa.Table:
        replies: dict[int, list[tuple[int, bytes]]] = {GRAM: [], WORD: []}
        for kind, part, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "data"))):
            replies[kind].append((part, data))
        slices = [s for _, s, _ in each_chunk(chunk_rows.drop_columns(["block"]).sort_by("chunk").to_batches())]
        prepared, gram_keys, word_keys = [], [], []
        for s in slices:
            text, off, word, bounds = words_of(s)
            blocks, at = grams_of(text, off, depth)
            kinds = [np.unique(key, return_inverse=True) for key in blocks]
            kinds = [(key, back.astype(np.int32)) for key, back in kinds]
            word, word_back = np.unique(word, return_inverse=True)
            prepared.append((s, off, kinds, at, word, word_back.astype(np.int32), bounds))
            gram_keys += [key for key, _ in kinds]
            word_keys.append(word)
        keys = np.unique(np.concatenate(gram_keys))
        value = np.zeros(len(keys), "<f4")
        value[np.argsort(part_of(keys), kind="stable")] = np.concatenate([_from_planes(d, "<f4") for _, d in sorted(replies[GRAM])] or [value])
        values = {GRAM: (keys, value)}
        data = [np.frombuffer(unpack_bytes(d), "<i8") for _, d in sorted(replies[WORD])]
        values[WORD] = np.unique(np.concatenate(word_keys)), np.concatenate(data) if data else np.zeros(0, "<i8")
        out = []
        for s, off, kinds, at, word, word_back, bounds in prepared:
            keys, value = values[GRAM]
            total, done = np.zeros(len(s)), 0
            for key, back in kinds:  # a text may go on in the next block
                each = value[np.searchsorted(keys, key)].astype(np.float64)[back]
                first = np.searchsorted(at, done, "right") - 1
                last = np.searchsorted(at, done + len(back), "left")
                total[first:last] += np.add.reduceat(each, np.maximum(at[first:last] - done, 0))
                done += len(back)
            keys, count = values[WORD]
            c = count[np.searchsorted(keys, word)][word_back] if len(word) else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(np.log10((c + 0.5) / denominator))])[bounds]
            known = np.concatenate([[0], np.cumsum(c > 0)])[bounds]
            n_bytes = np.diff(off)
            out.append(rows_with(s, {
                "held_out": pa.array(held_out_rows(s)),
                "n_tokens": pa.array(np.diff(bounds) + 1, pa.int64()),
                "n_known": pa.array(np.diff(known) + int(ends > 0), pa.int64()),
                "train_tokens": pa.array(np.full(len(s), tokens), pa.int64()),
                "base_score": pa.array(np.diff(sums) + math.log10((ends + 0.5) / denominator), pa.float64()),
                "score": pa.array(total, pa.float64()),
                "n_text_bytes": pa.array(n_bytes, pa.int64()),
                "bits_per_byte": pa.array(-total * math.log2(10) / (n_bytes + 1), pa.float64()),
            }))
        return pa.Table.from_batches(out)

    answers = to_grams.unionByName(to_words.filter("block >= 0"))
    blocks = chunks.withColumn("block", F.shiftright("chunk", BLOCK_BITS))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, with_columns(docs.schema, "text", RESULT))


ANSWER = "block long, kind int, part long, data binary"


def _answers(asked: pa.Table, kind: int, data: list[bytes]) -> pa.Table:
    return pa.table({"block": asked.column("block"), "kind": pa.array(np.full(len(data), kind), pa.int32()), "part": asked.column("part"), "data": pa.array(data, pa.binary())})


def _packed(name: str, grams: np.ndarray, group: np.ndarray, values: np.ndarray, value: str) -> pa.Table:
    """A row for each of the groups (column ``name``) of the sorted grams: their differences and values, compressed."""
    by = np.argsort(group, kind="stable")
    grams, group, values = grams[by], group[by], values[by]
    border = np.flatnonzero(np.diff(group, prepend=-1))
    pairs = list(zip(border, np.append(border[1:], len(group))))
    return pa.table({
        name: pa.array(group[border], pa.int64()),
        "grams": pa.array([_planes(np.diff(grams[a:b], prepend=U64(0)).astype("<u8")) for a, b in pairs], pa.binary()),
        value: pa.array([pack_bytes(np.ascontiguousarray(values[a:b].T).tobytes()) for a, b in pairs], pa.binary()),
    })


def _planes(values: np.ndarray) -> bytes:
    """Compressed: the first bytes of all values, then the second ones, ..."""
    return pack_bytes(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(unpack_bytes(data) if data else b"", np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, "<u8"), dtype=U64)


def _few(found: list[tuple[np.ndarray, np.ndarray]], at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same grams and decisions, in order, small arrays joined until they hold ``at_once`` grams."""
    held, n = [], 0
    for one in found:
        held.append(one)
        n += len(one[0])
        if n >= at_once:
            yield np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held])
            held, n = [], 0
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held])


def top_levels(rows: list) -> tuple[Level, Level]:
    """The levels of depth one and zero from the summed children of depth one (at most 256 * 255 rows)."""
    zeros, ones, below = np.zeros(256 * 256, np.int64), np.zeros(256 * 256, np.int64), np.zeros(256 * 256)
    for c1, node, a, b, w in rows:
        zeros[c1 * 256 + node], ones[c1 * 256 + node], below[c1 * 256 + node] = a, b, w
    one = Level(zeros, ones, below)
    by_node = lambda v: v.reshape(256, 256).sum(axis=0)
    return one, Level(by_node(zeros), by_node(ones), by_node(one.weighted))
