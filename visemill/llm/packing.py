"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Packing depends on lengths only, and a length is one of ``capacity`` values. So the tasks count lengths, the driver
packs the counts (at most ``capacity`` numbers at any corpus size) into a plan of ranges, and the tasks look up the
place of each piece by its rank within its length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LOWER, ragged, slices
from .scratch import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows that one task ranks within a length; longer runs of one length are dealt to more tasks.
RANKED_AT_ONCE = 50_000
#: Parts whose ids a Python worker remembers, and bytes of them.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16 << 20
#: Lower case, and plain spaces for the white space of ASCII text.
PLAIN = np.where(np.isin(np.arange(256), [0x09, 0x0A, 0x0D]), 0x20, LOWER).astype(np.uint8)
_ASCII = np.arange(256) < 0x80
LETTER = (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)
#: Bytes of ASCII signs and digits; none of them joins a letter before it.
SIGN = _ASCII & ~LETTER & (np.arange(256) > 0x20)
#: Parts that the tokenizer takes as one run of letters.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


class WordEncoder:
    """Token ids of whole texts, encoding each distinct part of them once.

    The tokenizer lower-cases, drops white space and never joins tokens across it, nor across a letter followed by an
    ASCII sign or digit. So texts are cut at both, and a text's ids are those of its parts in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_padding()
        self.model.no_truncation()
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # number of each part
        self.ids = np.zeros(0, dtype=np.uint32)  # of all parts, by number
        self.begin = np.zeros(1, dtype=np.int64)  # of each part in ids
        self.used = np.zeros(0, dtype=np.int64)  # when last
        self.n_bytes = self.now = 0

    def _keep_recent(self) -> None:
        """Forget the half of the parts that was not used for longest."""
        keep = np.flatnonzero(self.used > np.median(self.used))
        names = list(self.known)
        size = np.diff(self.begin)[keep]
        ids = self.ids[ragged(self.begin[keep], size)]
        now, used = self.now, self.used[keep]
        self._forget()
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, self.begin, self.used, self.now = ids, np.concatenate([[0], np.cumsum(size)]), used, now
        self.n_bytes = sum(map(len, self.known))

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts back to back, and the number of each part's."""
        size = np.empty(len(parts), dtype=np.int64)
        plain = [i for i, w in enumerate(parts) if LETTERS.fullmatch(w)]
        blocks = [plain[first : first + 512] for first in range(0, len(plain), 512)]
        alone = []
        found: list[tuple[list[int], np.ndarray]] = []
        for block, e in zip(blocks, self.model.encode_batch_fast([" ".join([parts[i] for i in b]) for b in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(block):
                size[block] = np.diff(ends, prepend=0)
                found.append((block, ids))
            else:  # not one closing token a part: take them singly
                alone += block
        plain_ = set(plain)
        alone += [i for i in range(len(parts)) if i not in plain_]
        if alone:
            each = [e.ids for e in self.model.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)]
            size[alone] = [len(x) for x in each]
            found.append((alone, np.fromiter((i for x in each for i in x), dtype=np.uint32)))
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        for block, ids in found:
            out[ragged(begin[block], size[block])] = ids
        return out, size

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part, learning those that are new."""
        if len(self.known) > REMEMBERED or self.n_bytes > REMEMBERED_BYTES:
            self._keep_recent()
        self.now += 1
        number = np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        new = np.flatnonzero(number < 0)
        if len(new):
            words = list(dict.fromkeys([parts[i] for i in new.tolist()]))
            ids, size = self._encode_parts(words)
            first = len(self.known)
            self.known.update(zip(words, range(first, first + len(words))))
            number[new] = [self.known[parts[i]] for i in new.tolist()]
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(words), dtype=np.int64)])
            self.n_bytes += sum(map(len, words))
        self.used[number] = self.now
        return number

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 texts ``buf[off[i]:off[i + 1]]``, and the offset of each text's."""
        texts = PLAIN[buf]
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(off), dtype=np.int64)
        solid = texts != 0x20
        head = np.zeros(len(texts), dtype=bool)
        head[1:] = solid[1:] & ~solid[:-1]
        letter = LETTER[texts]
        # letters of Latin-1 in two bytes, the signs for times and division left out
        two = np.zeros(len(texts), dtype=bool)
        two[1:] = (texts[:-1] == 0xC3) & (texts[1:] >= 0x80) & (texts[1:] != 0x97) & (texts[1:] != 0xB7)
        head[1:] |= SIGN[texts[1:]] & (letter | two)[:-1]
        head[off[:-1][off[:-1] < len(texts)]] = True
        start = np.flatnonzero(head)
        del solid, head, letter, two
        parts = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(texts)).astype(np.int32)), pa.py_buffer(texts)).dictionary_encode()
        number = self._numbers([w.rstrip(" ") for w in parts.dictionary.to_numpy(zero_copy_only=False)])
        number = number[parts.indices.to_numpy()]
        n = (self.begin[number + 1] - self.begin[number]).astype(np.int32)
        after = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        take = np.repeat((self.begin[number] - after[:-1]).astype(np.int32), n)
        take += np.arange(after[-1], dtype=np.int32)
        return self.ids[take], after[np.searchsorted(start, off)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The Python worker's own encoder: what it remembers serves its later tasks too."""
    return WordEncoder(path)


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A text's ids are closed by ``end_id``; only texts of
    more than ``capacity`` ids are cut. A null or empty text is the closing id alone; a null doc_id stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for s in slices(batches, target=2 << 20):
            ids, off = encoder.encode(s.buf, s.off)
            n = np.diff(off) + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(s)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            raw = ids.astype("<u4").tobytes()
            close = int(end_id).to_bytes(4, "little")
            crc = np.empty(len(doc), dtype=np.int64)
            low = (off[doc] + start).tolist()
            top = (np.minimum(start + length, n[doc] - 1) + off[doc]).tolist()
            last = (start + length == n[doc]).tolist()
            for i in range(len(doc)):
                c = zlib.crc32(raw[4 * low[i] : 4 * top[i]])
                crc[i] = zlib.crc32(close, c) if last[i] else c
            yield pa.RecordBatch.from_arrays(
                [s.rows.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Run:
    """``count`` sequences from number ``first`` on, alike, each with ``room`` tokens free."""

    first: int
    count: int
    room: int


@dataclass
class Plan:
    """Row i: pieces of ``length`` with ranks from ``rank`` on lie ``per`` to a sequence from ``sequence`` on, the first at ``offset``."""

    length: list[int]
    rank: list[int]
    sequence: list[int]
    per: list[int]
    offset: list[int]
    n_sequences: int = 0
    fixed: int = 0  # sequences that the reduction fixed


def dominating_sets(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, int | None, int]]:
    """Martello-Toth reduction: (longest piece j, its partner or None, number of such sequences) of sets that dominate
    every other set with j. ``counts`` is left with the rest.

    With the room r that j leaves: if nothing fits into r, j is alone in some best packing; if a piece of exactly r
    exists, or no two pieces fit together into r, or at most two do and no fitting pair weighs more than the longest
    fitting piece, then j with that longest piece dominates all other sets that hold j, whatever they hold. Lengths are
    tried from long to short, those without a dominating set passed over, and again until nothing changes.
    """
    lengths = sorted(counts)
    changed = True
    while changed:
        changed = False
        for j in reversed(lengths.copy()):
            while j in counts:
                best, n = _dominating(j, lengths, counts, capacity)
                if not n:
                    break
                for k, less in ((j, n), (best, n)):
                    if k is not None:
                        counts[k] -= less
                        if not counts[k]:
                            del counts[k]
                            del lengths[bisect_left(lengths, k)]
                changed = True
                yield j, best, n


def _dominating(j: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int | None, int]:
    """The partner with which j dominates, or None, and how often that set can be taken (0: no set dominates)."""
    room = capacity - j
    alone = counts[j] == 1  # then j is no partner of itself
    top = bisect_right(lengths, room)
    if top and alone and lengths[top - 1] == j:
        top -= 1
    low = [k for k in lengths[: min(3, top)] if not (alone and k == j)]
    if not top or not low:
        return None, counts[j]
    best = lengths[top - 1]
    if best != room:
        smallest = low[0]
        two = 2 * smallest if counts[smallest] - (smallest == j) >= 2 else smallest + low[1] if len(low) > 1 else room + 1
        if two <= room and (3 * smallest <= room or _heaviest_pair(lengths[:top], counts, room, j) > best):
            return None, 0  # other sets may hold j to better effect
    return best, counts[j] // 2 if best == j else min(counts[j], counts[best])


def pack_counts(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts[length]`` pieces of each length. Bounded by the number of lengths, not of pieces.

    Sets that dominate are fixed first, all their copies at once. What is left is packed best-fit, longest first, the
    fixed sequences' room included.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    plan = Plan([], [], [], [], [])
    used: dict[int, int] = dict.fromkeys(left, 0)

    def note(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        plan.length.append(length)
        plan.rank.append(used[length])
        plan.sequence.append(sequence)
        plan.per.append(per)
        plan.offset.append(offset)
        used[length] += count

    def place(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        note(length, count, sequence, per, offset)
        left[length] -= count
        if not left[length]:
            del left[length]

    free: dict[int, list[Run]] = {}
    for j, best, n in dominating_sets(left, capacity):
        if best == j:
            note(j, 2 * n, plan.n_sequences, 2, 0)
        else:
            note(j, n, plan.n_sequences, 1, 0)
            if best is not None:
                note(best, n, plan.n_sequences, 1, j)
        room = capacity - j - (best or 0)
        if room:
            free.setdefault(room, []).append(Run(plan.n_sequences, n, room))
        plan.n_sequences += n
    plan.fixed = plan.n_sequences
    for length in sorted(left, reverse=True):
        while length in left:
            n = left[length]
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                per = capacity // length
                whole, rest = divmod(n, per)
                for count, k in ((whole, per), (1 if rest else 0, rest)):
                    if count:
                        place(length, count * k, plan.n_sequences, k, 0)
                        if capacity - k * length:
                            free.setdefault(capacity - k * length, []).append(Run(plan.n_sequences, count, capacity - k * length))
                        plan.n_sequences += count
                continue
            run = free[room].pop()
            if not free[room]:
                del free[room]
            per = room // length
            whole, rest = divmod(n, per)
            if whole >= run.count:
                whole, rest = run.count, 0
            at = run.first
            for count, k in ((whole, per), (1 if rest else 0, rest)):
                if count:
                    place(length, count * k, at, k, capacity - room)
                    if room - k * length:
                        free.setdefault(room - k * length, []).append(Run(at, count, room - k * length))
                    at += count
            if run.first + run.count > at:
                free.setdefault(room, []).append(Run(at, run.first + run.count - at, room))
    return plan


def _heaviest_pair(fits: list[int], left: dict[int, int], room: int, j: int) -> int:
    """Weight of the heaviest two other pieces that fit together into ``room`` (0: none)."""
    best, high = 0, len(fits) - 1
    for low, a in enumerate(fits):
        while high >= 0 and a + fits[high] > room:
            high -= 1
        if high < low:
            break
        for b in range(high, low - 1, -1):
            if b != low or left[a] - (a == j) >= 2:
                best = max(best, a + fits[b])
                break
    return best


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (column ``length``, 1 to ``capacity``).

    Pieces of a length are ranked in buckets of bounded size, dealt by a hash of ``order``, so that a length which very
    many pieces share is not one task's. Rows alike in all of ``order`` are told apart by their rank alone.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = pack_counts(counts, capacity)
    most = max(counts.values(), default=0)
    buckets = max(1, -(-most // RANKED_AT_ONCE))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.coalesce("_before", F.lit(0)))

    key = np.array(plan.length, dtype=np.int64)
    rank = np.array(plan.rank, dtype=np.int64)
    by = np.lexsort((rank, key))
    bound = spark.sparkContext.broadcast([x[by] for x in (key, rank, np.array(plan.sequence, dtype=np.int64), np.array(plan.per, dtype=np.int64), np.array(plan.offset, dtype=np.int64))])
    names = pieces.columns
    fields = [f for f in pieces.schema.fields] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, sequence, per, offset = bound.value
        first = np.searchsorted(key, np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.empty(len(r), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, cuts):
                k = int(length[group[0]])
                at[group] = first[k] + np.searchsorted(rank[first[k] : first[k + 1]], r[group], "right") - 1
            i = r - rank[at]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(sequence[at] + i // per[at]), pa.array(offset[at] + (i % per[at]) * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, T.StructType(fields))
