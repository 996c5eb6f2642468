"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by documents. A shard lists, for each of its terms, the positions of its tokens, in order; it is
stored compressed, as one row. A search takes a bounded block of benchmark phrases to every shard, starts from the
postings of each phrase's rarest term in the corpus, and intersects the lists, shifted by the terms' offsets, one term
after the other from rare to common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LOWER, U64, WORDLIKE, Slice, lanes_of, ragged, slices, string_hashes, word_bounds
from .chunks import pack_bytes, rows_with, unpack_bytes, with_columns
from .scratch import cut

INDEX = "shard long, words binary, terms binary, counts binary, positions binary, ends binary, text binary, rows binary"
RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("n_near", T.LongType())]
#: Benchmark items, and bytes of their texts, that one search takes to the shards.
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 5_000, 8 << 20


@dataclass
class Words:
    """Words of some texts: the lower-cased bytes, where each begins and ends in them, and the words before each text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return string_hashes(lanes_of(self.buf), self.start, self.end)


def words_of(buf: np.ndarray, off: np.ndarray) -> Words:
    low = LOWER[buf]
    return Words(low, *word_bounds(low, off, WORDLIKE))


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of ``a`` is word j of ``b``, letter by letter."""
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    k = np.flatnonzero(same)
    letters = a.buf[ragged(a.start[i[k]], size[k])] == b.buf[ragged(b.start[j[k]], size[k])]
    if len(k):
        same[k] = np.logical_and.reduceat(letters, np.cumsum(size[k]) - size[k])
    return same


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of every token of ``docs``, one row per shard, written to the checkpoint folder; other columns travel along."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for s in slices(batches):
            words = words_of(s.buf, s.off)
            h, bounds = words.hashes(), words.bounds
            by = np.argsort(h, kind="stable")
            terms, count = np.unique(h[by], return_counts=True)
            first = np.cumsum(count) - count
            step = np.diff(by, prepend=0)
            step[first] = by[first]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, s.rows.schema) as out:
                out.write_batch(s.rows)
            blobs = [np.diff(bounds).astype("<i8").tobytes(), terms.astype("<u8").tobytes(), count.astype("<i4").tobytes(), step.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), s.off.astype("<i8").tobytes(), s.buf.tobytes(), sink.getvalue().to_pybytes()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([pack_bytes(b)], pa.binary()) for b in blobs)], INDEX.replace(" binary", "").replace(" long", "").split(", "))
            shard += 1

    return cut(docs.mapInArrow(run, INDEX))


@dataclass
class Shard:
    bounds: np.ndarray  # words before each document
    terms: np.ndarray  # sorted hashes
    count: np.ndarray
    first: np.ndarray  # of each term in positions
    positions: np.ndarray

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the shard lacks it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, word, "right") - 1


def open_shard(row: dict) -> Shard:
    words = np.frombuffer(unpack_bytes(row["words"]), "<i8")
    terms = np.frombuffer(unpack_bytes(row["terms"]), "<u8")
    count = np.frombuffer(unpack_bytes(row["counts"]), "<i4").astype(np.int64)
    planes = np.frombuffer(unpack_bytes(row["positions"]), np.uint8).reshape(4, -1)
    step = np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)
    first = np.cumsum(count) - count
    total = np.cumsum(step)
    before = np.where(first > 0, total[first - 1], 0) if len(first) else first
    return Shard(np.concatenate([[0], np.cumsum(words)]), terms, count, first, total - np.repeat(before, count))


@dataclass
class Phrases:
    """Phrases of up to ``width`` terms; terms[i, k] for k below size[i], item[i] the number of its item, first[i] the first
    of its words in ``words``."""

    terms: np.ndarray
    size: np.ndarray
    item: np.ndarray
    first: np.ndarray
    words: Words
    order: np.ndarray | None = None  # of the terms of each phrase, rare ones first


def phrases_of(texts: list[str | None], width: int) -> Phrases:
    """All runs of ``width`` words of each text; a shorter text that has words is one phrase."""
    data = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    found = words_of(np.frombuffer(b"".join(data), np.uint8), off)
    h, words = found.hashes(), np.diff(found.bounds)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = ragged(found.bounds[:-1], n)
    size = np.repeat(np.minimum(words, width), n)
    at = first[:, None] + np.minimum(np.arange(width), size[:, None] - 1)
    return Phrases(h[at] if len(h) else np.zeros((0, width), U64), size, np.repeat(np.arange(len(texts)), n), first, found)


def rank_terms(index: DataFrame, phrases: Phrases) -> Phrases:
    """Order the terms of each phrase by their number of postings in the corpus."""
    wanted = np.unique(phrases.terms)
    known = index.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                t, c = np.frombuffer(unpack_bytes(terms.as_py()), "<u8"), np.frombuffer(unpack_bytes(counts.as_py()), "<i4")
                if len(t):
                    at = np.minimum(np.searchsorted(t, known.value), len(t) - 1)
                    total += np.where(t[at] == known.value, c[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    found = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    total = np.zeros(len(wanted), dtype=np.int64)
    for term, n in found:  # at most the block's vocabulary
        total[term] = n
    weight = total[np.searchsorted(wanted, phrases.terms)].astype(np.float64) if len(wanted) else np.zeros(phrases.terms.shape)
    weight[np.arange(phrases.terms.shape[1])[None, :] >= phrases.size[:, None]] = np.inf
    phrases.order = np.argsort(weight, axis=1, kind="stable")
    return phrases


def exact_matches(shard: Shard, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word) of every occurrence."""
    term = shard.find(p.terms)
    alive = np.flatnonzero((term >= 0).all(axis=1))
    if not len(alive):
        return alive, alive
    at = np.empty(len(shard.positions), dtype=np.int64)
    at[shard.positions] = np.repeat(np.arange(len(shard.terms)), shard.count)
    offset = p.order[alive, 0]
    lead = term[alive, offset]
    n = shard.count[lead]
    phrase = np.repeat(alive, n)
    word = shard.positions[ragged(shard.first[lead], n)] - np.repeat(offset, n)
    doc = shard.document(word + np.repeat(offset, n))
    ok = (word >= shard.bounds[doc]) & (word + p.size[phrase] <= shard.bounds[doc + 1])
    phrase, word = phrase[ok], word[ok]
    for k in range(1, p.terms.shape[1]):
        offset = p.order[phrase, k]
        real = k < p.size[phrase]
        ok = ~real | (at[np.where(real, word + offset, 0)] == term[phrase, offset])
        phrase, word = phrase[ok], word[ok]
    return phrase, word


def verified(row: dict, p: Phrases, phrase: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the matches whose words are the phrase's letter by letter; equal hashes alone prove nothing."""
    if not len(phrase):
        return phrase, word
    text = np.frombuffer(unpack_bytes(row["text"]), np.uint8)
    here = words_of(text, np.frombuffer(unpack_bytes(row["ends"]), "<i8"))
    size = p.size[phrase]
    same = same_words(here, ragged(word, size), p.words, ragged(p.first[phrase], size))
    ok = np.logical_and.reduceat(same, np.cumsum(size) - size)
    return phrase[ok], word[ok]


def near_matches(shard: Shard, p: Phrases, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word) of each posting of a phrase's rarest term with every other term at most ``within`` words away in
    the same document, in any order."""
    term = shard.find(p.terms)
    alive = np.flatnonzero((term >= 0).all(axis=1))
    if not len(alive):
        return alive, alive
    lead = term[alive, p.order[alive, 0]]
    n = shard.count[lead]
    phrase, word = np.repeat(alive, n), shard.positions[ragged(shard.first[lead], n)]
    span = len(shard.positions) + 1
    flat = np.repeat(np.arange(len(shard.terms)), shard.count) * span + shard.positions
    for k in range(1, p.terms.shape[1]):
        other = term[phrase, p.order[phrase, k]]
        doc = shard.document(word)
        low = np.maximum(word - within, shard.bounds[doc])
        high = np.minimum(word + within, shard.bounds[doc + 1] - 1)
        some = np.searchsorted(flat, other * span + high, "right") > np.searchsorted(flat, other * span + low, "left")
        ok = some | (k >= p.size[phrase])
        phrase, word = phrase[ok], word[ok]
    return phrase, word


MATCHES = "shard long, doc int, word long, size int, item_id string, phrase long, near boolean"


def search(index: DataFrame, benchmark: DataFrame, width: int = 13, within: int | None = None) -> DataFrame:
    """Matches of the phrases of ``benchmark(item_id, text)``: shard, doc (number in the shard), word (in the shard),
    size, item_id, phrase, near. Exact phrases, verified letter by letter (near is false); with ``within`` also proximity
    matches around each phrase's rarest term (near is true), whose words are equal when their 64-bit hashes are.

    Items are taken to the shards in blocks of bounded number and size. Null texts have no words; a null item_id is ''.
    """
    spark = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-size // ITEM_BYTES_AT_ONCE))
    found = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        p = rank_terms(index, phrases_of([r.text for r in rows], width))
        block = spark.sparkContext.broadcast((p, np.array([r.item_id for r in rows], dtype=object)))

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            p, names = block.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                    shard = open_shard(row)
                    for near in (False,) if within is None else (False, True):
                        phrase, word = near_matches(shard, p, within) if near else verified(row, p, *exact_matches(shard, p))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(word), row["shard"]), pa.int64()), pa.array(shard.document(word), pa.int32()), pa.array(word, pa.int64()), pa.array(p.size[phrase], pa.int32()), pa.array(names[p.item[phrase]], pa.string()), pa.array(phrase, pa.int64()), pa.array(np.full(len(word), near))],
                            ["shard", "doc", "word", "size", "item_id", "phrase", "near"],
                        )

        part = index.select("shard", "words", "terms", "counts", "positions", "ends", "text").mapInArrow(run, MATCHES)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, within: int | None = 26, with_text: bool = False) -> DataFrame:
    """Score every row of ``docs`` against ``benchmark``: the other columns, n_words, n_hit (words inside any occurrence
    of a benchmark window), n_items, items_sha256 (sorted item ids, comma-joined), contaminated (n_hit > 0 and
    ``share`` * n_hit >= n_words), and n_near: items with a window all of whose words lie, in any order, at most ``within``
    words from its rarest one (0 where ``within`` is None: not looked for). An input column of such a name gives way; the
    column text comes back, from the index, only ``with_text`` (an empty one for null).

    Texts are lower-cased; words are runs of a-z, 0-9 and non-ASCII characters. A window is ``width`` successive words of
    an item, or the whole of a shorter one. Null texts have no words. Every match behind n_hit and n_items is compared
    letter by letter; n_near rests on 64-bit hashes of words.
    """
    index = build_index(docs)
    exact, of = ~F.col("near"), F.struct("doc", "item_id")
    matches = search(index, benchmark, width, within).groupBy("shard").agg(
        F.collect_set(F.when(exact, F.struct("doc", "word", "size"))).alias("hits"), F.collect_set(F.when(exact, of)).alias("items"), F.collect_set(F.when(F.col("near"), of)).alias("nears")
    )  # bounded by the words and items of one shard

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(unpack_bytes(row["words"]), "<i8"))])
                edge = np.zeros(bounds[-1] + 1, dtype=np.int64)
                for h in row["hits"] or []:
                    edge[h["word"]] += 1
                    edge[h["word"] + h["size"]] -= 1
                hit = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[bounds])
                names: dict[int, list[str]] = {}
                for x in row["items"] or []:
                    names.setdefault(x["doc"], []).append(x["item_id"])
                near = np.bincount([x["doc"] for x in row["nears"] or []], minlength=len(bounds) - 1)
                table = pa.ipc.open_stream(unpack_bytes(row["rows"])).read_all().combine_chunks().to_batches()
                rest = table[0] if table else pa.RecordBatch.from_pylist([])
                n = np.diff(bounds)
                some = [names.get(k, []) for k in range(len(n))]
                texts = {}
                if with_text:
                    ends = pa.py_buffer(unpack_bytes(row["ends"]))
                    texts["text"] = pa.LargeStringArray.from_buffers(len(n), ends, pa.py_buffer(unpack_bytes(row["text"]))).cast(pa.string())
                yield rows_with(Slice(None, bounds, None, rest), texts | {
                    "n_words": pa.array(n, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "n_items": pa.array([len(x) for x in some], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in some], pa.string()),
                    "contaminated": pa.array((hit > 0) & (share * hit >= n)),
                    "n_near": pa.array(near, pa.int64()),
                })

    kept = ["shard", "words", "rows", *(("ends", "text") if with_text else ())]
    result = [T.StructField("text", T.StringType())] * with_text + RESULT
    return index.select(*kept).join(matches, "shard", "left").mapInArrow(finish, with_columns(docs.schema, "text", result))
