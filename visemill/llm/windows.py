"""Substring dedup over words: Rabin-Karp hashes of every window of fixed length, counted over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytetext import NOT_SPACE, Slice, join_words, lanes_of, mix, string_hashes, window_sums, word_bounds
from .chunks import chunk_documents, each_chunk, key_bits, occurring_elsewhere, rows_with, shared_flags, with_columns

RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]


#: Set on words before they are hashed a second time.
SECOND = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(s: Slice, width: int) -> tuple[tuple, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Word bounds, the first word of each window that lies in one document, the window's hash, and a function that gives
    a second hash, independent of it, of chosen windows."""
    words = start, end, bounds = word_bounds(s.buf, s.off, NOT_SPACE)
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    word = string_hashes(lanes_of(s.buf), start, end)
    return words, first, mix(window_sums(word, width)[first]), lambda chosen: mix(window_sums(mix(word ^ SECOND), width)[first[chosen]] ^ SECOND)


def suspects(h: np.ndarray, shared: list[dict] | None, bits: int) -> np.ndarray:
    """The windows whose hash ``h`` comes again, in the chunk or elsewhere."""
    keys, at, count = np.unique(h, return_inverse=True, return_counts=True)
    return np.flatnonzero(((count > 1) | shared_flags(keys, shared, bits))[at])


def remove_repeated_windows(docs: DataFrame, width: int = 35, with_text: bool = True) -> DataFrame:
    """Remove each word that lies in a window of ``width`` words which starts anywhere else too, in any document.

    Returns the other columns of ``docs``, n_words, n_removed, kept_text (kept words joined by one space; null unless
    ``with_text``) and kept_sha256. Windows are judged on the input. A null text has no words; a text of fewer than
    ``width`` words has no window; repeated rows repeat each other. Columns of ``docs`` named like a result give way to it.

    Windows are compared by hashes modulo 2**61 - 1; those that come again are compared once more, among themselves, by a
    second hash with values of its own, and count as equal where both agree. Among n windows some n * n / 2**62 agree in the
    first by chance; that such a window agrees with another in the second too has a chance of one in 2**61 for each of
    those left. Both hashes start from 64-bit hashes of words.
    """
    chunks = chunk_documents(docs)
    bits = key_bits(chunks, 0.17)

    def keys_of(s: Slice, _) -> np.ndarray:
        return np.unique(window_hashes(s, width)[2])

    def second_keys(s: Slice, row: dict) -> np.ndarray:
        _, _, h, second = window_hashes(s, width)
        found = suspects(h, row["shared"], bits)
        return np.unique(second(found)) if len(found) else found.astype(np.uint64)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, row in each_chunk(batches):
            (start, end, bounds), first, h, second = window_hashes(s, width)
            found = suspects(h, row["shared"], bits)
            repeated = first[found[suspects(second(found), row["sure"], bits)]] if len(found) else found
            edge = np.zeros(len(start) + 1, dtype=np.int64)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + width, -1)
            keep = np.cumsum(edge[:-1]) == 0
            doc = np.repeat(np.arange(len(s)), np.diff(bounds))
            text, off, _ = join_words(s.buf, start[keep], end[keep], doc[keep], len(s))
            whole = text.tobytes()
            n_words = np.diff(bounds)
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
            parts = [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield rows_with(s, {
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_words - np.diff(kept), pa.int64()),
                "kept_text": pa.array([p.decode() for p in parts], pa.string()) if with_text else pa.nulls(len(s), pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
            })

    return occurring_elsewhere(occurring_elsewhere(chunks, keys_of, bits), second_keys, bits, "sure").mapInArrow(finish, with_columns(docs.schema, "text", RESULT))
