"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every text; a bounded sample of labelled rows trains the trees; the trees, flattened
into arrays, are walked for whole Arrow batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import NOT_SPACE, U64, Slice, lanes_of, mix, slices, string_hashes, word_bounds
from .scratch import cut

_b = np.arange(256)
CLASSES = {
    "upper": (_b >= 65) & (_b <= 90),
    "lower": (_b >= 97) & (_b <= 122),
    "digit": (_b >= 48) & (_b <= 57),
    "space": (_b == 32),
    "newline": (_b == 10),
    "comma_stop": (_b == 44) | (_b == 46),
    "strong_stop": (_b == 33) | (_b == 63),
    "bar": (_b == 124),
    "symbol": np.isin(_b, list(b"#$%&*@^~=+")),
    "bracket": np.isin(_b, list(b"<>[]{}()")),
    "quote": np.isin(_b, list(b"\"'`")),
    "colon_slash": np.isin(_b, list(b":/\\_-;")),
    "wide": _b >= 128,
}
FEATURES = [
    "log_bytes", "log_words", *(f"share_{k}" for k in CLASSES), "word_length", "word_length_spread", "long_words", "short_words",
    "capitalised", "distinct_words", "top_word", "repeated_next", "lines_per_word", "distinct_lines", "symbol_words", "byte_entropy",
]


#: Texts, and bytes of them, whose bytes are counted at once.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 2_000, 1 << 20


def byte_shares(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Share of each class among the bytes of each text, and the entropy of its bytes; zero for an empty one."""
    n, size = len(s), np.diff(s.off)
    masks = np.stack(list(CLASSES.values()), axis=1).astype(np.float64)
    shares, entropy = np.zeros((n, len(CLASSES))), np.zeros(n)
    first = 0
    while first < n:
        last = int(min(max(first + 1, np.searchsorted(s.off, s.off[first] + BYTES_AT_ONCE, "right") - 1), first + TEXTS_AT_ONCE, n))
        count = np.zeros(256 * (last - first), dtype=np.int64)
        whole = int(s.off[last])
        step = BYTES_AT_ONCE if last == first + 1 else max(whole, 1)  # a text alone may be long
        for a in range(int(s.off[first]), whole, step):
            b = min(a + step, whole)
            owner = np.repeat(np.arange(last - first), size[first:last]) if last > first + 1 else 0
            count += np.bincount(owner * 256 + s.buf[a:b].astype(np.int64), minlength=len(count))
        p = count.reshape(-1, 256) / np.maximum(size[first:last], 1)[:, None]
        shares[first:last] = p @ masks
        entropy[first:last] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        first = last
    return shares, entropy


def statistics(s: Slice) -> np.ndarray:
    """Features of each text (rows), all zero for one without words."""
    n = len(s)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return np.diff(total[at])

    size = np.diff(s.off)
    shares, entropy = byte_shares(s)
    start, end, bounds = word_bounds(s.buf, s.off, NOT_SPACE)
    words = np.diff(bounds)
    w = np.maximum(words, 1)
    length = (end - start).astype(np.float64)
    mean = per_doc(length, bounds) / w
    spread = np.sqrt(np.maximum(per_doc(length**2, bounds) / w - mean**2, 0))
    first = s.buf[start]
    lanes = lanes_of(s.buf)
    h = string_hashes(lanes, start, end)
    doc = np.repeat(np.arange(n), words)
    follow = np.zeros(len(h))
    follow[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    _, one, times = np.unique(h ^ mix(doc.astype(U64) + U64(1)), return_index=True, return_counts=True)
    distinct = np.bincount(doc[one], minlength=n) / w
    top = np.zeros(n)
    np.maximum.at(top, doc[one], times)
    alpha = (CLASSES["upper"] | CLASSES["lower"] | CLASSES["wide"])[s.buf]
    letters = np.concatenate([[0], np.cumsum(alpha, dtype=np.int32)])
    bare = letters[end] - letters[start] < 0.5 * (end - start)
    line = np.ones(256, dtype=bool)
    line[10] = False
    ls, le, lb = word_bounds(s.buf, s.off, line)
    lines = np.diff(lb)
    ld = np.repeat(np.arange(n), lines)
    lh = string_hashes(lanes, ls, le) ^ mix(ld.astype(U64) + U64(1))
    _, lone = np.unique(lh, return_index=True)
    columns = [
        np.log1p(size), np.log1p(words), *shares.T, mean, spread, per_doc(length > 12, bounds) / w, per_doc(length <= 2, bounds) / w,
        per_doc(CLASSES["upper"][first], bounds) / w, distinct, top / w, per_doc(follow, bounds) / w, lines / w,
        np.bincount(ld[lone], minlength=n) / np.maximum(lines, 1), per_doc(bare, bounds) / w, entropy,
    ]
    out = np.stack(columns, axis=1).astype(np.float32)
    out[words == 0] = 0
    return out


# ---------------------------------------------------------------- trees
@dataclass
class Forest:
    """Trees as arrays: node i asks ``feature[i] <= threshold[i]`` and goes to ``left[i]`` or ``right[i]``; leaves point to
    themselves. ``root`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if len(self.root):
            node = np.broadcast_to(self.root, (len(x), len(self.root)))
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Forest:
    """Boost regression trees on the logistic loss, splits found on histograms of ``bins`` quantile bins."""
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) if len(x) else np.zeros(0, np.float32) for k in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, n_features), np.int64)
    flat = binned + np.arange(n_features) * bins
    margin = np.full(len(y), base)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int, g=g, h=h) -> int:
                me = len(nodes)
                nodes.append([0, 0.0, me, me, 0.0])
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                if level < depth and len(rows) >= 2 * least:
                    at = flat[rows].ravel()
                    hist = [np.bincount(at, weights=np.repeat(v[rows], n_features) if v is not None else None, minlength=bins * n_features).reshape(n_features, bins).cumsum(axis=1) for v in (g, h, None)]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                    k, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[k, b] > 1e-6 and b < len(edges[k]):
                        goes = binned[rows, k] <= b
                        left = grow(rows[goes], level + 1)
                        right = grow(rows[~goes], level + 1)
                        nodes[me] = [int(k), float(edges[k][b]), left, right, 0.0]
                        return me
                value = -rate * sum_g / (sum_h + ridge)
                nodes[me][4] = value
                margin[rows] += value
                return me

            roots.append(grow(np.arange(len(y)), 0))
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1].astype(np.float32), a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, dtype=np.int64), depth, base)


# ---------------------------------------------------------------- the job
SCORES = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``stats``, the features of the text as packed floats."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            x = statistics(s)
            yield pa.RecordBatch.from_arrays([*s.rows.columns, pa.array([r.tobytes() for r in x], pa.binary())], [*s.rows.schema.names, "stats"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("stats", T.BinaryType())])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def usable_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y) of about ``sample`` labels at most that are not held out, chosen by a hash of doc_id. Null labels and ids
    are left out; repeated labels all count."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("y"))
    n = usable.count()
    if n > sample:  # a hash takes a share a little under the bound, so that no task sends more than its part
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(950_000 * sample / n))
    return usable


def fit(stats: DataFrame, usable: DataFrame, sample: int = 20_000, **options) -> Forest:
    """Train on the labelled rows of ``stats(doc_id, stats)``; ``sample`` bounds what reaches the driver."""
    rows = stats.select("doc_id", "stats").join(usable, "doc_id").limit(sample).select("doc_id", "stats", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, bytes(r.stats)))
    x = np.frombuffer(b"".join(bytes(r.stats) for r in rows), dtype=np.float32).reshape(-1, len(FEATURES))
    return train(x, np.array([r.y for r in rows], dtype=np.float64), **options)


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Forest:
    """Train on the labelled rows of ``docs``; statistics are taken of these alone."""
    usable = usable_labels(labels, sample)
    some = docs.select("doc_id", "text").join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
    return fit(with_statistics(some, ["doc_id"]), usable, sample)


def score(stats: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """``stats`` with score and predicted (1 from ``threshold`` on) in place of the packed features."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    names = [c for c in stats.columns if c not in ("stats", "score", "predicted")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("stats").to_pylist()), dtype=np.float32).reshape(-1, len(FEATURES))
            p = np.concatenate([shared.value.score(x[i : i + 2000]) for i in range(0, len(x), 2000)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return stats.mapInArrow(run, T.StructType([stats.schema[n] for n in names] + SCORES))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    A null text counts as empty; texts without words have all statistics zero and are scored like others. A null doc_id
    is not held out. With no usable labels, or of one kind only, every text gets the share of ones (smoothed). Labels,
    language, source and id are no inputs of a score.
    """
    stats = cut(with_statistics(docs, ["doc_id"]))
    return score(stats, fit(stats, usable_labels(labels, sample), sample), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
