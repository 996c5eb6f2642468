"""Scores: error rates, thresholds, ROC and EER, selection credit, offsets, contrasts, summaries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import global_cumsum, grouped_percentiles


# ---------------------------------------------------------------- error rates
def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


#: Letters of a sequence in a word of a bit vector, and words of tables that are kept at once.
WORD, TABLE = 64, 1 << 21


def _columns(a: np.ndarray, n: np.ndarray, b: np.ndarray, steps: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For a batch of pairs (a row of ``a``, its length ``n`` and a row of ``b`` each), for each prefix of ``b`` but the empty one: where the
    best alignment with a prefix of ``a`` may end with both last letters, where with the one of ``a`` alone, and the whole edit distance.

    Myers' bit vectors, in Hyyro's form: bit i of the words of a pair stands for the prefix of i + 1 letters. All pairs
    advance together, all of ``a`` end in the last word (or are empty, which has no distance here).
    """
    size, words = len(a), max(1, -(-a.shape[1] // WORD))
    row, most = np.arange(size), int(max(a.max(initial=0), b.max(initial=0))) + 1
    if size * (most + 1) * words <= TABLE:
        code, heard = a, np.where(b < 0, most, b)
    else:  # a number within the pair for each distinct letter
        known, code = np.unique((row[:, None] * (most + 1) + a + 1).ravel(), return_inverse=True)
        owner, wanted = known // (most + 1), row[:, None] * (most + 1) + b + 1
        first = np.searchsorted(owner, row)[:, None]
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        most = int(np.bincount(owner, minlength=1).max(initial=0))
        code = code.reshape(a.shape) - first
        heard = np.where(known[at] == wanted, at - first, most) if len(known) else np.full(b.shape, most)
    # where each letter stands; letters of b alone stand nowhere
    places, own = np.zeros((words, size * (most + 1)), dtype=np.uint64), row * (most + 1)
    for i in range(a.shape[1]):
        places[i // WORD, own + np.where(i < n, code[:, i], most)] |= np.uint64(1 << i % WORD)
    places[:, own + most] = 0
    one, top = np.uint64(1), np.uint64(WORD - 1)
    up, down = np.full((words, size), ~np.uint64(0)), np.zeros((words, size), dtype=np.uint64)
    cost, bit = n.astype(np.int64), (np.maximum(n - 1, 0) % WORD).astype(np.uint64)
    for heard_now in np.ascontiguousarray(heard.T):
        where = own + heard_now
        both, alone = (np.empty_like(up), np.empty_like(up)) if steps else (None, None)
        carry, rise_in, fall_in = np.uint64(0), one, np.uint64(0)
        for w in range(words):
            same, u, d = places[w][where], up[w], down[w]
            x = same & u
            total = x + u + carry
            if w + 1 < words:
                carry = ((x & u) | ((x | u) & ~total)) >> top
            level = (total ^ u) | same | d  # the cost equals that of both prefixes without their last letters
            rise, fall = d | ~(level | u), u & level
            if w + 1 == words:
                cost = cost + ((rise >> bit) & one).astype(np.int64) - ((fall >> bit) & one).astype(np.int64)
            rise_out, fall_out = rise >> top, fall >> top
            rise, fall = (rise << one) | rise_in, (fall << one) | fall_in
            rise_in, fall_in = rise_out, fall_out
            up[w], down[w] = fall | ~(level | rise), rise & level
            if steps:
                both[w], alone[w] = ~level | same, up[w]
        yield both, alone, cost


def _distances(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Edit distances of the sequences ``a[a_off[k]:a_off[k + 1]]`` and ``b[b_off[k]:b_off[k + 1]]``, by batches of like lengths."""
    n, m = np.diff(a_off), np.diff(b_off)
    out = np.maximum(n, m)
    todo = np.flatnonzero((n > 0) & (m > 0))
    todo = todo[np.lexsort((m[todo], -(-n[todo] // WORD)))]
    first = 0
    while first < len(todo):
        step = max(1, TABLE // int((n[todo[first]] + WORD) * (n[todo[first]] // WORD + 1)))
        part = todo[first : first + step]
        part = part[-(-n[part] // WORD) == -(-n[part[0]] // WORD)]
        (left, right), width = (_padded(x, off, part) for x, off in ((a, a_off), (b, b_off))), m[part]
        for j, (_, _, cost) in enumerate(_columns(left, n[part], right, steps=False), 1):
            out[part[width == j]] = cost[width == j]
        first += len(part)
    return out


def _padded(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sequences of ``rows`` as rows of a table, filled up with -1."""
    size = off[rows + 1] - off[rows]
    at = np.arange(int(size.max(initial=0)))
    there = at < size[:, None]
    return np.where(there, flat[np.where(there, off[rows][:, None] + at, 0)], -1)


def char_distance(ref: str, hyp: str) -> int:
    """Edit distance between the characters of two texts of any length, by Myers' bit vectors in a band around the diagonal.

    A column of the band is one integer. A result within the band's half width is exact; else the band is doubled.
    """
    if ref == hyp or not ref or not hyp:
        return 0 if ref == hyp else len(ref) + len(hyp)
    codes = np.frombuffer(ref.encode("utf-32-le"), dtype=np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    longest = max(len(ref), len(hyp))
    k = max(64, longest // 8, abs(len(ref) - len(hyp)))
    while (edits := banded_distance(places, len(ref), hyp, k)) > k and k < longest:
        k *= 2
    return edits


def banded_distance(places: dict[str, int], n: int, hyp: str, k: int) -> int:
    """Cost of the best alignment of ``hyp`` to n characters at ``places`` that stays k or fewer off the diagonal."""
    width = 2 * k + 1  # bit t is row j - k + t of column j; rows up to 0 stand for nothing
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down, above = ((1 << k) - 1) << (k + 1), 0, 0  # where the column rises and falls by one; the cost over its first row
    for first in range(0, len(hyp), width):
        part = hyp[first : first + width]
        near = {c: (places.get(c, 0) << k >> first) & ((1 << 2 * width) - 1) for c in set(part)}
        for j, c in enumerate(part):
            above += 1 + (up & 1) - (down & 1)
            up, down = up >> 1 | top, down >> 1
            same = near[c] >> j & mask
            across = (((same & up) + up) ^ up) | same
            rise, fall = down | (mask & ~(across | up)), up & across
            rise, same = rise << 1 | 1, same | down
            up, down = (fall << 1 | ~(same | rise)) & mask, rise & same & mask
    rows = (1 << (n - len(hyp) + k + 1)) - 1
    return above + (up & rows).bit_count() - (down & rows).bit_count()


#: Up to this length Spark's own edit distance serves, its banded one up to so many edits; texts up to ``BATCHED`` are compared by batches.
SHORT, FEW, BATCHED = 500, 8, 2000


@F.arrow_udf(T.LongType())
def char_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance of columns of texts: a batch of short ones together, longer ones by ``char_distance``."""
    pairs = list(zip(ref.to_pylist(), hyp.to_pylist()))
    out = np.zeros(len(pairs), dtype=np.int64)
    missing = np.array([r is None or h is None for r, h in pairs], dtype=bool)
    near = np.array([not gone and r != h and max(len(r), len(h)) <= BATCHED for (r, h), gone in zip(pairs, missing)], dtype=bool)
    for k in np.flatnonzero(~missing & ~near):
        out[k] = char_distance(*pairs[k])
    some = np.flatnonzero(near)
    sides = []
    for side in (0, 1):
        texts = [pairs[k][side] for k in some]
        sides += [np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])]
    number = np.zeros(0x110000, dtype=np.int64)  # few letters make small tables
    number[sides[0]] = number[sides[2]] = 1
    number = np.cumsum(number) - 1
    out[some] = _distances(number[sides[0]], sides[1], number[sides[2]], sides[3])
    return pa.array(out, mask=missing)


def edits(ref: Column, hyp: Column, longest: int | None = None) -> Column:
    """Edit distance of two columns. Where the caller says that no text is longer than ``longest`` and that is short, no
    Python is in the plan; else texts that differ go to ``char_edits``, which takes a third of the time or less."""
    if longest is not None and longest <= SHORT:
        return F.when(ref == hyp, 0).otherwise(F.coalesce(F.nullif(F.levenshtein(ref, hyp, FEW), F.lit(-1)), F.levenshtein(ref, hyp))).cast("long")
    differ = ref != hyp
    return F.when(ref == hyp, F.lit(0).cast("long")).otherwise(char_edits(F.when(differ, ref), F.when(differ, hyp)))


def cer(ref: Column, hyp: Column, longest: int | None = None) -> Column:
    """Aggregate: character edits over reference characters, spaces left out; null without reference characters."""
    r, h = without_spaces(ref), without_spaces(hyp)
    return F.sum(edits(r, h, longest)) / F.nullif(F.sum(F.length(r)), F.lit(0))


#: White space between words, as in ``word_count``.
SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


@F.arrow_udf(T.LongType())
def word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance between the words of two texts; a null has none."""
    names: dict[str, int] = {}
    sides = []
    for texts in (ref, hyp):
        words = [[names.setdefault(w, len(names)) for w in SPACES.split(t or "") if w] for t in texts.to_pylist()]
        sides += [np.array([w for row in words for w in row], dtype=np.int64), np.concatenate([[0], np.cumsum([len(row) for row in words], dtype=np.int64)])]
    return pa.array(_distances(*sides))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def wer(ref: Column, hyp: Column) -> Column:
    """Aggregate: word edits over reference words; null without reference words."""
    return F.sum(word_edits(ref, hyp)) / F.nullif(F.sum(word_count(ref)), F.lit(0))


def error_cube(rows: DataFrame, by: list[str], hyps: list[str], ref: str = "ref", longest: int | None = None) -> DataFrame:
    """CER of each hypothesis column over every subset of ``by``; null keys mean all. Columns cer_<hyp>, n, level. ``longest``
    as for ``edits``."""
    # edits once for each row, then a cube over numbers instead of texts
    r = without_spaces(F.col(ref))
    lean = rows.select(*by, F.length(r).alias("_chars"), *[edits(r, without_spaces(F.col(h)), longest).alias(f"_e_{h}") for h in hyps])
    rates = [(F.sum(f"_e_{h}") / F.nullif(F.sum("_chars"), F.lit(0))).alias(f"cer_{h}") for h in hyps]
    return lean.cube(*by).agg(F.count("*").alias("n"), *rates, F.grouping_id().alias("level"))


def training_progress(epochs: DataFrame) -> DataFrame:
    """``epochs(epoch, av, audio)`` with the gain of the lips and whether it is the best epoch, the first of those with the
    lowest error of av."""
    best = epochs.agg(F.min_by("epoch", F.struct("av", "epoch")).alias("_b"))
    return epochs.crossJoin(F.broadcast(best)).withColumn("lips_gain", F.col("audio") - F.col("av")).withColumn("best", F.col("epoch") == F.col("_b")).drop("_b")


def last_train_row(log: DataFrame) -> DataFrame:
    """The newest record of kind ``train`` of a metrics log(time, type, ...); of equal times the one of the highest step."""
    rest = [c for c in log.columns if c not in ("time", "type")]
    return log.filter("type = 'train'").agg(F.max_by(F.struct("time", *rest), F.struct("time", "step")).alias("r")).filter("r is not null").select("r.*")


def compare_modes(scores: DataFrame) -> DataFrame:
    """``scores(mode, snr, cer)`` by SNR: cer of av, audio and video, the gain of av over audio and whether it is one."""
    wide = scores.groupBy("snr").pivot("mode", ["av", "audio", "video"]).agg(F.first("cer"))
    return wide.withColumn("gain", F.col("audio") - F.col("av")).withColumn("av_better", F.col("gain") > 0)


def suggest_threshold(av: DataFrame, video_cer: float | Column) -> DataFrame:
    """(threshold, status) of ``av(snr, cer)``: the highest SNR at which av is worse than video."""
    video = F.lit(video_cer) if not isinstance(video_cer, Column) else video_cer
    found = av.agg(F.max(F.when(F.col("cer") > video, F.col("snr"))).alias("threshold"), F.max("snr").alias("top"))
    status = F.when(F.col("top").isNull(), "no_data").when(F.col("threshold").isNull(), "video_never_better").when(F.col("threshold") == F.col("top"), "video_always_better").otherwise("ok")
    return found.select("threshold", status.alias("status"))


def threshold_in_estimates(levels: DataFrame, threshold: float | None, status: str) -> DataFrame:
    """The switching point in an estimator's units. ``levels(estimator, rank, snr, estimate)``, rank 0 the cleanest:
    midway to the next cleaner level, 2 dB under the noisiest, or 1 dB over the cleanest."""
    w = Window.partitionBy("estimator").orderBy("rank")
    rows = levels.withColumn("cleaner", F.lag("estimate").over(w))
    if status == "ok":
        value = F.max(F.when(F.col("snr") == F.lit(threshold), F.coalesce((F.col("estimate") + F.col("cleaner")) / 2, F.col("estimate"))))
    elif status == "video_never_better":
        value = F.max_by("estimate", "rank") - 2
    elif status == "video_always_better":
        value = F.min_by("estimate", "rank") + 1
    else:
        value = F.lit(None).cast("double")
    complete = F.count("*") == F.count("estimate")
    return rows.groupBy("estimator").agg(F.when(complete, F.round(value, 2)).alias("value"))


def estimate_summary(rows: DataFrame, by: str) -> DataFrame:
    """Medians of the signal's, the model's and the combined SNR estimate, and n."""
    both = F.coalesce((F.col("snr_dsp") + F.col("snr_model")) / 2, F.col("snr_model"))
    kinds = {"dsp": F.col("snr_dsp"), "model": F.col("snr_model"), "hybrid": both}
    long = rows.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("_kind"), c.cast("double").alias("_v")) for k, c in kinds.items()])))
    medians = grouped_percentiles(long, [by, "_kind"], "_v", {"_m": 0.5}).groupBy(by).agg(*[F.max(F.when(F.col("_kind") == k, F.col("_m"))).alias(k) for k in kinds])
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(medians, by, "left").select(by, *kinds, "n")


# ---------------------------------------------------------------- ROC
def roc_points(scores: DataFrame) -> DataFrame:
    """(score, n_pos, n_neg, tp, fp) for each distinct score, highest first: acceptances at that score or more.

    Only one row for each distinct score is ordered, so ties cost nothing and no task sees all scores.
    """
    counts = scores.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("n_pos"), F.sum(1 - F.col("positive").cast("long")).alias("n_neg"))
    return global_cumsum(counts, [F.col("score").desc()], {"n_pos": "tp", "n_neg": "fp"})


def auc_and_eer(scores: DataFrame) -> DataFrame:
    """One row of auc (ties count half), eer, threshold, n_pos, n_neg from ``scores(score, positive)``.

    The equal error rate lies where misses fall to the rate of false alarms, interpolated between operating points; before
    the first point the threshold is that point's score. Null without positives or negatives.
    """
    points = roc_points(scores)
    total = points.agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    points = points.crossJoin(F.broadcast(total)).withColumn("d", 1 - F.try_divide("tp", "P") - F.try_divide("fp", "N"))
    auc = F.try_divide(F.sum(F.col("n_neg") * (F.col("tp") - F.col("n_pos") / 2)), F.first("P") * F.first("N"))
    # the last point above and the first at or below the diagonal, found by two aggregates instead of a sorted window
    above = F.max_by(F.struct("d", "fp", "score"), F.when(F.col("d") > 0, -F.col("score")))
    below = F.max_by(F.struct("d", "fp", "score"), F.when(F.col("d") <= 0, F.col("score")))
    both = points.agg(auc.alias("auc"), above.alias("a"), below.alias("b"), F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    d0, f0 = F.coalesce("a.d", F.lit(1.0)), F.try_divide(F.coalesce("a.fp", F.lit(0)), F.col("n_neg"))
    share = F.try_divide(d0, d0 - F.col("b.d"))
    eer = f0 + share * (F.try_divide("b.fp", "n_neg") - f0)
    threshold = F.when(F.col("a.score").isNull(), F.col("b.score")).otherwise(F.col("a.score") + share * (F.col("b.score") - F.col("a.score")))
    real = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return both.select(*[F.when(real, c).alias(n) for n, c in (("auc", F.col("auc")), ("eer", eer), ("threshold", threshold.cast("double")))], "n_pos", "n_neg")


def grouped_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """AUC of each group by sums over its distinct scores (ties count half).

    Negatives are summed along one global order of groups and scores; what came before a group is taken off again.
    """
    counts = scores.groupBy(*by, "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum(1 - F.col("positive").cast("long")).alias("n"))
    summed = global_cumsum(counts, [*map(F.col, by), F.col("score")], {"n": "_below"}).withColumn("_below", F.col("_below") - F.col("n"))
    won = F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)) - F.min("_below") * F.sum("p")
    return summed.groupBy(*by).agg((won / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def contrast(rows: DataFrame, by: list[str], value: str = "x", positive: str = "positive", least: int = 3) -> DataFrame:
    """Two groups told apart: n and mean of each, Cohen's d with pooled sample variance; null d with too few."""
    yes, no = F.when(F.col(positive), F.col(value)), F.when(~F.col(positive), F.col(value))
    out = rows.groupBy(*by).agg(F.count(yes).alias("n1"), F.count(no).alias("n0"), F.avg(yes).alias("mean1"), F.avg(no).alias("mean0"), F.var_samp(yes).alias("_v1"), F.var_samp(no).alias("_v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0")) / (F.col("n1") + F.col("n0") - 2))
    enough = (F.col("n1") >= least) & (F.col("n0") >= least)
    return out.withColumn("d", F.when(enough, (F.col("mean1") - F.col("mean0")) / F.nullif(pooled, F.lit(0.0)))).drop("_v1", "_v0")


# ---------------------------------------------------------------- selection, offsets, scenes
def selection_credit(candidates: DataFrame, query: list[str]) -> DataFrame:
    """Credit of each query from ``candidates(*query, s, is_true)``: 1 if the true one scores highest, shared among
    ties, else 0; 1 without distractors. The true candidate must be there once."""
    true = F.max(F.when(F.col("is_true"), F.col("s")))
    best = F.max(F.when(~F.col("is_true"), F.col("s")))
    out = candidates.withColumn("_t", F.max(F.when(F.col("is_true"), F.col("s"))).over(Window.partitionBy(*query)))
    ties = F.count_if(~F.col("is_true") & (F.col("s") == F.col("_t")))
    credit = F.when(best.isNull() | (true > best), 1.0).when(true == best, 1.0 / (1 + ties)).otherwise(0.0)
    return out.groupBy(*query).agg(credit.alias("credit"), F.count_if(~F.col("is_true")).alias("distractors"))


def nway_report(candidates: DataFrame, n_values: list[int], groups: list[str]) -> DataFrame:
    """(direction, n_way, group, value, n, n_skipped, acc, chance, all_other) of ``candidates(direction, query, pos, s, kind,
    *groups)``: over all queries (group 'all') and by each column of ``groups``.

    The true candidate has pos 0, distractors follow from 1. Of N candidates the first N - 1 distractors count; queries
    with fewer are skipped. ``all_other`` is the share of queries whose distractors are all of kind 'other_speaker'.
    """
    wide = candidates.withColumn("n_way", F.explode(F.array(*map(F.lit, n_values)))).filter("pos < n_way").withColumn("is_true", F.col("pos") == 0)
    keys = ["direction", "n_way", "query"]
    credit = selection_credit(wide, keys)
    rest = wide.groupBy(*keys).agg(*[F.first(g).alias(g) for g in groups], F.min(F.when(~F.col("is_true"), (F.col("kind") == "other_speaker").cast("int"))).alias("_other"))
    rows = credit.join(rest, keys).withColumn("_ok", F.col("distractors") == F.col("n_way") - 1)
    kinds = F.array(F.struct(F.lit("all").alias("group"), F.lit("").alias("value")), *[F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("value")) for g in groups])
    spread = rows.select("direction", "n_way", "credit", "_ok", "_other", F.inline(kinds))
    return spread.groupBy("direction", "n_way", "group", "value").agg(
        F.count_if("_ok").alias("n"), F.count_if(~F.col("_ok")).alias("n_skipped"), F.avg(F.when(F.col("_ok"), F.col("credit"))).alias("acc"), (1 / F.first("n_way")).alias("chance"), F.avg(F.when(F.col("_ok"), F.col("_other").cast("double"))).alias("all_other")
    )


def offset_predictions(offsets: DataFrame, query: list[str]) -> DataFrame:
    """Offset with the highest score of each query; the smallest of equals."""
    return offsets.groupBy(*query).agg(F.max_by("offset", F.struct("s", -F.col("offset"))).alias("offset"))


def long_enough(windows: DataFrame, reach: int, width: int) -> Column:
    """Whether a window of ``width`` frames from ``start`` of a clip of ``n`` stays inside at all offsets up to ``reach``."""
    return (F.col("start") >= reach) & (F.col("start") + reach + width <= F.col("n"))


def offset_report(predictions: DataFrame, frame_ms: float = 40.0) -> DataFrame:
    """Errors of ``predictions(offset)``; a null offset is a query that was too short to try."""
    err = F.abs("offset")
    return predictions.agg(
        F.count_if(F.col("offset").isNull()).alias("n_skipped_short"),
        F.count("offset").alias("n"), F.avg((err <= 1).cast("double")).alias("acc_pm1"), F.avg((err == 0).cast("double")).alias("acc_exact"), (F.median(err) * frame_ms).alias("median_abs_ms"), (F.avg(err) * frame_ms).alias("mean_abs_ms")
    )


def offset_histogram(predictions: DataFrame, reach: int) -> DataFrame:
    """Counts of every offset from -reach to reach, zeros included."""
    bins = predictions.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("offset"))
    counts = predictions.groupBy("offset").count()
    return bins.join(F.broadcast(counts), "offset", "left").select("offset", F.coalesce("count", F.lit(0)).alias("n"))


def best_assignments(scores: np.ndarray) -> np.ndarray:
    """Streams of the faces of each scene, ``scores`` (scenes, faces, streams), so that the total is highest: all permutations of at most
    a handful, the first of equals."""
    n, k, _ = scores.shape
    top, best = None, np.tile(np.arange(k), (n, 1))
    for p in permutations(range(k)):
        total = np.zeros(n)
        for i, j in enumerate(p):
            total = total + scores[:, i, j]
        top = total if top is None else top
        higher = total > top
        top[higher], best[higher] = total[higher], p
    return best


def best_assignment(scores: np.ndarray) -> np.ndarray:
    """``best_assignments`` of one scene."""
    return best_assignments(np.asarray(scores, dtype=np.float64)[None])[0]


def scene_assignments(scores: DataFrame, scene: list[str]) -> DataFrame:
    """(scene columns, scene_right, stream_share) of ``scores(*scene, face, stream, s)``; faces and streams of a scene are
    numbered 0 to k - 1 and face i belongs with stream i. Scenes hold a few faces each; those of equal size in a batch are assigned together."""
    cells = F.collect_list(F.struct(F.col("face").cast("int").alias("f"), F.col("stream").cast("int").alias("t"), F.coalesce(F.col("s").cast("double"), F.lit(float("nan"))).alias("s")))
    size = F.greatest(F.max("face"), F.max("stream")).cast("int") + 1
    scenes = scores.groupBy(*scene).agg(cells.alias("_c"), size.alias("_k"))
    side = lambda c: F.transform("_c", lambda x: x[c])

    @F.pandas_udf("scene_right boolean, stream_share double")
    def assign(size: pd.Series, face: pd.Series, stream: pd.Series, score: pd.Series) -> pd.DataFrame:
        k, share = size.to_numpy(), np.zeros(len(size))
        for n in np.unique(k).tolist():
            at = np.flatnonzero(k == n)
            row = np.repeat(np.arange(len(at)), [len(score.iat[i]) for i in at])
            m = np.full((len(at), n, n), -1e9)
            m[row, *(np.concatenate([c.iat[i] for i in at]) for c in (face, stream))] = np.concatenate([score.iat[i] for i in at])
            share[at] = (best_assignments(m) == np.arange(n)).mean(axis=1)
        return pd.DataFrame({"scene_right": share == 1.0, "stream_share": share})

    return scenes.select(*scene, assign("_k", side("f"), side("t"), side("s")).alias("_a")).select(*scene, "_a.*")


def scene_report(scores: DataFrame, by: list[str], unit: list[str]) -> DataFrame:
    """n, scene_acc and stream_acc of the assignments of each unit (a scene, or one of its windows), by variant."""
    return scene_assignments(scores, [*by, *unit]).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("scene_right").cast("double")).alias("scene_acc"), F.avg("stream_share").alias("stream_acc"))


def offscreen(scores: DataFrame, stream: list[str], threshold: float) -> DataFrame:
    """The best face of each stream, or null (off screen) where none reaches ``threshold``; the smallest of equals."""
    out = scores.groupBy(*stream).agg(F.max(F.struct("s", (-F.col("face")).alias("f"))).alias("b"))
    return out.select(*stream, F.when(F.col("b.s") >= threshold, -F.col("b.f")).alias("face"), F.col("b.s").alias("s"))


# ---------------------------------------------------------------- sequences
PAIRS = T.ArrayType(T.StructType([T.StructField("ref", T.IntegerType()), T.StructField("hyp", T.IntegerType())]))
#: Cells of a table of steps that are kept at once.
CELLS = 1 << 20
#: Last step into a cell: both sequences, the reference alone (a deletion), the hypothesis alone (an insertion).
BOTH, REF, HYP = 0, 1, 2


def _steps(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For a batch of pairs (a row of ``a`` and of ``b`` each), for each prefix of ``a`` from the empty one on, the last steps of its best alignments
    with all prefixes of ``b``, in the order of preference."""
    place = np.arange(b.shape[1] + 1)
    cost = np.repeat(place[None], len(a), axis=0)
    paired = np.full(cost.shape, a.shape[1] + b.shape[1] + 1)
    yield np.full(cost.shape, HYP, dtype=np.int8)
    for x in a.T:
        paired[:, 1:] = cost[:, :-1] + (b != x[:, None])
        single = cost + 1
        cost = np.minimum.accumulate(np.minimum(paired, single) - place, axis=1) + place  # insertions follow on from the left
        yield np.where(paired == cost, BOTH, np.where(single == cost, REF, HYP)).astype(np.int8)


def _short_ways(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """The steps of the preferred alignment of each pair of a batch: of row k the first n[k] and m[k] letters."""
    table = [(both, alone) for both, alone, _ in _columns(a, n, b)]
    size, words = len(a), max(1, -(-a.shape[1] // WORD))
    both, alone = (np.stack([c[k] for c in table]) if table else np.zeros((1, words, size), dtype=np.uint64) for k in (0, 1))
    i, j = n.copy(), m.copy()
    out, at = np.full((size, int((n + m).max(initial=0))), -1, dtype=np.int8), np.arange(size)
    length = np.zeros(size, dtype=np.int64)
    for k in range(out.shape[1]):
        at = at[(i[at] > 0) | (j[at] > 0)]
        x, y = np.maximum(i[at] - 1, 0), np.maximum(j[at] - 1, 0)
        word, bit = x // WORD, (x % WORD).astype(np.uint64)
        inside = (i[at] > 0) & (j[at] > 0)
        joint = inside & ((both[y, word, at] >> bit) & np.uint64(1) > 0)
        single = (j[at] == 0) | (inside & ((alone[y, word, at] >> bit) & np.uint64(1) > 0))
        step = np.where(joint, BOTH, np.where(single, REF, HYP)).astype(np.int8)
        out[at, k] = step
        i[at] -= step != HYP
        j[at] -= step != REF
        length[at] += 1
    return [row[:z][::-1] for row, z in zip(out, length.tolist())]


def _way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The steps of the preferred alignment of one long pair, in memory as long as ``b``.

    Each cell below the middle of ``a`` knows in which column its way back meets the middle, so the halves on both sides of
    that crossing are aligned alone; the way through the whole table is the way through both.
    """
    if len(a) <= 1 or len(a) * (len(b) + 1) <= CELLS:
        return _short_ways(a[None], np.array([len(a)]), b[None], np.array([len(b)]))[0]
    middle = len(a) // 2
    crossing = place = np.arange(len(b) + 1)
    for i, [step] in enumerate(_steps(a[None], b[None])):
        if i > middle:
            met = np.where(step == BOTH, np.roll(crossing, 1), crossing)
            crossing = met[np.maximum.accumulate(np.where(step == HYP, 0, place))]
    c = int(crossing[-1])
    return np.concatenate([_way(a[:middle], b[:c]), _way(a[middle:], b[c:])])


def _all_ways(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The steps of each pair. Pairs of like lengths advance together in tables of at most ``TABLE`` words; longer ones alone."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(a)
    n, m = (np.array([len(s) for s in x], dtype=np.int64) for x in (a, b))
    order = np.lexsort((m, -(-n // WORD)))
    long = n * (m + 1) > CELLS
    for k in np.flatnonzero(long):
        out[k] = _way(a[k], b[k])
    order = order[~long[order]]
    sides = [(np.concatenate([*x, np.zeros(1, dtype=np.int64)]), np.concatenate([[0], np.cumsum(s)])) for x, s in ((a, n), (b, m))]
    first = 0
    while first < len(order):
        words = -(-n[order[first:]] // WORD)
        part = order[first : first + int(np.searchsorted(words, words[0], side="right"))]
        need = np.arange(1, len(part) + 1) * np.maximum.accumulate(m[part] * 2 + WORD * words[0]) * (words[0] + 1)
        part = part[: max(1, int(np.searchsorted(need, TABLE, side="right")))]
        (left, right) = (_padded(*side, part) for side in sides)
        for k, way in zip(part, _short_ways(left, n[part], right, m[part])):
            out[k] = way
        first += len(part)
    return out


@F.arrow_udf(PAIRS)
def align_ids(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit alignment of two id sequences (not negative) of any length; going back, a match or substitution is preferred to
    a deletion, that to an insertion. A null sequence counts as empty."""

    def split(ids: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]

    (all_a, a), (all_b, b) = split(ref), split(hyp)
    ways = _all_ways(a, b)
    steps = np.concatenate([*ways, np.zeros(0, dtype=np.int8)])
    columns = []
    for flat, other in ((all_a, HYP), (all_b, REF)):
        there = steps != other
        at = np.maximum(np.cumsum(there) - 1, 0)
        value = flat[at] if len(flat) else np.zeros(len(steps), dtype=np.int64)
        columns.append(pa.array(value.astype(np.int32), mask=~there))
    off = np.concatenate([[0], np.cumsum([len(w) for w in ways])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(columns, ["ref", "hyp"]))


#: Scorers that this worker has loaded, by the number of the job they belong to.
_LOADED: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def score_batches(rows: DataFrame, load: Callable, output: str, keep: list[str], batch: int = 256) -> DataFrame:
    """Apply a user's scorer: ``load()`` runs once in each Python worker, which keeps what it gives for all tasks of this
    job: a function from a frame of ``batch`` rows to a frame of the columns of ``output``. ``keep`` columns are put before them.

    Frames are filled across the batches in which rows arrive; only a task's last one may be smaller.
    """
    job = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from visemill.operators.metrics import _LOADED

        if job not in _LOADED:
            _LOADED[job] = load()
        scorer = _LOADED[job]

        def scored(part: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([part[keep].reset_index(drop=True), scorer(part).reset_index(drop=True)], axis=1)

        held: list[pd.DataFrame] = []
        for frame in frames:
            while sum(map(len, held)) + len(frame) >= batch:
                taken = batch - sum(map(len, held))
                yield scored(pd.concat([*held, frame.iloc[:taken]], ignore_index=True))
                held, frame = [], frame.iloc[taken:]
            if len(frame):
                held.append(frame)
        if held:
            yield scored(pd.concat(held, ignore_index=True))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{kinds}, {output}")
