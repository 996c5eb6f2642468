"""Spans of time and frames: padding, joining, interpolating, smoothing, segmenting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded_spans(sentences: DataFrame, by: str, duration: Column, shift: Column | float = 0.0, most: float = 0.2) -> DataFrame:
    """``sentences(start_s, end_s)`` with span_start and span_end: padded by half the gap to the neighbour, ``most`` at
    most, shifted, and kept within the recording."""
    w = Window.partitionBy(by).orderBy("start_s")
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    side = lambda gap: F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(gap, F.lit(2 * most)) / 2))
    left, right = side(F.col("start_s") - F.lag("end_s").over(w)), side(F.lead("start_s").over(w) - F.col("end_s"))
    return sentences.withColumn("span_start", F.greatest(F.lit(0.0), F.col("start_s") + shift - left)).withColumn("span_end", F.least(duration, F.col("end_s") + shift + right))


def frames_of_spans(spans: DataFrame, start: Column, end: Column, fps: float) -> DataFrame:
    """Each span once for every frame k of [round(start * fps), round(end * fps)), halves to even: the join of frames
    with spans becomes an equi-join on k."""
    first, stop = F.bround(start * fps).cast("long"), F.bround(end * fps).cast("long")
    return spans.withColumn("k", F.explode(F.when(stop > first, F.sequence(first, stop - 1))))


def span_of_frame(spans: DataFrame, by: str, span: str, fps: float) -> DataFrame:
    """(by, k, span): the span that holds each frame, the later of two that do."""
    rows = frames_of_spans(spans, F.col("start_s"), F.col("end_s"), fps)
    return rows.groupBy(by, "k").agg(F.max(span).alias(span))


def share_of_valid(frames: DataFrame, spans: DataFrame, by: str, span: str, fps: float) -> DataFrame:
    """Share of valid frames in each span: 0 for one without frames, null without any frame of its stream."""
    hit = frames_of_spans(spans, F.col("start_s"), F.col("end_s"), fps).join(frames.select(by, "k", "valid"), [by, "k"])
    share = hit.groupBy(by, span).agg(F.avg(F.col("valid").cast("double")).alias("share"))
    known = frames.select(by).distinct().withColumn("_known", F.lit(True))
    return spans.join(share, [by, span], "left").join(known, by, "left").withColumn("share", F.when(F.col("_known"), F.coalesce("share", F.lit(0.0)))).drop("_known")


def _around(by: str, order: str, value: Column):
    back = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)


def fill_invalid(frames: DataFrame, by: str, order: str = "k", value: str = "x", valid: str = "valid") -> DataFrame:
    """``filled``: values of invalid frames on the line between their valid neighbours; ends held; zeros without any."""
    known = F.when(F.col(valid), F.struct(F.col(order).cast("double").alias("t"), F.col(value).alias("v")))
    before, after = _around(by, order, known)
    rows = frames.withColumn("_a", before).withColumn("_b", after)
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    filled = F.when(F.col(valid), F.col(value)).when(F.col("_a").isNull(), F.coalesce("_b.v", F.lit(0.0))).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between)
    return rows.withColumn("filled", filled).drop("_a", "_b")


def interpolate_on_grid(frames: DataFrame, by: str, time: str, value: str, step: float, reach: float) -> DataFrame:
    """(by, g, x) at times g * step between the first and last valid frame: linear between the valid neighbours, null
    farther than ``reach`` from the nearer one."""
    known = frames.filter("valid").select(by, F.col(time).alias("t"), F.col(value).alias("v"))
    ends = known.groupBy(by).agg(F.ceil(F.min("t") / step - 1e-9).alias("a"), F.floor(F.max("t") / step + 1e-9).alias("b"))
    grid = ends.filter("a <= b").select(by, F.explode(F.sequence("a", "b")).alias("g")).select(by, (F.col("g") * step).alias("t"), "g")
    both = known.select(by, "t", F.lit(None).cast("long").alias("g"), F.struct("t", "v").alias("p")).unionByName(grid.withColumn("p", F.lit(None).cast("struct<t:double,v:double>")))
    back = Window.partitionBy(by).orderBy("t", F.col("g").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("t", F.col("g").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("_a", F.last("p", ignorenulls=True).over(back)).withColumn("_b", F.first("p", ignorenulls=True).over(ahead)).filter("g is not null")
    near = F.least(F.coalesce(F.col("t") - F.col("_a.t"), F.lit(1e300)), F.coalesce(F.col("_b.t") - F.col("t"), F.lit(1e300)))
    width = F.col("_b.t") - F.col("_a.t")
    x = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (width == 0), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("t") - F.col("_a.t")) / width)
    return rows.select(by, "g", F.when(near <= reach, x).alias("x"))


def running_median(frames: DataFrame, by: list[str], order: str, value: str, width: int = 9, fallback: str | None = None) -> DataFrame:
    """``median`` of the last ``width`` values that are not null, the current one included; nulls hold it; null before
    the first value. Where ``value`` is null the column ``fallback`` (as a label's box for a frame without a face) counts."""
    if fallback is not None:
        frames = frames.withColumn(value, F.coalesce(value, fallback))
    w = Window.partitionBy(*by).orderBy(order)
    counted = frames.withColumn("_n", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # medians of the values alone, looked up by how many have come so far
    last = F.sort_array("_l")
    n = F.size("_l")
    middle = (F.element_at(last, F.floor((n + 1) / 2).cast("int")) + F.element_at(last, F.floor(n / 2).cast("int") + 1)) / 2
    values = counted.filter(F.col(value).isNotNull()).withColumn("_l", F.collect_list(value).over(w.rowsBetween(1 - width, 0)))
    return counted.join(values.select(*by, "_n", middle.alias("median")), [*by, "_n"], "left").drop("_n")


def moving_stats(frames: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """Centred moving mean and deviation over ``width`` frames, the ends repeated beyond the edges.

    The frames in the window are summed by a window function; what the repeated ends add is their value times the
    number of places that fall outside.
    """
    left = width // 2
    right = width - 1 - left
    whole = Window.partitionBy(by)
    inside = whole.orderBy(order).rowsBetween(-left, right)
    at, n = F.row_number().over(whole.orderBy(order)) - 1, F.count("*").over(whole)
    first, last = F.first(value).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = frames.withColumn("_mean", F.avg(value).over(whole)).withColumn("_low", F.greatest(F.lit(left) - at, F.lit(0))).withColumn("_high", F.greatest(at + right - n + 1, F.lit(0))).withColumn("_a", first).withColumn("_b", last)
    x = F.col(value) - F.col("_mean")
    a, b = F.col("_a") - F.col("_mean"), F.col("_b") - F.col("_mean")
    s1 = (F.sum(x).over(inside) + F.col("_low") * a + F.col("_high") * b) / width
    s2 = (F.sum(x * x).over(inside) + F.col("_low") * a * a + F.col("_high") * b * b) / width
    return rows.withColumn("moving_mean", s1 + F.col("_mean")).withColumn("moving_std", F.sqrt(F.greatest(s2 - s1 * s1, F.lit(0.0)))).drop("_mean", "_low", "_high", "_a", "_b")


def active_runs(frames: DataFrame, by: str, order: str, active: str, least: int = 1, hangover: int = 0, gap: int = 0) -> DataFrame:
    """(by, start, stop) of runs of active frames: those of ``least`` or more, prolonged by ``hangover`` within the
    recording, joined where fewer than ``gap`` frames part them (touching runs always)."""
    w = Window.partitionBy(by).orderBy(order)
    flag = F.col(active).cast("int")
    change = (flag != F.coalesce(F.lag(flag).over(w), F.lit(-1))).cast("int")
    rows = frames.withColumn("_c", change).withColumn("_n", F.max(F.col(order) + 1).over(Window.partitionBy(by))).withColumn("_g", F.sum("_c").over(w))
    runs = rows.filter(active).groupBy(by, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.first("_n").alias("_n")).filter(F.col("stop") - F.col("start") >= least)
    runs = runs.withColumn("stop", F.least(F.col("stop") + hangover, F.col("_n")))
    w = Window.partitionBy(by).orderBy("start")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", F.coalesce(((F.col("start") - reach) >= gap) & (F.col("start") > reach), F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return runs.groupBy(by, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by a map-side combinable maximum."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def z_scores(frames: DataFrame, by: str, value: str, valid: str, floor: float = 0.01) -> DataFrame:
    """``z`` over the valid frames of each group (population deviation, floored); 0 for invalid frames and where fewer
    than two are valid."""
    w = Window.partitionBy(by)
    x = F.when(F.col(valid), F.col(value))
    z = (F.col(value) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))
    return frames.withColumn("z", F.when(F.col(valid) & (F.count(x).over(w) >= 2), z).otherwise(0.0))


def pixel_z_scores(frames: DataFrame, by: str, pixels: str = "pixels", floor: float = 1e-3, fixed: tuple[float, float] | None = None) -> DataFrame:
    """``pixels`` (bytes as numbers, one channel a row) divided by 255 and brought to mean 0 and deviation 1 over all frames
    of a group, or by the ``fixed`` mean and deviation of a whole data set. Frames are summed first, groups from those."""
    unit = F.transform(pixels, lambda p: p.cast("double") / 255)
    if fixed:
        return frames.withColumn(pixels, F.transform(unit, lambda p: (p - fixed[0]) / fixed[1]))
    add = lambda f: F.aggregate(unit, F.lit(0.0), lambda a, p: a + f(p))
    sums = frames.select(by, F.size(pixels).alias("n"), add(lambda p: p).alias("s1"), add(lambda p: p * p).alias("s2")).groupBy(by).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    scale = sums.select(by, mean.alias("_mean"), F.greatest(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(floor)).alias("_sd"))
    return frames.join(scale, by).withColumn(pixels, F.transform(unit, lambda p: (p - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def even_times(rows: DataFrame, by: str, order: str, start: str, end: str) -> DataFrame:
    """``even_start`` and ``even_end``: as many equal spans as rows between the first start and the last end."""
    w = Window.partitionBy(by)
    a, b, n = F.min(start).over(w), F.max(end).over(w), F.count("*").over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    step = (b - a) / n
    return rows.withColumn("even_start", a + at * step).withColumn("even_end", a + (at + 1) * step)


def ctc_collapse(path: DataFrame, by: str, order: str, label: str, specials: list[int]) -> DataFrame:
    """(by, order, label) of the frames that remain of a path: repeats dropped, then blanks and other specials. Frames stay
    rows, so a stream is never gathered."""
    before = F.lag(label).over(Window.partitionBy(by).orderBy(order))
    kept = path.select(by, order, label, before.alias("_b")).filter(~F.col("_b").eqNullSafe(F.col(label)) & ~F.col(label).isin(specials))
    return kept.select(by, order, label)


def token_spans(path: DataFrame, by: str, order: str, label: str, logp: str, blank: int = 0) -> DataFrame:
    """(by, token, id, first, last, mean_logp): frames of each token along a path; a token begins where a label other
    than the blank differs from the frame before."""
    w = Window.partitionBy(by).orderBy(order)
    begins = ((F.col(label) != blank) & (F.col(label) != F.coalesce(F.lag(label).over(w), F.lit(blank)))).cast("int")
    rows = path.withColumn("_b", begins).withColumn("token", F.sum("_b").over(w)).filter(F.col(label) != blank)
    return rows.groupBy(by, "token").agg(F.max(label).alias("id"), F.min(order).alias("first"), F.max(order).alias("last"), F.avg(logp).alias("mean_logp"))


def last_inside(sentences: DataFrame, by: str, limit: str) -> DataFrame:
    """(by, sentence_id, end_s): the last sentence that ends by the time ``limit`` and starts at 0 or later."""
    inside = sentences.filter((F.col("end_s") <= F.col(limit)) & (F.col("start_s") >= 0))
    return inside.groupBy(by).agg(F.max_by(F.struct("sentence_id", "end_s"), F.struct("end_s", "sentence_id")).alias("_s")).select(by, "_s.*")


def nearest_pause(sentences: DataFrame, by: str, middle: str) -> DataFrame:
    """The pause between sentences whose middle is closest to ``middle``, the earlier of equals: (by, pause_at)."""
    w = Window.partitionBy(by).orderBy("start_s")
    gaps = sentences.withColumn("pause_at", (F.col("end_s") + F.lead("start_s").over(w)) / 2).filter("pause_at is not null")
    return gaps.groupBy(by).agg(F.min_by("pause_at", F.struct(F.abs(F.col("pause_at") - F.col(middle)), "pause_at")).alias("pause_at"))
