"""Label fields as column expressions: stems, durations, boxes, paths, split rules, SNR gates, subtitle times."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a recording's stem, in order.
STEM = r"^lip_([A-Z])_(\d+)_([FM])_(\d+)_([A-Z]\d+)_([A-Z])_(\d+)$"
STEM_FIELDS = {"group": 1, "age": 2, "gender": 3, "speaker": 5, "angle": 6, "session": 7}
#: SNR bucket borders and midpoints in dB, clean first.
SNR_BORDERS = (20.0, 10.0, 0.0)
SNR_MIDPOINTS = (25.0, 15.0, 5.0, -5.0)
#: Below this share of frames with lips, reading them is hopeless.
MIN_VISUAL_RATIO = 0.2


def parse_stem(stem: Column) -> Column:
    """struct(group, age, gender, speaker, angle, session); null where the stem has another form."""
    fields = F.struct(*[F.regexp_extract(stem, STEM, k).alias(n) for n, k in STEM_FIELDS.items()])
    return F.when(stem.rlike(STEM), fields)


def parse_duration(text: Column) -> Column:
    """Seconds of 'H:MM:SS', 'M:SS' or 'S' (fractions allowed)."""
    parts = F.split(text, ":")

    def nth(k: int) -> Column:
        return F.when(F.size(parts) >= k, F.element_at(parts, -k)).otherwise(F.lit("0")).cast("double")

    return F.when(text.isNotNull(), nth(3) * 3600 + nth(2) * 60 + nth(1))


def parse_resolution(text: Column) -> Column:
    """struct(width, height) of '1920*1080', '1920x1080' or '1920X1080'; null counts as 1920*1080."""
    parts = F.split(F.coalesce(text, F.lit("1920*1080")), "[*xX]")
    return F.struct(parts[0].cast("int").alias("width"), parts[1].cast("int").alias("height"))


def bbox_order(boxes: Column, width: Column, height: Column, default: str = "yx") -> Column:
    """'xy' or 'yx', whichever leaves fewer box corners outside the frame; ``default`` on a tie or without boxes."""

    def outside(x: int, y: int) -> Column:
        one = lambda b: (b[x] > width).cast("int") + (b[y] > height).cast("int")
        return F.aggregate(boxes, F.lit(0), lambda total, b: total + one(b))

    xy, yx = outside(2, 3), outside(3, 2)
    return F.when(xy < yx, "xy").when(yx < xy, "yx").otherwise(default)


def reorder_boxes(boxes: Column, order: Column) -> Column:
    """Boxes as (x0, y0, x1, y1) whatever their order was."""
    return F.when(order == "yx", F.transform(boxes, lambda b: F.array(b[1], b[0], b[3], b[2]))).otherwise(boxes)


def is_safe_path(path: Column) -> Column:
    """A relative path that stays inside its folder: not empty or absolute, no '..', no drive letter."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return path.isNotNull() & (path != "") & ~slashed.startswith("/") & ~F.array_contains(F.split(slashed, "/"), "..") & ~slashed.contains(":")


def among(column: Column, wanted: str | Iterable[str] | None) -> Column:
    """Filter rule of jobs: None, '' and 'all' keep everything, 'A,C' or a list keeps those (any case)."""
    if wanted is None or isinstance(wanted, str) and wanted.strip().lower() in ("", "all"):
        return F.lit(True)
    items = wanted.split(",") if isinstance(wanted, str) else list(wanted)
    names = sorted({str(x).strip().upper() for x in items if str(x).strip()})
    return F.upper(column).isin(names) if names else F.lit(True)


def audio_key(speaker: Column, session: Column, sentence_id: Column, utt_id: Column) -> Column:
    """Identity of the recorded sound; all camera angles of a session share it."""
    return F.concat_ws("|", F.coalesce(speaker.cast("string"), F.lit("")), F.coalesce(session.cast("string"), F.lit("")), F.coalesce(sentence_id.cast("string"), utt_id.cast("string")))


def drop_reason(*, has_unk: Column, n_frames: Column, duration: Column, angle: Column, speaker: Column, split_dir: Column, val: Iterable[str], test: Iterable[str], train_dirs: Iterable[str], angles=None, min_duration: float = 0.0, max_duration: float = float("inf")) -> tuple[Column, Column]:
    """(split, reason): the first rule that a row breaks, in the order unknown text, length, angle, no split."""
    val, test, train_dirs = sorted(map(str, val)), sorted(map(str, test)), sorted(map(str, train_dirs))
    if both := set(val) & set(test):
        raise ValueError(f"speakers of both validation and test: {sorted(both)}")
    short = (n_frames <= 0) | ~duration.between(min_duration, max_duration)
    reason = F.when(has_unk, "has_unk").when(short, "duration").when(~among(angle, angles), "angle")
    reason = reason.when(~(speaker.isin(test + val) | split_dir.isin(train_dirs)), "no_split")
    split = F.when(speaker.isin(test), "test").when(speaker.isin(val), "val").otherwise("train")
    return F.when(reason.isNull(), split), reason


def resampled_length(n: Column, fps_in: float, fps_out: float) -> Column:
    return F.greatest(F.ceil(n * fps_out / fps_in - 1e-9), F.lit(0)).cast("int")


def resample_indices(n: Column, fps_in: float, fps_out: float) -> Column:
    """Nearest source frame of every output frame, halves up, within the clip."""
    length = resampled_length(n, fps_in, fps_out)
    steps = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.least(F.floor(k * (fps_in / fps_out) + 0.5), n - 1).cast("int"))


def gather(values: Column, index: Column) -> Column:
    """values[index[0]], values[index[1]], ... (0-based)."""
    return F.transform(index, lambda i: values[i])


def snr_bucket(db: Column) -> Column:
    """0 clean (or unknown), then falling: borders at 20, 10 and 0 dB."""
    a, b, c = SNR_BORDERS
    return F.when(db.isNull() | (db >= a), 0).when(db >= b, 1).when(db >= c, 2).otherwise(3)


def snr_of_logits(logits: Column) -> Column:
    """Midpoint of the bucket with the largest logit, the first of equals."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in SNR_MIDPOINTS]), at)


def combine_snr(dsp: Column, model: Column, estimator: str = "hybrid") -> Column:
    if estimator == "dsp":
        return F.coalesce(dsp, model)
    if estimator == "model":
        return F.coalesce(model, dsp)
    if estimator == "hybrid":
        return F.coalesce((dsp + model) / 2, dsp, model)
    raise ValueError(f"unknown estimator {estimator!r}")


def choose_mode(snr: Column, threshold: float, forced: str = "auto", visual_ratio: Column | None = None) -> Column:
    """'av' with enough SNR, 'video' with little or none, 'audio' when the lips are out of sight but sound exists."""
    if forced != "auto":
        return F.lit(forced)
    mode = F.when(snr.isNull(), "video").when(snr >= threshold, "av")
    if visual_ratio is not None:
        mode = mode.when(visual_ratio < MIN_VISUAL_RATIO, "audio")
    return mode.otherwise("video")


def choose_vad(snr: Column, threshold: float, mode: Column | None = None, visual_ratio: Column | None = None) -> Column:
    """'energy' or 'visual' segmentation of a whole file; no SNR means no sound."""
    vad = F.when(snr.isNull(), "visual")
    if mode is not None:
        vad = vad.when(mode.isin("audio", "av"), "energy")
    if visual_ratio is not None:
        vad = vad.when(visual_ratio < MIN_VISUAL_RATIO, "energy")
    return vad.otherwise(F.when(snr >= threshold, "energy").otherwise("visual"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; halves of a millisecond go to the even one, negative times count as zero."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, of: F.floor(ms / unit) % of if of else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def audio_frames(n_samples: Column, window: int = 400, hop: int = 160, stack: int = 4) -> Column:
    """Number of whole stacked analysis frames in a signal."""
    frames = F.when(n_samples < window, 0).otherwise(1 + F.floor((n_samples - window) / hop))
    return F.floor(frames / stack).cast("long")


def window_start(n: Column, w: int) -> Column:
    """First frame of the centred window of ``w`` frames; null where the clip is too short."""
    return F.when(n >= w, F.floor((n - w) / 2)).cast("int")
