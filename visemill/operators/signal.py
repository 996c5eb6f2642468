"""Sound and landmark jobs: small vectorised helpers inside Arrow batches; arrays go in, narrow results come out."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import hash_order

DOUBLES = T.ArrayType(T.DoubleType())
FLOATS = T.ArrayType(T.FloatType())
RATE = 16000
# Lip points of the 478-point face, eye corners for the scale.
OUTER = (61, 146, 91, 181, 84, 17, 314, 405, 321, 375, 291, 409, 270, 269, 267, 0, 37, 39, 40, 185)
INNER = (78, 95, 88, 178, 87, 14, 317, 402, 318, 324, 308, 415, 310, 311, 312, 13, 82, 81, 80, 191)
EYES = (33, 263)


def as_wave(samples) -> np.ndarray:
    """Samples in [-1, 1] as float64; integers are 16-bit, bytes unsigned 8-bit."""
    if isinstance(samples, (bytes, bytearray)):
        return (np.frombuffer(samples, dtype=np.uint8).astype(np.float64) - 128) / 128
    x = np.asarray(samples if samples is not None else [])
    return x.astype(np.float64) / 32768.0 if np.issubdtype(x.dtype, np.integer) else x.astype(np.float64)


def frame_energy_db(wave: np.ndarray, rate: int = RATE, window: float = 0.025, hop: float = 0.010) -> np.ndarray:
    """Mean-square level of each frame in dB; a signal under one window counts as followed by silence.

    Squares are summed once for each stretch that windows and hops have in common, windows are sums of such stretches.
    """
    win, step = max(1, round(window * rate)), max(1, round(hop * rate))
    unit = math.gcd(win, step)
    squares = np.zeros(max(len(wave), win) // unit * unit)
    squares[: len(wave)] = np.square(wave[: len(squares)])
    cells = squares.reshape(-1, unit).sum(axis=1)
    sums = np.lib.stride_tricks.sliding_window_view(cells, win // unit)[:: step // unit].sum(axis=1)
    return 10 * np.log10(sums / win + 1e-10)


def snr_estimate(wave: np.ndarray, rate: int = RATE) -> float:
    """How far the mean of the frames louder than 70 % of them lies over the level that 10 % don't reach, within -10 to 40
    dB; -10 for no signal."""
    levels = np.sort(frame_energy_db(wave, rate)) if len(wave) else np.zeros(0)
    if not levels.size:
        return -10.0
    quiet, edge = np.quantile(levels, (0.1, 0.7))
    speech = levels[np.searchsorted(levels, edge, side="right") :]
    return float(min(40.0, max(-10.0, (speech.mean() if speech.size else edge) - quiet)))


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x**2))) if len(x) else 0.0


def unit_level(x: np.ndarray) -> np.ndarray:
    """``x`` scaled to a level of one; what is all but silent stays as it is, times 1e8."""
    return x / max(rms(x), 1e-8)


def looped(x: np.ndarray, n: int, offset: int = 0) -> np.ndarray:
    """``n`` samples of ``x`` played over and over, from ``offset`` on."""
    return np.take(x, np.arange(offset, offset + n), mode="wrap")


def mix_at_snr(wave: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """Wave plus looped noise whose level lies ``snr_db`` under that of the whole wave."""
    if len(wave) and rms(noise) < 1e-12:
        raise ValueError("silent noise")
    gain = max(rms(wave), 1e-8) * 10 ** (-snr_db / 20)
    return wave + gain / rms(noise) * looped(noise, len(wave)) if len(wave) else wave


def white_noise(n: int, rng: np.random.Generator, clips: list) -> np.ndarray:
    return rng.standard_normal(n)


def pink_noise(n: int, rng: np.random.Generator, clips: list) -> np.ndarray:
    """Power falling as 1 / f."""
    half = 1 << max(1, (n - 1).bit_length() - 1)
    parts = rng.standard_normal((2, half + 1))
    parts[:, 0] = 0
    return np.fft.irfft((parts[0] + 1j * parts[1]) / np.sqrt(np.arange(half + 1).clip(1)))[:n]


def babble_noise(n: int, rng: np.random.Generator, clips: list) -> np.ndarray:
    """Clips that have sound, of equal level, each looped from a place of its own."""
    voices = [looped(unit_level(c), n, int(rng.integers(len(c)))) for c in clips if rms(c) > 1e-8]
    if not voices:
        raise ValueError("babble needs clips with sound")
    return np.sum(voices, axis=0)


NOISES = {"white": white_noise, "pink": pink_noise, "babble": babble_noise}


def make_noise(kind: str, n: int, rng: np.random.Generator, clips: list[np.ndarray] | None = None) -> np.ndarray:
    """Noise of unit level, by one of the makers of ``NOISES``."""
    if kind not in NOISES:
        raise ValueError(f"unknown noise {kind!r}")
    return unit_level(NOISES[kind](n, rng, clips or []))


def mix_leakage(streams: list[np.ndarray], level_db: float) -> list[np.ndarray]:
    """Each stream with the sum of the others, of equal length, ``level_db`` below it."""
    out = []
    for i, own in enumerate(streams):
        rest = sum((s for k, s in enumerate(streams) if k != i), np.zeros_like(own))
        out.append(own if rms(rest) < 1e-12 else own + rest * max(rms(own), 1e-8) / (rms(rest) * 10 ** (level_db / 20)))
    return out


@functools.cache
def mel_filters(bins: int, size: int, rate: int, low: float = 20.0) -> np.ndarray:
    mel = lambda f: 1127.0 * np.log1p(f / 700.0)
    points = np.linspace(mel(low), mel(rate / 2), bins + 2)
    at = mel(np.arange(size // 2 + 1) * rate / size)
    up = (at[None] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - at[None]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(wave: np.ndarray, rate: int = RATE, bins: int = 80, normalised: bool = True) -> np.ndarray:
    """Log filterbank energies (25 ms frames every 10 ms, mean removed, pre-emphasis 0.97), each bin of mean 0 and
    deviation 1 over the utterance. Shape (frames, bins)."""
    win, step = round(0.025 * rate), round(0.010 * rate)
    if len(wave) < win:
        return np.zeros((0, bins))
    every = np.lib.stride_tricks.sliding_window_view(wave, win)[::step]
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / (win - 1))) ** 0.85
    size = 1 << (win - 1).bit_length()
    mel = np.empty((len(every), bins))
    for first in range(0, len(every), 1024):  # so many frames at once, however long the wave
        frames = every[first : first + 1024] * 32768.0
        frames = frames - frames.mean(axis=1, keepdims=True)
        frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
        power = np.abs(np.fft.rfft(frames * window, size)) ** 2
        mel[first : first + 1024] = np.log(np.maximum(power @ mel_filters(bins, size, rate).T, np.finfo(np.float32).eps))
    return (mel - mel.mean(axis=0)) / np.sqrt(mel.var(axis=0) + 1e-5) if normalised else mel


def stacked(frames: np.ndarray, by: int = 4) -> np.ndarray:
    """Every ``by`` successive frames side by side, the rest dropped."""
    n = len(frames) // by
    return frames[: n * by].reshape(n, by * frames.shape[1])


def window_features(wave: np.ndarray, start_frame: int, frames: int, rate: int = RATE, context_s: float = 0.1, by: int = 4, bins: int = 80) -> np.ndarray:
    """Stacked features of ``frames`` frames of ``by`` hops from ``start_frame`` (it may be negative), shape (frames, by * bins).

    The mel frames are those of the whole wave, of which a context on both sides is looked at where the wave has it;
    beyond the wave there is silence. Each bin is brought to mean 0 and deviation 1 over the window itself.
    """
    win, step = round(0.025 * rate), round(0.010 * rate)
    context = round(context_s * rate / step) * step
    first, size = start_frame * by * step, (frames * by - 1) * step + win
    low = first if first < 0 else max(first - context, 0)
    high = max(min(first + size + context, len(wave)), first + size)
    part = np.zeros(high - low)
    inside = wave[max(low, 0) : max(high, 0)]
    part[max(-low, 0) : max(-low, 0) + len(inside)] = inside
    mel = log_mel(part, rate, bins, normalised=False)[(first - low) // step :][: frames * by]
    return stacked((mel - mel.mean(axis=0)) / np.sqrt(mel.var(axis=0) + 1e-5), by)


def lip_geometry(points: np.ndarray) -> np.ndarray:
    """Mouth width, inner height, outer height and inner area of one face (478 x 2), in units of the distance between the
    eyes, turned so that the eyes lie level."""
    left, right = points[EYES[0]], points[EYES[1]]
    axis = right - left
    scale = max(float(np.hypot(*axis)), 1e-6)
    turn = np.array([[axis[0], axis[1]], [-axis[1], axis[0]]]) / scale
    p = (points - left) @ turn.T / scale
    inner, outer = p[list(INNER)], p[list(OUTER)]
    x, y = inner[:, 0], inner[:, 1]
    area = 0.5 * abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1)))
    return np.array([p[291, 0] - p[61, 0], p[14, 1] - p[13, 1], p[17, 1] - p[0, 1], area])


def lip_skeleton(points: np.ndarray) -> np.ndarray:
    """The 40 lip points of one face (outer, then inner) around their mean, turned so that the eyes lie level, in units of
    the distance between the eyes (1e-3 at least)."""
    eyes = complex(*(points[EYES[1]] - points[EYES[0]]))
    lips = points[list(OUTER + INNER)] @ np.array([1, 1j])
    # a division by the eyes' axis turns back and scales at once
    turned = (lips - lips.mean()) / (eyes if abs(eyes) >= 1e-3 else 1e-3 * (eyes / abs(eyes) if eyes else 1))
    return np.stack([turned.real, turned.imag], axis=1)


def mouth_box(points: np.ndarray, scale: float = 2.5) -> np.ndarray:
    """Square (x0, y0, x1, y1) around the mouth, ``scale`` times its width."""
    lips = points[list(OUTER)]
    middle, side = lips.mean(axis=0), scale * float(np.ptp(lips[:, 0]))
    return np.concatenate([middle - side / 2, middle + side / 2])


def map_boxes(boxes: Column, x0: Column, y0: Column, sx: Column, sy: Column) -> Column:
    """Boxes of a frame in the coordinates of a scaled region of it."""
    return F.transform(boxes, lambda b: F.array((b[0] - x0) * sx, (b[1] - y0) * sy, (b[2] - x0) * sx, (b[3] - y0) * sy))


def decode_regions(boxes: DataFrame, by: str, width: Column, height: Column, side: float = 360.0, margin: float = 0.12) -> DataFrame:
    """(by, x0, y0, x1, y1, w, h): the part of each video's picture to be decoded, and the size it is scaled to.

    The region is the union of the video's face boxes ``boxes(by, x0, y0, x1, y1)`` with a ``margin``, within the picture, at even
    places; it is scaled so that the median face has about ``side`` pixels (a quarter at least, never up), to even
    sizes of 64 at least. Boxes without an area don't count; without any, the picture is the face.
    """
    good = boxes.withColumns({"_w": width.cast("double"), "_h": height.cast("double")}).withColumn("_good", (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    of = lambda c: F.when(F.col("_good"), F.col(c))
    faces = good.groupBy(by).agg(
        F.max("_w").alias("_w"), F.max("_h").alias("_h"), F.min(of("x0")).alias("a"), F.min(of("y0")).alias("b"), F.max(of("x1")).alias("c"), F.max(of("y1")).alias("d"),
        F.median(F.when(F.col("_good"), F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).alias("face"),
    )
    faces = faces.select(by, "_w", "_h", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("c", "_w").alias("c"), F.coalesce("d", "_h").alias("d"), F.coalesce("face", F.greatest("_w", "_h")).alias("face"))
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    across, down = margin * (F.col("c") - F.col("a")), margin * (F.col("d") - F.col("b"))
    region = faces.select(
        by, "face", even(F.floor(F.greatest(F.col("a") - across, F.lit(0.0)))).alias("x0"), even(F.floor(F.greatest(F.col("b") - down, F.lit(0.0)))).alias("y0"),
        even(F.least(F.ceil(F.col("c") + across).cast("double"), F.col("_w"))).alias("x1"), even(F.least(F.ceil(F.col("d") + down).cast("double"), F.col("_h"))).alias("y1"),
    )
    scale = F.least(F.greatest(side / F.greatest("face", F.lit(1.0)), F.lit(0.25)), F.lit(1.0))
    sized = lambda a, z: F.greatest(F.bround((F.col(z) - F.col(a)) * scale / 2) * 2, F.lit(64)).cast("int")
    return region.select(by, "x0", "y0", "x1", "y1", sized("x0", "x1").alias("w"), sized("y0", "y1").alias("h"))


# ---------------------------------------------------------------- draws
def drawn(low: Column | int, high: Column | int, *key) -> Column:
    """A whole number from ``low`` to ``high``, reproducible from the key; null where there is none."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    number = F.conv(F.substring(hash_order(*key), 1, 15), 16, 10).cast("long")
    return F.when(high >= low, low + F.pmod(number, high - low + 1))


def mask_bands(size: Column, count: int, width: int, *key) -> Column:
    """``count`` bands (start, length) within ``size`` frames or bins, each of up to ``width``."""
    def band(i: int) -> Column:
        length = drawn(0, F.least(F.lit(width), size), *key, i, "length")
        return F.struct(drawn(0, size - length, *key, i, "start").alias("start"), length.alias("length"))

    return F.array(*[band(i) for i in range(count)])


def time_masks(n: Column, count: int, share: float, *key) -> Column:
    """``count`` masks (start, length) of a clip of ``n`` frames, each of up to ``share`` of it, reproducible from the key."""
    def mask(i: int) -> Column:
        length = drawn(0, F.floor(n * share), *key, i, "mask")
        return F.struct(drawn(0, n - length, *key, i, "place").alias("start"), length.alias("length"))

    return F.array(*[mask(i) for i in range(count)])


def window_start(n: Column, width: int, *key) -> Column:
    """First frame of a window of ``width`` in ``n`` frames; null where it does not fit."""
    return drawn(0, n - width, *key, "window")


def signed_shift(start: Column, n: Column, width: int, least: int, most: int, *key) -> Column:
    """A shift of ``least`` to ``most`` frames either way that keeps the window inside, each such with the same chance; 0 if
    there is none."""
    ways = F.filter(F.array(*[F.lit(s * m) for m in range(least, most + 1) for s in (-1, 1)]), lambda s: (start + s >= 0) & (start + s + width <= n))
    return F.coalesce(F.get(ways, drawn(0, F.size(ways) - 1, *key, "shift").cast("int")), F.lit(0))


# ---------------------------------------------------------------- as columns
@F.pandas_udf(DOUBLES)
def energy_column(wave: pd.Series) -> pd.Series:
    return wave.map(lambda w: None if w is None else frame_energy_db(as_wave(w)))


def cell_energy(wave: Column, size: int) -> Column:
    """log10(1 + mean square) of each whole cell of ``size`` samples of a wave of bytes (unsigned, 128 is silence)."""

    @F.pandas_udf(DOUBLES)
    def energy(samples: pd.Series) -> pd.Series:
        def one(w):
            if w is None:
                return None
            x = np.frombuffer(w, dtype=np.uint8).astype(np.float64) - 128
            return np.log10(np.square(x[: len(x) // size * size]).reshape(-1, size).mean(axis=1) + 1)

        return samples.map(one)

    return energy(wave)


@F.pandas_udf(T.DoubleType())
def snr_column(wave: pd.Series) -> pd.Series:
    return wave.map(lambda w: snr_estimate(as_wave(w)))


def _noisy(kind: str, snr_db: float, seed: int, clips: list):
    """(key, samples) -> the wave and the wave with noise of its own, reproducible from seed and key. ``clips`` are pairs
    of key and samples for babble; a wave's own clip is left out."""
    import zlib

    def one(key, samples) -> tuple[np.ndarray, np.ndarray]:
        x = as_wave(samples)
        rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
        others = [as_wave(c) for k, c in clips if k != key]
        return x, mix_at_snr(x, make_noise(kind, max(len(x), 1), rng, others), snr_db)

    return one


def noisy_column(kind: str, snr_db: float, seed: int, clips: list = ()):
    """Column function (key, wave): the wave with noise at ``snr_db``."""
    add_noise = _noisy(kind, snr_db, seed, clips)

    @F.pandas_udf(FLOATS)
    def add(key: pd.Series, wave: pd.Series) -> pd.Series:
        return pd.Series([add_noise(k, w)[1].astype(np.float32) for k, w in zip(key, wave)])

    return add


def mixed_snr_column(kind: str, snr_db: float, seed: int, clips: list = ()):
    """Column function (key, wave): level of the wave over the noise put on it, in dB, measured after mixing."""
    add_noise = _noisy(kind, snr_db, seed, clips)

    @F.pandas_udf(T.DoubleType())
    def measure(key: pd.Series, wave: pd.Series) -> pd.Series:
        pairs = [add_noise(k, w) for k, w in zip(key, wave)]
        return pd.Series([20 * np.log10(rms(x) / rms(y - x)) if rms(x) > 1e-8 else None for x, y in pairs])

    return measure


#: Values of arrays that are handed back to Spark at once.
PART = 1 << 20


def with_arrays(rows: DataFrame, inputs: list[str], name: str, make: Callable[..., np.ndarray], part: int = PART) -> DataFrame:
    """``rows`` with ``make(*inputs)`` as the array<float> column ``name`` in place of the inputs; null where an input is null.

    A column of long arrays would be made whole for all rows of an Arrow batch; here a batch comes back in parts of about ``part`` values.
    """
    kept = [c for c in rows.columns if c not in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, first, made, n = [b.column(c) for c in inputs], 0, [], 0
            for k in range(b.num_rows):
                values = [c[k].as_py() for c in columns]
                made.append(None if any(v is None for v in values) else np.asarray(make(*values), dtype=np.float32).ravel())
                n += 0 if made[-1] is None else len(made[-1])
                if n >= part or k == b.num_rows - 1:
                    arrays = [b.column(c).slice(first, len(made)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(made, type=pa.list_(pa.float32()))], names=[*kept, name])
                    first, made, n = k + 1, [], 0

    return rows.select(*kept, *inputs).mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, FLOATS)]))


def tiled_windows(rows: DataFrame, wave: str, start: str, frames: int, rate: int = RATE, by: int = 4, margin: int = 3) -> DataFrame:
    """``rows`` with a row for each window of ``frames`` frames of ``by`` hops, so that the windows lie end to end over the whole wave
    of bytes and one begins at frame ``start`` (which may lie outside).

    ``start`` becomes the window's own; ``wave`` becomes the samples from ``margin`` frames before the window to as many after it, as
    far as there are any, and ``at`` is the window's first frame in them.
    """
    win, hop = round(0.025 * rate), round(0.010 * rate) * by
    n, drawn_at = F.octet_length(wave), F.col(start)
    first = F.when(n > 0, drawn_at - F.ceil(F.greatest(drawn_at, F.lit(0)) / frames) * frames).otherwise(drawn_at)
    starts = F.sequence(first.cast("long"), F.greatest(drawn_at.cast("long"), F.floor((n - 1) / hop)), F.lit(frames).cast("long"))

    def window(s: Column) -> Column:
        low = F.greatest(s - margin, F.lit(0))
        size = F.greatest((s + frames + margin - low) * hop + win - hop // by, F.lit(0))
        return F.struct(s.cast("int").alias("s"), (s - low).cast("int").alias("at"), F.substring(F.col(wave), (low * hop + 1).cast("int"), size.cast("int")).alias("w"))

    others = [c for c in rows.columns if c not in (wave, start)]
    return rows.select(*others, F.inline(F.transform(starts, window)).alias(start, "at", wave))


def leaked_streams(rows: DataFrame, by: str, order: str, wave: str, level_db: float, part: int = PART) -> DataFrame:
    """(by, n_streams, stream, first, y): ``mix_leakage`` of the streams of each scene of ``rows(by, order, wave)``, numbered by
    ``order``, in pieces of up to ``part`` samples from sample ``first`` on; a shorter stream is silent after its end.

    A pass over sorted rows holds the waves of one scene as they came, their sum, and one mixed stream.
    """
    from .segments import whole_groups

    def mixed(waves: list) -> Iterator[np.ndarray]:
        total = np.zeros(max(map(len, waves)))
        for w in waves:
            total[: len(w)] += as_wave(w)
        for w in waves:
            own, x = np.zeros(len(total)), as_wave(w)
            own[: len(x)] = x
            rest = total - own
            yield own if rms(rest) < 1e-12 else own + rest * max(rms(own), 1e-8) / (rms(rest) * 10 ** (level_db / 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, n = [], 0
        table = lambda: pd.DataFrame(done, columns=[by, "n_streams", "stream", "first", "y"])
        for scene in whole_groups(batches, [by]):
            key, waves = scene[by].iat[0], scene[wave].tolist()
            for stream, y in enumerate(mixed(waves)):
                for first in range(0, len(y), part):
                    done.append((key, len(waves), stream, first, y[first : first + part]))
                    n += len(done[-1][-1])
                    if n >= part:
                        yield table()
                        done, n = [], 0
        if done:
            yield table()

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, order, wave).repartition(by).sortWithinPartitions(by, order, wave).mapInPandas(run, f"{by} {kind}, n_streams long, stream int, first long, y array<double>")


@F.pandas_udf(T.ArrayType(DOUBLES))
def leakage_column(streams: pd.Series, level_db: pd.Series) -> pd.Series:
    """Streams of a scene (arrays of samples), each with the sum of the others ``level_db`` below it; a shorter stream is
    silent after its end."""

    def one(parts, level):
        waves = [as_wave(p) for p in parts]
        n = max(map(len, waves), default=0)
        return list(mix_leakage([np.pad(w, (0, n - len(w))) for w in waves], float(level)))

    return pd.Series([one(p, v) for p, v in zip(streams, level_db)])


@F.pandas_udf(FLOATS)
def mel_column(wave: pd.Series) -> pd.Series:
    """Stacked normalised log-mel features, flattened."""
    return wave.map(lambda w: None if w is None else stacked(log_mel(as_wave(w))).ravel().astype(np.float32))


def window_column(frames: int):
    """Column function (wave, start): ``window_features`` of ``frames`` frames from frame ``start``, flattened."""

    @F.pandas_udf(FLOATS)
    def features(wave: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([None if w is None or s is None or np.isnan(s) else window_features(as_wave(w), int(s), frames).ravel().astype(np.float32) for w, s in zip(wave, start)])

    return features


@F.pandas_udf(DOUBLES)
def skeleton_column(points: pd.Series) -> pd.Series:
    """The lip skeleton of flattened landmarks, x and y of each of 40 points; null without a face."""
    return points.map(lambda p: None if p is None else lip_skeleton(np.asarray(p, dtype=np.float64).reshape(-1, 2)).ravel())


@F.pandas_udf(DOUBLES)
def lip_column(points: pd.Series) -> pd.Series:
    """Geometry of the lips of flattened landmarks; null without a face."""
    return points.map(lambda p: None if p is None else lip_geometry(np.asarray(p, dtype=np.float64).reshape(-1, 2)))


@F.pandas_udf(DOUBLES)
def mouth_column(points: pd.Series) -> pd.Series:
    """``mouth_box`` of flattened landmarks; null without a face."""
    return points.map(lambda p: None if p is None else mouth_box(np.asarray(p, dtype=np.float64).reshape(-1, 2)))
