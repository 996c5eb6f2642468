"""Incremental work as Structured Streaming jobs, and what they must equal in one batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import latest_by_key
from ..operators.ordering import cut
from ..sources.writers import bucket_of, folder_exists, replace_keys


def ingest(stream: DataFrame, key: str, time: str, delay: str, sink: str, checkpoint: str):
    """Append rows of new files once to the Parquet table ``sink``; a key seen before is dropped, so a second run adds
    nothing. Runs to the end of what is there, then stops.

    A key is remembered until the watermark, ``delay`` behind the latest ``time`` (a timestamp), has passed its row, so the state
    holds the keys of that stretch and no more: ``delay`` must exceed how far apart copies of a row arrive. Rows older than
    the watermark are left out; ``rows_too_late`` counts them.
    """
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_too_late(query) -> int:
    """Rows that the batches of a stopped query (those that Spark still reports on) left out as older than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def latest_status(stream: DataFrame, key: str, order: list[str], sink: str, checkpoint: str, buckets: int = 64):
    """Keep a Parquet table of the last record of each key, dealt to folders by a hash of the key. A batch reads and writes
    the folders that its own keys fall into, and a repeated batch changes nothing."""

    def fold(batch: DataFrame, number: int) -> None:
        fresh = cut(latest_by_key(batch, key, order))
        if folder_exists(batch.sparkSession, sink):
            touched = [r[0] for r in fresh.select(bucket_of(key, buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            before = batch.sparkSession.read.parquet(sink).filter(F.col("_bucket").isin(touched)).drop("_bucket")
            fresh = latest_by_key(fresh.unionByName(before.join(fresh.select(key), key, "left_semi")), key, order)
        replace_keys(fresh, sink, key, buckets)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("_bucket")


# ---------------------------------------------------------------- frame resampler
TINY = 1e-6  # seconds; a grid time this close to the middle between two frames goes to the later one
STATE = T.StructType([T.StructField("grid", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("gap", T.DoubleType()), T.StructField("fixed", T.LongType())])
COPIES = "video string, frame long, copies int, fixed long"


@dataclass
class Carried:
    """What a video's earlier frames leave behind: grid times already served, the last frame and its time, the gap before
    it, timestamps repaired so far."""

    grid: int = 0
    frame: int = -1
    time: float | None = None
    gap: float = 1 / 30
    fixed: int = 0


def repaired_times(t: np.ndarray, was: Carried) -> tuple[np.ndarray, np.ndarray]:
    """Timestamps (NaN where missing) made rising, and which were repaired: one that is missing, negative or does not rise
    becomes the time before plus the gap before that.

    Stretches of rising times are taken whole, and so are stretches of missing ones, which continue evenly.
    """
    n = len(t)
    real = np.isfinite(t) & (t >= 0)
    rising = real.copy()  # good if the frame before is taken as it is
    rising[1:] &= real[:-1] & (t[1:] > t[:-1] + TINY)
    rising[:1] = False
    ends = np.append(np.flatnonzero(~rising), n)  # where stretches begin, and the end
    next_real = np.append(np.minimum.accumulate(np.where(real, np.arange(n), n)[::-1])[::-1], n)
    out, bad = np.empty(n), np.ones(n, dtype=bool)
    time, gap, i = was.time, was.gap, 0
    while i < n:
        if real[i] and (time is None or t[i] > time + TINY):
            stop = int(ends[np.searchsorted(ends, i, "right")])
            out[i:stop], bad[i:stop] = t[i:stop], False
            if stop - i > 1:
                gap = out[stop - 1] - out[stop - 2]
            elif time is not None:
                gap = out[i] - time
        else:
            stop = max(i + 1, int(next_real[i]))
            first = -gap if time is None else time
            out[i:stop] = first + gap * np.arange(1, stop - i + 1)
        time, i = float(out[stop - 1]), stop
    return out, bad


def grid_copies(frames: np.ndarray, t: np.ndarray, fps: float, was: Carried, ends: bool) -> tuple[pd.DataFrame, Carried]:
    """(frame, copies, fixed): how often a grid of ``fps`` shows each frame, the one nearest in time, and the timestamps
    repaired up to it; and what to carry on.

    A frame's share ends midway to the next, so the carried frame is told first, and the last frame only where the video
    ``ends``, by one more gap.
    """
    times, bad = repaired_times(t, was)
    fixed = was.fixed + np.cumsum(bad)
    if was.time is not None:
        times, frames, fixed = np.append(was.time, times), np.append(was.frame, frames), np.append(was.fixed, fixed)
    gap = float(times[-1] - times[-2]) if len(times) > 1 else was.gap
    borders = (times[:-1] + times[1:]) / 2
    if ends:
        borders = np.append(borders, times[-1] + gap)
    served = np.maximum.accumulate(np.append(was.grid, np.ceil((borders - TINY) * fps).astype(np.int64)))
    told = pd.DataFrame({"frame": frames[: len(borders)], "copies": np.diff(served), "fixed": fixed[: len(borders)]})
    return told, Carried(int(served[-1]), int(frames[-1]), float(times[-1]), gap, int(fixed[-1]))


def _numbers(t: pd.Series) -> np.ndarray:
    return pd.to_numeric(t, errors="coerce").to_numpy(dtype=np.float64)


def resample_batch(frames: DataFrame, fps: float) -> DataFrame:
    """(video, frame, copies, fixed) of ``frames(video, frame, t)``; ``fixed`` counts repaired timestamps so far.

    A video's rows reach one task in order; the task holds one batch of them and what earlier batches left behind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last video's rows so far unserved: at least the newest one
        was = Carried()

        def serve(rows: pd.DataFrame, ends: bool) -> pd.DataFrame:
            nonlocal was
            told, now = grid_copies(rows["frame"].to_numpy(), _numbers(rows["t"]), fps, was, ends)
            was = Carried() if ends else now
            return told.assign(video=rows["video"].iloc[0])[["video", "frame", "copies", "fixed"]]

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            border = np.flatnonzero((rows["video"] != rows["video"].shift()).to_numpy())
            for a, b in zip(border, [*border[1:], None]):
                part = rows.iloc[a:b]
                if b is not None:
                    yield serve(part, True)
                else:  # more of it may come: keep one row back
                    if len(part) > 1:
                        yield serve(part.iloc[:-1], False)
                    held = part.iloc[-1:]
        if held is not None:
            yield serve(held, True)

    placed = frames.select("video", "frame", "t").repartition("video").sortWithinPartitions("video", "frame")
    return placed.mapInPandas(run, COPIES)


class Resampler(StatefulProcessor):
    """Five numbers of state for each open video. It ends at its last frame, or by a timer: when the watermark has passed the
    video's latest frame by ``patience`` milliseconds, the frame held back is told as the last."""

    def __init__(self, fps: float, patience: int):
        self.fps, self.patience = fps, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carried", STATE)

    def _serve(self, video: str, rows: pd.DataFrame, ends: bool) -> pd.DataFrame:
        was = Carried(*self.state.get()) if self.state.exists() else Carried()
        told, now = grid_copies(rows["frame"].to_numpy(), _numbers(rows["t"]), self.fps, was, ends)
        if ends:
            self.state.clear()
        else:
            self.state.update((now.grid, now.frame, now.time, now.gap, now.fixed))
        return told.assign(video=video)[["video", "frame", "copies", "fixed"]]

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("frame")
        if key[0] is None:  # a clock's row
            return
        ends = bool(got["last"].fillna(False).any())
        self._stop_timers()
        if not ends:
            self.handle.registerTimer(int(got["at"].max().timestamp() * 1000) + self.patience)
        yield self._serve(key[0], got, ends)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._serve(key[0], pd.DataFrame({"frame": np.zeros(0, dtype=np.int64), "t": np.zeros(0)}), True)

    def close(self) -> None:
        pass


def resample_stream(frames: DataFrame, fps: float, delay: str = "10 seconds", patience: float = 30.0) -> DataFrame:
    """``resample_batch`` for a stream of ``frames(video, frame, t, at timestamp, last boolean)``. A frame's copies are told
    when the next one comes; those of a video's last frame when it is marked ``last``, or when the watermark (``delay``
    behind the latest ``at`` of all videos) is ``patience`` seconds past its ``at``.

    Within a batch rows may come in any order, batches follow that of the frames. Rows without a video are a clock: they
    move the watermark on and are told nowhere. A frame that comes after its video has ended begins it anew. Needs the
    RocksDB state store (``with_timers``).
    """
    rows = frames.select("video", "frame", "t", "at", "last").withWatermark("at", delay)
    return rows.groupBy("video").transformWithStateInPandas(Resampler(fps, round(patience * 1000)), T.StructType.fromDDL(COPIES), "Append", "EventTime")


@contextmanager
def with_timers(spark: SparkSession):
    """Streams started inside keep their state where timers are at hand."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
