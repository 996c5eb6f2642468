"""Manifests: pairing, resuming, merging parts, checking files, splits, subsets, shards and batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .ordering import global_row_number, grouped_row_number, hash_order


# ---------------------------------------------------------------- joins
def pair_with_media(label_rows: DataFrame, media: DataFrame, on: str = "video_stem") -> tuple[DataFrame, DataFrame]:
    """Labels with their media, and the labels without any."""
    return label_rows.join(media, on), label_rows.join(media, on, "left_anti")


def to_do(jobs: DataFrame, done: DataFrame, on: str = "video_stem") -> DataFrame:
    """Jobs without a done marker."""
    return jobs.join(done.select(on).distinct(), on, "left_anti")


def merge_parts(parts: DataFrame, destination: DataFrame) -> DataFrame:
    """Class of each (part, video_stem): 'merged' from the first part that has it finished, 'already' at the destination,
    'duplicate' of an earlier part, 'unfinished', 'repair' where the destination's copy is damaged.

    ``parts(part, part_order, video_stem, finished)``; ``destination(video_stem, healthy)``.
    """
    first = F.row_number().over(Window.partitionBy("video_stem", "finished").orderBy("part_order"))
    rows = parts.withColumn("_n", first).join(destination, "video_stem", "left")
    kind = F.when(~F.col("finished"), "unfinished").when(F.col("_n") > 1, "duplicate").when(F.col("healthy"), "already").when(~F.col("healthy"), "repair").otherwise("merged")
    return rows.withColumn("class", kind).drop("_n")


def missing_files(rows: DataFrame, paths: list[str], files: DataFrame) -> DataFrame:
    """(video_stem, utt_id, rel_path, problem) for each file that a row names and that is missing or empty."""
    named = rows.select("video_stem", "utt_id", F.explode(F.array(*paths)).alias("rel_path"))
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty")
    return named.join(files.select("rel_path", "size"), "rel_path", "left").withColumn("problem", problem).filter("problem is not null").select("video_stem", "utt_id", "rel_path", "problem")


def copy_plan(source: DataFrame, destination: DataFrame, digest: str | None = None) -> DataFrame:
    """Files of ``source(video_stem, rel_path, size)`` that ``destination`` lacks or has otherwise, the done marker of a
    video last and only if another of its files must go or it is itself missing."""
    there = destination.select("rel_path", F.col("size").alias("_size"), *([F.col(digest).alias("_digest")] if digest else []))
    same = F.col("size") == F.col("_size")
    if digest:
        same &= F.col(digest) == F.col("_digest")
    rows = source.join(there, "rel_path", "left").withColumn("copy", ~F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("last", F.col("rel_path").endswith(".done"))
    any_other = F.max(F.col("copy") & ~F.col("last")).over(Window.partitionBy("video_stem"))
    rows = rows.withColumn("_other", any_other).filter(F.col("copy") | (F.col("last") & F.col("_other")))
    return rows.select("video_stem", "rel_path", "size", F.row_number().over(Window.partitionBy("video_stem").orderBy("last", "rel_path")).alias("step"))


# ---------------------------------------------------------------- splits and reports
def assign_split(utt: DataFrame, val: Iterable[str], test: Iterable[str], train_dirs: Iterable[str], **limits) -> DataFrame:
    """``utt`` with split (train, val, test or null) and drop_reason (null where kept)."""
    split, reason = labels.drop_reason(**{c: F.col(c) for c in ("has_unk", "n_frames", "duration", "angle", "speaker", "split_dir")}, val=val, test=test, train_dirs=train_dirs, **limits)
    return utt.withColumn("split", split).withColumn("drop_reason", reason)


def split_report(rows: DataFrame, main_angle: str = "A") -> DataFrame:
    """Per split: utterances kept, hours over all angles, hours of the main angle (unique sound)."""
    hours = F.sum("duration") / 3600
    unique = F.coalesce(F.sum(F.when(F.col("angle") == main_angle, F.col("duration"))), F.lit(0.0)) / 3600
    return rows.groupBy("split").agg(F.count("*").alias("n_all"), F.count_if(F.col("drop_reason").isNull()).alias("n_kept"), hours.alias("hours"), unique.alias("hours_main"))


def storage_status(rows: DataFrame, paths: list[str], files: DataFrame, by: str = "split_dir") -> DataFrame:
    """By ``by``: utterances, seconds, and of the files that they name those there, their bytes, and those missing or empty."""
    named = rows.select(by, F.explode(F.array(*paths)).alias("rel_path")).join(files.select("rel_path", "size"), "rel_path", "left")
    there = F.coalesce(F.col("size") > 0, F.lit(False))
    stored = named.groupBy(by).agg(F.count_if(there).alias("files"), F.sum(F.when(there, F.col("size")).otherwise(0)).alias("bytes"), F.count_if(~there).alias("missing"))
    return rows.groupBy(by).agg(F.count("*").alias("utts"), F.sum("duration").alias("seconds")).join(stored, by)


# ---------------------------------------------------------------- subsets, shards, batches
def even_subset(rows: DataFrame, n: int, key: str = "utt_id") -> DataFrame:
    """At most ``n`` rows, evenly spread over the order of ``key``: those at floor(i * total / n)."""
    numbered = global_row_number(rows, [F.col(key)], "_at")
    total = rows.count()
    if n <= 0 or n >= total:
        return rows
    # the place p is taken by some i exactly if the next multiple of total / n from p on lies below p + 1
    i = F.ceil(F.col("_at") * n / F.lit(total))
    return numbered.filter((i < n) & (F.floor(i * (total / n)) == F.col("_at"))).drop("_at")


def shard(rows: DataFrame, k: int, n: int, key: str = "video_stem") -> DataFrame:
    """Shard k (from 1) of n: every n-th row in the order of ``key``."""
    return global_row_number(rows, [F.col(key)], "_at").filter(F.col("_at") % n == k - 1).drop("_at")


def stride_sample(rows: DataFrame, cell: list[str], per_cell: int, key: str = "utt_id") -> DataFrame:
    """About ``per_cell`` rows of each cell, evenly spread over ``key``."""
    numbered = grouped_row_number(rows, cell, [F.col(key)], "_at", "_size")
    step = F.greatest(F.floor(F.col("_size") / per_cell), F.lit(1))
    return numbered.filter((F.col("_at") % step == 0) & (F.col("_at") < step * per_cell)).select(*rows.columns)


def speaker_sample(rows: DataFrame, n: int, seed: int, key: str = "utt_id") -> DataFrame:
    """``n`` rows shared out over speakers (one more for the first n mod speakers), picked by hash."""
    speakers = rows.select("speaker").distinct()
    total = speakers.count()
    quota = global_row_number(speakers, [F.col("speaker")], "_s").withColumn("_quota", F.lit(n // max(total, 1)) + (F.col("_s") < n % max(total, 1)).cast("int"))
    picked = grouped_row_number(rows, ["speaker"], [hash_order(F.lit(seed), F.col(key)), F.col(key)], "_pick", "_size")
    return picked.join(quota, "speaker").filter("_pick < _quota").select(*rows.columns)


def greedy_cuts(histogram: list[tuple[int, int]], budget: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """How rows sorted by length fall into batches, one entry a length: (length, first position, batch that is open, rows
    that still go there, first new batch, rows of a new batch); and the number of batches.

    A batch takes rows while rows times the longest stay within ``budget``; a longer row is a batch.
    """
    out, at, batches, held = [], 0, 0, 0
    for value, count in histogram:
        room = max(1, budget // max(value, 1))
        joins = min(count, max(0, room - held)) if held and value <= budget else 0
        fresh = count - joins
        out.append((value, at, batches - 1, joins, batches, room))
        if fresh:
            batches += -(-fresh // room)
            held = fresh - (fresh - 1) // room * room
        else:
            held += joins
        held = held if value <= budget else 0
        at += count
    return out, batches


def length_batches(rows: DataFrame, length: str, budget: int, key: str, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Batches of rows of like length: sorted by length, each as large as size * longest <= ``budget`` lets it be; a
    longer row stands alone. Adds batch (in length order) and batch_order (shuffled by a hash of seed and epoch).

    The greedy cut depends on lengths alone, so the driver makes it on their histogram, one entry a length; rows find their
    batch by position and division.
    """
    histogram = sorted((r[0], r[1]) for r in rows.groupBy(length).count().collect())
    cuts, n = greedy_cuts(histogram, budget)
    spark = rows.sparkSession
    kinds = spark.createDataFrame(cuts, "_value long, _at0 long, _open long, _joins long, _fresh long, _room long").withColumn("_value", F.col("_value").cast(rows.schema[length].dataType))
    placed = global_row_number(rows, [F.col(length), F.col(key)], "_at").join(kinds, F.col(length) == F.col("_value"))
    r = F.col("_at") - F.col("_at0")
    batch = F.when(r < F.col("_joins"), F.col("_open")).otherwise(F.col("_fresh") + F.floor((r - F.col("_joins")) / F.col("_room")))
    out = placed.withColumn("batch", batch.cast("int"))
    numbers = spark.range(n).select(F.col("id").cast("int").alias("batch"))
    order = global_row_number(numbers, [hash_order(F.lit(seed), F.lit(epoch), F.col("batch")), F.col("batch")], "batch_order")
    return out.join(order, "batch").select(*rows.columns, "batch", "batch_order")


def shuffled_batches(rows: DataFrame, size: int, key: str, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Full batches of ``size`` rows in a hash order of seed and epoch; the incomplete last one is dropped."""
    numbered = global_row_number(rows, [hash_order(F.lit(seed), F.lit(epoch), F.col(key)), F.col(key)], "_at")
    total = rows.count() // size * size
    return numbered.filter(F.col("_at") < total).withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def first_seen_ids(rows: DataFrame, batch: str, position: str, key: str) -> DataFrame:
    """0-based ids of keys by first appearance within each batch."""
    seen = F.min(position).over(Window.partitionBy(batch, key))
    return rows.withColumn("_seen", seen).withColumn("dense_id", F.dense_rank().over(Window.partitionBy(batch).orderBy("_seen")) - 1).drop("_seen")


def pad_batches(rows: DataFrame, batch: str, values: str, pad: Column) -> DataFrame:
    """Arrays lengthened with ``pad`` to the longest of their batch; ``length`` keeps their own."""
    longest = F.max(F.size(values)).over(Window.partitionBy(batch))
    padded = F.concat(F.col(values), F.array_repeat(pad, longest - F.size(values)))
    return rows.withColumn("length", F.size(values)).withColumn(values, padded)

