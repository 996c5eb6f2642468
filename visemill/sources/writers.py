"""Sinks: manifests, subtitles, reports."""

from __future__ import annotations

import io
import tarfile
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import srt_time
from ..operators.ordering import cut


def finite(x: Column) -> Column:
    """Null for NaN and infinities, which JSON cannot hold."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_numbers(rows: DataFrame) -> DataFrame:
    return rows.select([finite(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in rows.dtypes])


def write_report(rows: DataFrame, path: str) -> None:
    finite_numbers(rows).write.mode("overwrite").json(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_keys(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Put ``rows`` into the Parquet table at ``path`` in place of all that it holds of their keys.

    The table is dealt to folders by a hash of the key; only folders that hold such a key are read and written anew.
    """
    spark = rows.sparkSession
    bucket = bucket_of(key, buckets)
    new = rows.withColumn("_bucket", bucket)
    if folder_exists(spark, path):
        keys = rows.select(key).distinct()
        touched = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        kept = spark.read.parquet(path).filter(F.col("_bucket").isin(touched)).join(keys, key, "left_anti")
        new = cut(new.unionByName(kept, allowMissingColumns=True))
    new.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def write_manifests(utt: DataFrame, path: str, key: str = "video_stem") -> None:
    """Append manifest rows as a batch of their own under ``path``/rows, then the markers (video_stem, n_utts) of its videos
    under ``path``/done.

    Nothing is rewritten: a video that comes again is read from the batch of its newest marker. A write that breaks off
    leaves no marker, so what was there before stays in force and the batch is to be written again. One writer at a time.
    """
    batch = f"{time.time_ns():020d}"
    utt = cut(utt)
    utt.write.parquet(f"{path}/rows/_batch={batch}")
    utt.groupBy(key).agg(F.count("*").alias("n_utts")).write.parquet(f"{path}/done/_batch={batch}")


def done_videos(spark: SparkSession, path: str, key: str = "video_stem") -> DataFrame:
    """(video_stem, n_utts, _batch): the newest marker of each video."""
    markers = spark.read.schema(f"{key} {spark.read.parquet(f'{path}/done').schema[key].dataType.simpleString()}, n_utts long, _batch string").parquet(f"{path}/done")
    return markers.groupBy(key).agg(F.max_by("n_utts", "_batch").alias("n_utts"), F.max("_batch").alias("_batch"))


def read_done_manifests(spark: SparkSession, path: str, key: str = "video_stem") -> DataFrame:
    """Rows of the videos that are done, as last written."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows").withColumn("_batch", F.lpad(F.col("_batch").cast("string"), 20, "0"))
    return rows.join(done_videos(spark, path, key).select(key, "_batch"), [key, "_batch"], "left_semi").drop("_batch")


def srt_cues(segments: DataFrame) -> DataFrame:
    """(video, n, cue): numbered cues of ``segments(video, start, end, text)`` with text; white space collapsed."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = segments.withColumn("_t", text).filter("_t <> ''").withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("start", "end")))
    return rows.select("video", "n", F.concat_ws("\r\n", F.col("n").cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end"))), "_t", F.lit("")).alias("cue"))


def write_srt(segments: DataFrame, path: str) -> None:
    """One subtitle text for each video, under ``video=...`` folders."""
    cues = srt_cues(segments).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("n", "cue"))).alias("c"))
    lines = cues.select("video", F.array_join(F.transform("c", lambda x: x["cue"]), "\r\n").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").partitionBy("video").text(path)


def write_sidecar(segments: DataFrame, path: str) -> None:
    """Segments of each video as one JSON record, times rounded to milliseconds."""
    rounded = segments.select([F.round(n, 3).alias(n) if t == "double" else F.col(n) for n, t in segments.dtypes])
    rest = [c for c in rounded.columns if c != "video"]
    rounded.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in rest if c != "start"]))).alias("segments")).write.mode("overwrite").json(path)


def feature_bytes(rows: DataFrame, most: int = 1 << 22) -> DataFrame:
    """``rows`` with ``content``, that of a feature file (npz), in place of lm and cue (landmarks of frames x 40 x 2 and cues of frames x 8,
    flattened), valid (flags) and audio (16-bit sound); handed back in parts of about ``most`` bytes."""
    parts = ["lm", "cue", "valid", "audio"]
    kept = [c for c in rows.columns if c not in parts]

    def one(points, cues, flags, samples) -> bytes:
        n, out = len(flags), io.BytesIO()
        np.savez(out, lm=points.astype(np.float32).reshape(n, 40, 2), cue=cues.astype(np.float32).reshape(n, len(cues) // max(n, 1)), valid=flags.astype(np.uint8), audio=samples.astype(np.int16))
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, made, first = [b.column(c) for c in parts], [], 0
            for k in range(b.num_rows):
                made.append(one(*(c[k].values.to_numpy(zero_copy_only=False) for c in columns)))
                if k == b.num_rows - 1 or sum(map(len, made)) >= most:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(made)) for c in kept), pa.array(made, pa.binary())], names=[*kept, "content"])
                    made, first = [], k + 1

    return rows.select(*kept, *parts).mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("content", T.BinaryType())]))


@F.pandas_udf(T.BinaryType())
def archive_bytes(members: pd.Series) -> pd.Series:
    """The content of a tar archive of members (name, content), in the order given."""

    def one(parts) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for p in parts:
                info = tarfile.TarInfo(p["name"])
                info.size = len(p["content"])
                tar.addfile(info, io.BytesIO(p["content"]))
        return out.getvalue()

    return members.map(one)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each of ``rows(name, content)`` as a file of its own into a shared folder; how many there were. A task that is run
    again writes the same files again."""
    where = folder if "://" in folder or folder.startswith("/") else folder.replace(":/", ":///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = pafs.FileSystem.from_uri(where)
        system.create_dir(at, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content")):  # one content at a time leaves the batch
                with system.open_output_stream(f"{at}/{name.as_py()}") as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_alignments(records: DataFrame, path: str, most: int = 1 << 22) -> None:
    """Alignment records as files of JSON arrays: as many successive records to a file as have ``most`` characters, one at least."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        n = 0
        for b in batches:
            for record in b["value"]:
                if held and n + len(record) > most:
                    yield pd.DataFrame({"value": [f"[{','.join(held)}]"]})
                    held, n = [], 0
                held.append(record)
                n += len(record)
        if held:
            yield pd.DataFrame({"value": [f"[{','.join(held)}]"]})

    lines = records.select(F.to_json(F.struct(*records.columns)).alias("value"))
    lines.mapInPandas(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)
