"""Readers: label documents, media, manifests, features, logs, alignments; bad input becomes rows with a reason."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import bbox_order, parse_duration, parse_resolution, parse_stem, reorder_boxes

LABEL = """Video_info struct<video_Name:string,video_Format:string,video_Duration:string,FPS:double,Resolution:string>,
Audio_info struct<Audio_Name:string,Audio_Format:string,Audio_Duration:string,Sampling_rate:string>, Audio_env struct<Noise:int>,
Video_env struct<env:string,Angle:string>, Sentence_info array<struct<ID:int,topic:string,sentence_text:string,start_time:double,end_time:double>>,
speaker_info struct<speaker_ID:string,Specificity:string,Gender:string,Age:int,Accent:string>,
Bounding_box_info struct<Face_bounding_box:struct<xtl_ytl_xbr_ybr:array<array<int>>>,Lip_bounding_box:struct<xtl_ytl_xbr_ybr:array<array<int>>>>"""
REQUIRED = ("utt_id", "video_stem", "split_dir", "speaker", "angle", "n_frames", "duration", "text", "has_unk", "npz", "mouth_mp4")
UTTERANCE = """utt_id string, video_stem string, split_dir string, speaker string, gender string, age int, specificity string, angle string, session string, noise_env int, topic string,
sentence_id int, start double, end double, duration double, n_frames int, n_samples int, fps double, time_shift double, text string, text_raw string, has_unk boolean, lm_valid_ratio double, mouth_mp4 string, npz string"""
PROCESS = "stem string, ok boolean, n_utts int, n_sentences int, frames long, valid_ratio double, speaker string, angle string, fps double, time_shift double, shift_gain_db double, decoder string, t_total double, error string"
METRIC = "time double, type string, epoch int, step int, loss double, ctc double, lr double, `av/cer` double, `audio/cer` double, `video/cer` double"
ALIGNMENT = """utt_id string, speaker string, angle string, split string, fps double, n_frames int, start double, duration double, ok boolean, error string, path_logprob double, greedy_cer double,
syllables array<struct<char:string,word:int,start_s:double,end_s:double,ext_end_s:double,ext_capped:boolean,logprob:double,tokens:array<struct<id:int,name:string,start_s:double,end_s:double,logprob:double,ext_end_s:double>>>>"""


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(videos, rejects) of label documents, each a JSON list of one entry (a byte-order mark is allowed).

    videos: path, stem, its fields, duration_s, resolution, sentences in order of start, boxes as x0, y0, x1, y1.
    rejects: path and reason, for lists of another length and unequal numbers of face and lip boxes.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    docs = files.select("path", F.from_json("value", f"array<struct<{LABEL.replace(chr(10), ' ').replace(' struct<', ': struct<').replace(' array<struct<ID', ': array<struct<ID')}>>").alias("docs"))
    face, lip = F.col("d.Bounding_box_info.Face_bounding_box.xtl_ytl_xbr_ybr"), F.col("d.Bounding_box_info.Lip_bounding_box.xtl_ytl_xbr_ybr")
    rows = docs.withColumn("d", F.get("docs", F.lit(0)))
    reason = F.when(F.col("docs").isNull() | F.col("d.Video_info").isNull(), "not a label document").when(F.size("docs") != 1, "list of another length than one").when(F.coalesce(F.size(face), F.lit(-1)) != F.coalesce(F.size(lip), F.lit(-1)), "face and lip boxes differ in number")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null")
    size = parse_resolution(F.col("d.Video_info.Resolution"))
    order = bbox_order(F.concat(face, lip), size["width"], size["height"])
    stem = F.regexp_replace(F.col("d.Video_info.video_Name"), r"\.[^.]*$", "")
    sentences = F.array_sort(F.transform(F.coalesce("d.Sentence_info", F.array()), lambda s: F.struct(s["start_time"].alias("start_s"), s["end_time"].alias("end_s"), s["ID"].alias("sentence_id"), F.coalesce(s["topic"], F.lit("")).alias("topic"), s["sentence_text"].alias("text"))))
    videos = good.select(
        "path", stem.alias("video_stem"), parse_stem(stem).alias("fields"), parse_duration(F.col("d.Video_info.video_Duration")).alias("duration_s"), F.col("d.Video_info.FPS").alias("fps"), size.alias("resolution"), F.coalesce("d.Audio_env.Noise", F.lit(0)).alias("noise_env"),
        F.col("d.speaker_info").alias("speaker"), sentences.alias("sentences"), reorder_boxes(face, order).alias("face_boxes"), reorder_boxes(lip, order).alias("lip_boxes"),
    )
    return videos, rows.filter("reason is not null").select("path", "reason")


def explode_sentences(videos: DataFrame) -> DataFrame:
    return videos.select("video_stem", F.explode("sentences").alias("s")).select("video_stem", "s.*")


def media_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, stem, ext, path, size, offset) of media files below ``path`` and of the members of tar archives there.

    A task opens an archive by its path and leaps from header to header, so archives may be of any size. ``offset`` is null
    for plain files and sparse members. Of one key the last path stays.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    split = lambda p: (F.regexp_extract(p, r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1)).alias("ext"))
    plain = meta.filter(F.lower("path").rlike(r"\.(mp4|wav)$")).select(*split(F.col("path")), "path", "size", F.lit(None).cast("long").alias("offset"))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where in b["path"]:
                system, at = pafs.FileSystem.from_uri(where)
                with system.open_input_file(at) as archive, tarfile.open(fileobj=archive, mode="r:") as tar:
                    rows = [(f"{where}!{m.name}", m.size, None if m.sparse else m.offset_data) for m in tar if m.isfile()]
                yield pd.DataFrame(rows, columns=["path", "size", "offset"]).astype({"offset": "Int64"})

    tars = meta.filter(F.lower("path").endswith(".tar")).select("path").repartition("path")
    inside = tars.mapInPandas(members, "path string, size long, offset long").filter(F.lower("path").rlike(r"\.(mp4|wav)$")).select(*split(F.col("path")), "path", "size", "offset")
    both = plain.unionByName(inside).withColumn("key", F.concat("stem", "ext"))
    return both.groupBy("key").agg(F.max_by(F.struct("stem", "ext", "path", "size", "offset"), "path").alias("m")).select("key", "m.*")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of JSON-lines shards: malformed lines, missing required keys, repeated utt_id; blank lines pass."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("shard"), "value")
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(keys, F.array().cast("array<string>")))
    rows = lines.withColumn("row", F.from_json("value", UTTERANCE, {"mode": "PERMISSIVE"})).withColumn("keys", keys).withColumn("missing", missing)
    reason = F.when(F.col("keys").isNull(), "invalid JSON").when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select("shard", "row.*")
    twice = good.groupBy("utt_id").agg(F.count("*").alias("n"), F.max("shard").alias("shard")).filter("n > 1")
    problems = rows.filter("reason is not null").select("shard", F.col("value").alias("what"), "reason").union(twice.select("shard", "utt_id", F.lit("duplicate utt_id")))
    return good, problems


def parts_by_size(content: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(first, n): successive rows of a batch with up to ``most`` bytes of content, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(content), 0))
    first, n = 0, 0
    for k, s in enumerate(size.tolist()):
        if k > first and n + s > most:
            yield first, k - first
            first, n = k, 0
        n += s
    if len(size):
        yield first, len(size) - first


FEATURES = "path string, lm array<float>, cue array<float>, valid array<int>, audio array<short>, fps double, sr long, n_frames int, reason string"


def read_features(spark: SparkSession, path: str, fps: float = 30.0, sr: int = 16000) -> DataFrame:
    """Arrays of npz feature files, flattened; ``reason`` tells what is wrong with a bad file, whose arrays are null."""

    def arrays(where: str, content: bytes) -> tuple:
        try:
            with np.load(io.BytesIO(content)) as z:
                lm, cue, valid, audio = z["lm"], z["cue"], z["valid"], z["audio"]
                if lm.ndim != 3 or lm.shape[1:] != (40, 2) or cue.shape != (len(lm), 8) or valid.shape != (len(lm),):
                    raise ValueError(f"shapes {lm.shape}, {cue.shape}, {valid.shape}")
                if audio.ndim != 1 or audio.dtype != np.int16:
                    raise ValueError(f"audio {audio.dtype} of {audio.ndim} dimensions")
                return where, lm.astype(np.float32).ravel(), cue.astype(np.float32).ravel(), valid.astype(np.int32), audio, float(z["fps"]) if "fps" in z else fps, int(z["sr"]) if "sr" in z else sr, len(lm), None
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told in its row
            return where, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    made = pa.schema([
        ("path", pa.string()), ("lm", pa.list_(pa.float32())), ("cue", pa.list_(pa.float32())), ("valid", pa.list_(pa.int32())), ("audio", pa.list_(pa.int16())),
        ("fps", pa.float64()), ("sr", pa.int64()), ("n_frames", pa.int32()), ("reason", pa.string()),
    ])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in parts_by_size(b.column("content")):
                part = b.slice(first, n)
                out = [arrays(where.as_py(), content.as_py()) for where, content in zip(part.column("path"), part.column("content"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), made)], schema=made)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(load, FEATURES)


def check_content(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of npz files whose members fail their checksum and mp4 files without the ftyp mark; null if sound."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    videos = raw.filter(F.col("path").endswith(".mp4")).select("path", F.when(F.substring("content", 5, 4) != F.lit(b"ftyp"), "no ftyp").alias("problem"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for content in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        bad = z.testzip()
                        found.append(f"damaged member {bad}" if bad else None if z.namelist() else "empty archive")
                except zipfile.BadZipFile:
                    found.append("not an archive")
            yield pd.DataFrame({"path": b["path"], "problem": found})

    arrays = raw.filter(F.col("path").endswith(".npz")).select("path", "content").mapInPandas(test, "path string, problem string")
    return videos.union(arrays)


def read_process_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a processing log, with the line's place; lines that are no JSON objects are left out."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    return lines.withColumn("r", F.from_json("value", PROCESS)).filter("r.stem is not null").select("line", "r.*")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", METRIC).alias("r")).select("r.*").filter("type is not null")


CONSOLE = r"step\s+(\d+).*?ctc\s+([-\d.eE+]+).*?lr\s+([-\d.eE+]+).*?gnorm\s+([-\d.eE+]+).*?([-\d.]+)\s*fr/s"


def read_console(spark: SparkSession, path: str) -> DataFrame:
    """step, ctc, lr, gnorm and frames a second of the progress lines of a console log."""
    lines = spark.read.text(path).filter(F.col("value").rlike(CONSOLE))
    return lines.select(*[F.regexp_extract("value", CONSOLE, k + 1).cast("long" if n == "step" else "double").alias(n) for k, n in enumerate(("step", "ctc", "lr", "gnorm", "frames_per_s"))])


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of JSON arrays, nested as they are."""
    return spark.read.schema(ALIGNMENT).option("multiLine", "true").json(path)


def explode_syllables(records: DataFrame) -> DataFrame:
    return records.filter("ok").select("utt_id", "speaker", "split", F.posexplode("syllables").alias("pos", "s")).select("utt_id", "speaker", "split", "pos", "s.*")


def explode_tokens(records: DataFrame) -> DataFrame:
    rows = explode_syllables(records).select("utt_id", F.col("pos").alias("syllable"), F.posexplode("tokens").alias("pos", "t"))
    return rows.select("utt_id", "syllable", "pos", "t.*")
