import datetime
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from visemill.sources import readers as R
from visemill.sources import writers as W
from visemill.streaming import jobs as J


def label(stem="lip_J_1_F_02_C001_A_003", boxes=((10, 20, 30, 40),), lips=None, sentences=2):
    return {
        "Video_info": {"video_Name": f"{stem}.mp4", "video_Format": "MP4", "video_Duration": "0:05:08", "FPS": 30.0, "Resolution": "1920*1080"},
        "Audio_env": {"Noise": 2}, "Video_env": {"env": "in", "Angle": "A"}, "speaker_info": {"speaker_ID": "C001", "Gender": "F", "Age": 30},
        "Sentence_info": [{"ID": k, "topic": "t", "sentence_text": f"s{k}", "start_time": 10.0 - k, "end_time": 10.5 - k} for k in range(sentences)],
        "Bounding_box_info": {"Face_bounding_box": {"xtl_ytl_xbr_ybr": [list(b) for b in boxes]}, "Lip_bounding_box": {"xtl_ytl_xbr_ybr": [list(b) for b in (boxes if lips is None else lips)]}},
    }


def test_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([label()]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([label(), label()]))
    (tmp_path / "c.json").write_text(json.dumps([label(lips=())]))
    (tmp_path / "d.json").write_text(json.dumps([label("lip_K_1_F_02_C001_A_003", boxes=[(10, 20, 1900, 1000)])]))
    videos, rejects = R.read_labels(spark, str(tmp_path))
    got = {r.video_stem: r for r in videos.collect()}
    assert sorted(got) == ["lip_J_1_F_02_C001_A_003", "lip_K_1_F_02_C001_A_003"]
    first = got["lip_J_1_F_02_C001_A_003"]
    assert first.duration_s == 308 and first.noise_env == 2 and first.fields.speaker == "C001"
    assert [s.sentence_id for s in first.sentences] == [1, 0]
    assert first.face_boxes == [[20, 10, 40, 30]] and got["lip_K_1_F_02_C001_A_003"].face_boxes == [[10, 20, 1900, 1000]]
    assert sorted(r.reason for r in rejects.collect()) == ["face and lip boxes differ in number", "list of another length than one"]
    assert R.explode_sentences(videos).count() == 4


def test_media(spark, tmp_path):
    (tmp_path / "x.MP4").write_bytes(b"1234")
    (tmp_path / "note.txt").write_bytes(b"-")
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        for name, data in (("d/y.wav", b"abc"), ("d/z.txt", b"-")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {r.key: r for r in R.media_index(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["x.mp4", "y.wav"] and got["x.mp4"].size == 4 and got["y.wav"].size == 3
    raw = (tmp_path / "t.tar").read_bytes()
    assert raw[got["y.wav"].offset : got["y.wav"].offset + 3] == b"abc"


def test_manifests(spark, tmp_path):
    row = {k: "x" for k in R.REQUIRED} | {"n_frames": 3, "duration": 1.0, "has_unk": False}
    lines = [json.dumps(row | {"utt_id": "a"}), "", "{broken", json.dumps({"utt_id": "b"}), json.dumps(row | {"utt_id": "a"}), json.dumps(row | {"utt_id": "c"})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    good, problems = R.read_manifests(spark, str(tmp_path))
    assert sorted(r.utt_id for r in good.collect()) == ["a", "a", "c"]
    reasons = sorted(r.reason for r in problems.collect())
    assert reasons[0] == "duplicate utt_id" and reasons[1] == "invalid JSON" and reasons[2].startswith("missing ")


def test_features_and_content(spark, tmp_path):
    good = dict(lm=np.zeros((4, 40, 2), np.float16), cue=np.ones((4, 8), np.float16), valid=np.ones(4, np.uint8), audio=np.arange(9, dtype=np.int16))
    np.savez(tmp_path / "a.npz", **good, fps=25.0, sr=16000)
    np.savez(tmp_path / "b.npz", **(good | {"cue": np.ones((3, 8))}))
    np.savez(tmp_path / "c.npz", **good)
    (tmp_path / "d.npz").write_bytes(b"junk")
    (tmp_path / "e.mp4").write_bytes(b"\0\0\0\x18ftypisom")
    (tmp_path / "f.mp4").write_bytes(b"\0\0\0\x18nope")
    got = {r.path[-5:]: r for r in R.read_features(spark, str(tmp_path)).collect()}
    assert got["a.npz"].n_frames == 4 and got["a.npz"].fps == 25 and got["c.npz"].fps == 30 and got["a.npz"].audio == list(range(9))
    assert got["b.npz"].lm is None and "shapes" in got["b.npz"].reason and got["d.npz"].reason
    problems = {r.path[-5:]: r.problem for r in R.check_content(spark, str(tmp_path)).collect()}
    assert problems["a.npz"] is None and problems["d.npz"] == "not an archive" and problems["e.mp4"] is None and problems["f.mp4"] == "no ftyp"


def test_logs(spark, tmp_path):
    (tmp_path / "p").write_text('{"stem": "a", "ok": false}\nnot json\n{"stem": "a", "ok": true, "frames": 5}\n')
    log = R.read_process_log(spark, str(tmp_path / "p"))
    assert log.count() == 2 and log.orderBy(F.desc("line")).first().ok
    (tmp_path / "m").write_text('{"type": "val", "epoch": 1, "av/cer": 0.5}\n\n')
    assert R.read_metrics(spark, str(tmp_path / "m")).first()["av/cer"] == 0.5
    (tmp_path / "c").write_text("hello\nepoch 1 step 120 loss 2 ctc 1.5 lr 1e-4 gnorm 3.2 | 900 fr/s\n")
    assert tuple(R.read_console(spark, str(tmp_path / "c")).first()) == (120, 1.5, 1e-4, 3.2, 900.0)


def test_alignments(spark, tmp_path):
    token = {"id": 6, "name": "L:x", "start_s": 0.0, "end_s": 0.1, "logprob": -0.1, "ext_end_s": 0.2}
    rec = {"utt_id": "u", "ok": True, "syllables": [{"char": "x", "start_s": 0.0, "end_s": 0.2, "tokens": [token, token]}]}
    (tmp_path / "a.json").write_text(json.dumps([rec, {"utt_id": "v", "ok": False, "syllables": []}]))
    records = R.read_alignments(spark, str(tmp_path / "a.json"))
    assert records.count() == 2 and R.explode_syllables(records).count() == 1 and R.explode_tokens(records).count() == 2


def test_subtitles_and_reports(spark, tmp_path):
    rows = [("v", 1.0, 2.0, " a  b ", float("nan")), ("v", 0.5, 0.9, "", 1.0), ("v", 3.0, 4.0, "c", float("inf"))]
    df = spark.createDataFrame(rows, "video string, start double, end double, text string, snr double")
    W.write_srt(df.drop("snr"), str(tmp_path / "srt"))
    [name] = list((tmp_path / "srt" / "video=v").glob("*.txt"))
    assert name.read_bytes() == b"1\r\n00:00:01,000 --> 00:00:02,000\r\na b\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nc\r\n\r\n"
    assert [r.snr for r in W.finite_numbers(df).orderBy("start").collect()] == [1.0, None, None]
    W.write_report(df, str(tmp_path / "r"))
    W.write_sidecar(df.select("video", "start", "end", "text"), str(tmp_path / "j"))
    assert [s.text for s in spark.read.json(str(tmp_path / "j")).first().segments] == ["", " a  b ", "c"]


def test_manifest_writer_replaces_videos_and_marks_last(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "m")
    write = lambda rows: W.write_manifests(spark.createDataFrame(rows, "video_stem string, split_dir string, n int"), out)
    write([("v1", "O", 1), ("v2", "O", 1), ("v2", "O", 2), ("v3", "P", 1)])
    write([("v3", "O", 7), ("v4", "P", 1)])
    read = lambda: sorted(map(tuple, W.read_done_manifests(spark, out).collect()))
    first = [("v1", "O", 1), ("v2", "O", 1), ("v2", "O", 2), ("v3", "O", 7), ("v4", "P", 1)]
    assert read() == first
    write([("v3", "O", 7), ("v4", "P", 1)])
    assert read() == first
    assert sorted((r.video_stem, r.n_utts) for r in W.done_videos(spark, out).collect()) == [("v1", 1), ("v2", 2), ("v3", 1), ("v4", 1)]
    count = F.count
    monkeypatch.setattr(W.F, "count", lambda *_: 1 / 0)  # breaks off between rows and markers
    with pytest.raises(ZeroDivisionError):
        write([("v2", "O", 9), ("v5", "O", 1)])
    monkeypatch.setattr(W.F, "count", count)
    assert read() == first  # rows without a marker don't count
    write([("v2", "O", 9)])
    assert ("v2", "O", 9) in read() and len(read()) == 4
    W.write_manifests(spark.createDataFrame([("v1", "O", 1, 2.0)], "video_stem string, split_dir string, n int, more double"), out)
    assert ("v1", "O", 1, 2.0) in read() and len(read()) == 4


def test_archives_are_indexed_by_their_headers(spark, tmp_path):
    with open(tmp_path / "big.tar", "wb") as f:  # a hole of 3 GB stands for a film
        for name, size in (("a/film.mp4", 3 << 30), ("b/next.wav", 4)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(format=tarfile.GNU_FORMAT))
            f.seek(-(-size // 512) * 512, 1)
        f.write(bytes(1024))
    got = {r.key: r for r in R.media_index(spark, str(tmp_path)).collect()}
    assert got["film.mp4"].size == 3 << 30 and got["film.mp4"].offset == 512 and got["next.wav"].offset == 512 * 2 + (3 << 30)


def test_ingest_and_status_streams(spark, tmp_path):
    schema = "stem string, n int, ok boolean, at timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    feed([("a", 1, False, day(1)), ("b", 1, True, day(2)), ("b", 1, True, day(2))])
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    kept, late, added = [], [], []
    for rows in ([], [("a", 2, True, day(2)), ("c", 1, False, day(9))], [], [("d", 1, True, day(20)), ("late", 1, True, day(8))], [("late", 1, True, day(3)), ("e", 1, True, day(21))], []):
        if rows:
            feed(rows)
        run = J.ingest(stream(), "stem", "at", "5 days", str(tmp_path / "rows"), str(tmp_path / "c1"))
        run.awaitTermination()
        kept.append(max([op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]], default=0))
        late.append(J.rows_too_late(run))
        added.append(spark.read.parquet(str(tmp_path / "rows")).count())
        J.latest_status(stream(), "stem", ["n"], str(tmp_path / "status"), str(tmp_path / "c2"), buckets=5).awaitTermination()
    assert added == [2, 3, 3, 5, 6, 6] and sum(late) == 1  # day 3 is before the watermark of day 15
    assert sorted(r.stem for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["a", "b", "c", "d", "e", "late"]
    assert max(kept) <= 5  # keys that the watermark has passed are forgotten
    assert {r.stem: r.ok for r in J.current_status(spark, str(tmp_path / "status")).collect()} == {"a": True, "b": True, "c": False, "d": True, "e": True, "late": True}


def grid(times, fps):
    """Copies of every frame for a constant or varying rate, by definition: the nearest frame to each grid time."""
    end = times[-1] + (times[-1] - times[-2])
    out = [0] * len(times)
    for k in range(int(np.ceil((end - 1e-6) * fps))):
        out[int(np.argmin([abs(t - k / fps) - 1e-9 * i for i, t in enumerate(times)]))] += 1
    return out


@pytest.mark.parametrize("src,dst,n", [(30, 30, 10), (25, 30, 50), (60, 30, 60)])
def test_resampler(spark, src, dst, n):
    times = [k / src for k in range(n)]
    told, now = J.grid_copies(np.arange(n), np.array(times), dst, J.Carried(), True)
    got = told["copies"].tolist()
    assert sum(got) == round(n * dst / src) and now.fixed == 0
    if src != 60:
        assert got == grid(times, dst)
    rows = spark.createDataFrame([("v", k, t) for k, t in enumerate(times)], "video string, frame long, t double")
    assert [x.copies for x in J.resample_batch(rows, dst).orderBy("frame").collect()] == got


def test_bad_timestamps_are_repaired():
    t = np.array([np.nan, np.nan, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.3])
    told, now = J.grid_copies(np.arange(10), t, 30.0, J.Carried(), True)
    assert now.fixed == 9 and told["copies"].sum() == 10
    told, now = J.grid_copies(np.arange(10), np.zeros(10), 30.0, J.Carried(gap=1 / 25), True)  # no timestamps: an even rate
    shown = np.repeat(told["frame"], told["copies"])
    assert now.fixed == 9 and shown.tolist() == np.minimum(np.floor(np.arange(12) * 25 / 30 + 0.5), 9).tolist()


def one_by_one(t, interval=1 / 30):
    """Repaired timestamps by the definition, a frame at a time."""
    out = []
    for x in t:
        if not (np.isfinite(x) and x >= 0 and (not out or x > out[-1] + 1e-6)):
            x = out[-1] + interval if out else 0.0
        if out:
            interval = x - out[-1]
        out.append(x)
    return out


def test_repair_by_stretches_and_in_parts():
    r = np.random.default_rng(7)
    for _ in range(500):
        n = int(r.integers(1, 30))
        t = np.where(r.random(n) < 0.3, np.nan, np.cumsum(r.choice([0.0, 0.02, 0.033, 0.1, -0.03], n)))
        assert np.allclose(J.repaired_times(t, J.Carried())[0], one_by_one(t))
        whole, end = J.grid_copies(np.arange(n), t, 30.0, J.Carried(), True)
        c = int(r.integers(1, n + 1))
        first, was = J.grid_copies(np.arange(c), t[:c], 30.0, J.Carried(), c == n)
        parts = [first] if c == n else [first, J.grid_copies(np.arange(c, n), t[c:], 30.0, was, True)[0]]
        assert sum((p.to_numpy().tolist() for p in parts), []) == whole.to_numpy().tolist()


def test_resampler_stream_equals_batch(spark, tmp_path):
    """Video a is marked at its end, b ends by its timer when c's frames or the clock move on, c is still open."""
    start = datetime.datetime(2024, 1, 1)
    row = lambda v, k, last=False: (v, k, k / 25 if k % 5 else None, start + datetime.timedelta(seconds=k / 25 + 100 * (v == "c")), last)
    rows = [row(v, k, v == "a" and k == 29) for v in "ab" for k in range(30)]
    more = [row("c", k) for k in range(40)]
    schema = "video string, frame long, t double, at timestamp, last boolean"
    parts = [rows[:20][::-1] + rows[30:45], rows[20:30] + rows[45:], more[:30], more[30:]]
    run = None
    with J.with_timers(spark):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = J.resample_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 30.0, delay="1 second", patience=20.0)
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            run.awaitTermination()
    got = {(r.video, r.frame): (r.copies, r.fixed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.video, r.frame): (r.copies, r.fixed) for r in J.resample_batch(spark.createDataFrame(rows + more, schema), 30.0).collect()}
    assert got == {k: v for k, v in want.items() if k != ("c", 39)}  # told when its timer comes
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
