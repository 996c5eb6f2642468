import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visemill.functions import labels, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_stems(spark):
    rows = [("lip_J_1_F_02_C001_A_003",), ("lip_J_1_X_02_C001_A_003",), (None,)]
    got = values(spark, rows, "s string", labels.parse_stem(F.col("s")).alias("p"))
    assert got[0][0].asDict() == {"group": "J", "age": "1", "gender": "F", "speaker": "C001", "angle": "A", "session": "003"}
    assert got[1][0] is None and got[2][0] is None


def test_durations_and_resolutions(spark):
    rows = [("0:05:08", "1920*1080"), ("5:08", "1280x720"), ("308", None), ("1:00:00.5", "640X480")]
    got = values(spark, rows, "d string, r string", labels.parse_duration(F.col("d")), labels.parse_resolution(F.col("r")))
    assert [g[0] for g in got] == [308, 308, 308, 3600.5]
    assert [tuple(g[1]) for g in got] == [(1920, 1080), (1280, 720), (1920, 1080), (640, 480)]


def test_boxes(spark):
    rows = [([[10, 20, 1900, 1000]],), ([[20, 10, 1000, 1900]],), ([],)]
    order = labels.bbox_order(F.col("b"), F.lit(1920), F.lit(1080))
    got = values(spark, rows, "b array<array<int>>", order, labels.reorder_boxes(F.col("b"), order))
    assert [g[0] for g in got] == ["xy", "yx", "yx"]
    assert got[0][1] == got[1][1] == [[10, 20, 1900, 1000]]


def test_subtitle_times(spark):
    got = values(spark, [(59.9996,), (3661.25,), (-0.3,)], "t double", labels.srt_time(F.col("t")))
    assert [g[0] for g in got] == ["00:01:00,000", "01:01:01,250", "00:00:00,000"]


def test_gates(spark):
    rows = [(5.0, 1.0), (4.9, 1.0), (None, 1.0), (0.0, 0.05), (9.0, 0.0)]
    got = values(spark, rows, "s double, r double", labels.choose_mode(F.col("s"), 5.0, visual_ratio=F.col("r")))
    assert [g[0] for g in got] == ["av", "video", "video", "audio", "av"]
    rows = [(10.0, 20.0), (None, 20.0), (10.0, None), (None, None)]
    both = [labels.combine_snr(F.col("d"), F.col("m"), e) for e in ("hybrid", "dsp", "model")]
    assert values(spark, rows, "d double, m double", *both) == [(15, 10, 20), (20, 20, 20), (10, 10, 10), (None, None, None)]
    with pytest.raises(ValueError):
        labels.combine_snr(F.col("d"), F.col("m"), "other")
    assert [g[0] for g in values(spark, [(25.0,), (20.0,), (10.0,), (0.0,), (-1.0,), (None,)], "s double", labels.snr_bucket(F.col("s")))] == [0, 0, 1, 2, 3, 0]


def test_resampling(spark):
    for n, a, b in [(0, 30, 25), (1, 30, 25), (50, 25, 30), (60, 60, 30), (31, 30, 25)]:
        got = values(spark, [(n,)], "n int", labels.resampled_length(F.col("n"), a, b), labels.resample_indices(F.col("n"), a, b))
        length = math.ceil(n * b / a - 1e-9)
        assert got[0][0] == length
        assert got[0][1] == [min(math.floor(k * a / b + 0.5), n - 1) for k in range(length)]


def test_paths(spark):
    rows = [("a/b.npz",), ("",), (None,), ("/a",), ("a/../b",), ("C:\\x",), ("a\\..\\b",), ("..a/b",)]
    assert [g[0] for g in values(spark, rows, "p string", labels.is_safe_path(F.col("p")))] == [True, False, False, False, False, False, False, True]


def test_splits_are_exclusive():
    with pytest.raises(ValueError):
        labels.drop_reason(**{c: F.lit(1) for c in ("has_unk", "n_frames", "duration", "angle", "speaker", "split_dir")}, val=["A"], test=["A"], train_dirs=[])


def test_normal_form(spark):
    got = values(spark, [("안녕\xa0하세요\n(테스트)/ 1",), ("“가…” ",), (None,)], "t string", text.normalize(F.col("t")))
    assert [g[0] for g in got] == ["안녕 하세요 테스트 1", "가.", None]


def test_jamo(spark):
    words = "각 힣.가?"
    got = values(spark, [(words,)], "t string", text.jamo_ids(F.col("t")), text.jamo_text(text.jamo_ids(F.col("t"))))
    assert got[0][0] == [6, 25, 46, 5, 24, 45, 72, 73, 6, 25, 74]
    assert got[0][1] == words
    rows = [([6],), ([25],), ([49],), ([6, 25, 3, 6],), ([6, 25, 25],), ([0, 1, 2, 6, 25, 4],), ([],)]
    assert [g[0] for g in values(spark, rows, "i array<int>", text.jamo_text("i"))] == ["ㄱ", "ㅏ", "ㄴ", "가", "가ㅏ", "가X", ""]
    flags = values(spark, [("가", "가"), ("", "()"), ("a", "a"), ("가", "가X")], "n string, r string", text.has_unknown(F.col("n"), F.col("r")))
    assert [g[0] for g in flags] == [False, True, True, True]


def test_groups(spark):
    got = values(spark, [("각 가.",), ("a",), ("",)], "t string", text.text_groups(F.col("t")))
    assert [tuple(g) for g in got[0][0]] == [("각", "syl", 0, 3), (" ", "space", 3, 4), ("가", "syl", 4, 6), (".", "punct", 6, 7)]
    assert got[1][0] is None and got[2][0] == []


def test_audio_frames(spark):
    got = values(spark, [(399,), (400,), (880,), (16000,)], "n long", labels.audio_frames(F.col("n")))
    assert [g[0] for g in got] == [0, 0, 1, 24]
    assert np.isfinite([g[0] for g in got]).all()


def test_a_batch_of_texts_is_handed_back_in_parts():
    import pyarrow as pa

    rows = ["각 가." * 20_000, None, "", "가나" * 90_000, "a"] * 3
    for work, size in ((text.text_groups, 8), (text.jamo_ids, 1), (text.nfc, 1)):
        parts = list(work.func(iter([pa.array(rows)])))
        assert sum(map(len, parts)) == len(rows) and len(parts) > 5
    ids = pa.concat_arrays(list(text.jamo_ids.func(iter([pa.array(rows)]))))
    back = list(text.jamo_text.func(iter([ids.slice(1)])))
    assert len(back) > 2 and pa.concat_arrays(back).to_pylist() == [r if r != "a" else "X" for r in rows[1:]]


def test_jamo_text_of_odd_orders():
    import random

    import pyarrow as pa

    def decode(ids):
        out, held = [], []

        def flush():
            if len(held) == 2:
                out.append(chr(0xAC00 + (held[0] * 21 + held[1]) * 28))
            elif held:
                out.append(text.INITIALS[held[0]])
            held.clear()

        for i in ids:
            if 6 <= i < 25:
                flush()
                held.append(i - 6)
            elif 25 <= i < 46 and len(held) == 1:
                held.append(i - 25)
            elif 25 <= i < 46:
                flush()
                out.append(text.VOWELS[i - 25])
            elif 46 <= i < 73 and len(held) == 2:
                out.append(chr(0xAC00 + (held[0] * 21 + held[1]) * 28 + i - 45))
                held.clear()
            elif 46 <= i < 73:
                flush()
                out.append(text.FINALS[i - 46])
            elif i == 3:
                break
            elif i in (4, 5) or 73 <= i < 77:
                flush()
                out.append("X" if i == 4 else " " if i == 5 else text.STOPS[i - 73])
        flush()
        return "".join(out)

    r = random.Random(5)
    rows = [[r.choice([r.randrange(4 if r.random() < 0.1 else 80), r.randrange(6, 25), r.randrange(25, 46), r.randrange(46, 73)]) for _ in range(r.randrange(12))] for _ in range(2000)]
    got = pa.concat_arrays(list(text.jamo_text.func(iter([pa.array(rows, pa.list_(pa.int32()))]))))
    assert got.to_pylist() == [decode(x) for x in rows]
