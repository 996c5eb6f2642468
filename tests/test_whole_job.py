"""Registered queries on small tables that hold what earlier cuts left out, against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from visemill.operators import alignment as A
from visemill.operators import metrics as M
from visemill.operators import pairs as P
from visemill.operators import segments as G
from visemill.operators import signal as S
from visemill.operators.metrics import char_distance
from visemill.operators.metrics import edits as edits_of
from visemill.plans import queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def bare(s):
    return s.replace(" ", "")


def heard(s):
    return s.replace("th", "t").replace("on", "onn")


def rows_of(spark, name, folder):
    return [r.asDict() for r in queries()[name](spark, str(folder)).collect()]


def test_char_distance():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(150))) for _ in range(2))
        assert char_distance(a, b) == edits(a, b) and char_distance(a, heard(a)) == edits(a, heard(a))


def test_edits_of_short_and_long_columns(spark):
    rows = [("", "a"), ("abc", "abc"), ("é" * 30, "e" * 28), ("th on " * 200, "t onn " * 200), (None, "a"), ("x", None)]
    got = spark.createDataFrame(rows, "r string, h string").select(edits_of(F.col("r"), F.col("h"))).collect()
    assert [g[0] for g in got] == [None if a is None or b is None else edits(a, b) for a, b in rows]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    # nothing to hear wrongly, or to tell apart, in the first 200 characters; an utterance is a piece of 100
    docs = [(i, "m" * 210 + " " + "the stone, a month " * (3 + i) + "é", f"s{i % 2}", "en" if i < 3 else "de", 0) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    plain = [(i, s, a, t) for i, t, s, a, _ in docs]
    return folder, [(i, s, a, t[k : k + 100], k // 100) for i, s, a, t in plain for k in range(0, len(t), 100)]


def rate(pairs):
    return round(sum(edits(bare(a), bare(b)) for a, b in pairs) / sum(len(bare(a)) for a, _ in pairs), 6)


def test_error_rates_take_whole_texts(spark, texts):
    folder, docs = texts
    by = defaultdict(list)
    for _, _, angle, t, _ in docs:
        by[angle].append((t, heard(t)))
    assert {r["angle"]: (r["n"], r["cer"]) for r in rows_of(spark, "a5_cer", folder)} == {k: (len(v), rate(v)) for k, v in by.items()}
    words = {k: round(sum(edits(a.split(), b.split()) for a, b in v) / sum(len(a.split()) for a, _ in v), 6) for k, v in by.items()}
    assert {r["angle"]: r["wer"] for r in rows_of(spark, "a6_wer", folder)} == words
    everything = [p for v in by.values() for p in v]
    top = next(r for r in rows_of(spark, "a8_cer_cube", folder) if r["level"] == 3)
    assert (top["n"], top["cer_hyp"], top["cer_att"]) == (len(docs), rate(everything), rate([(t, t.replace("a", "aa")) for t, _ in everything]))
    epoch, = rows_of(spark, "a12_training_progress", folder)
    assert (epoch["av"], epoch["audio"]) == (rate(everything), rate([(t, t.replace("a", "")) for t, _ in everything]))


def test_modes_take_whole_texts(spark, texts):
    folder, docs = texts

    def said(i, t, snr, mode):
        return heard(t) if (i + snr + len(mode)) % 3 == 0 else t.replace("e", "") if mode == "video" else t

    want = {snr: tuple(rate([(t, said(i, t, snr, mode)) for i, _, _, t, _ in docs]) for mode in ("av", "audio", "video")) for snr in (20, 10, 5, 0)}
    assert {r["snr"]: (r["av"], r["audio"], r["video"]) for r in rows_of(spark, "a7_modes_by_snr", folder)} == want
    assert {(r["utt_id"], r["piece"]): (r["audio"], r["av"], r["video"]) for r in rows_of(spark, "j17_across_runs", folder)} == {(i, k): tuple(said(i, t, 10, m) for m in ("audio", "av", "video")) for i, _, _, t, k in docs}
    # e left out costs less than the errors heard, so the highest level with av errors above video's decides
    pairs = [(bare(t), bare(said(i, t, snr, "video"))) for i, _, _, t, _ in docs for snr in want]
    video, chars = sum(edits(a, b) for a, b in pairs), sum(len(a) for a, _ in pairs)
    worse = [snr for snr, (av, _, _) in want.items() if av > video / chars]
    found, = rows_of(spark, "a11_threshold", folder)
    assert found["threshold"] == (max(worse) if worse else None)


def test_worst_takes_whole_texts(spark, texts):
    folder, docs = texts
    want = {}
    for speaker in {s for _, s, *_ in docs}:
        want[speaker] = min((-edits(t, heard(t)), i, k) for i, s, _, t, k in docs if s == speaker)[1:]
    assert {r["speaker"]: (r["worst"], r["worst_piece"]) for r in rows_of(spark, "t3_worst_and_typical", folder)} == want


def test_halves_take_whole_sentences(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "m" * 160 + " " + "that month " * (2 + c + t)) for c in range(2) for t in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    joined, end = defaultdict(list), defaultdict(float)
    for c, t, _, text in turns:
        end[c] += len(text) / 15 + t % 5 * 0.15
        joined[c, "clean" if end[c] - len(text) / 30 < 20 else "noisy"].append(text)
    by = defaultdict(list)
    for (_, half), v in joined.items():
        by[half].append((" ".join(v), " ".join(x.replace("th", "t") for x in v)))
    assert {r["half"]: (r["n"], r["cer"]) for r in rows_of(spark, "j10_halves", tmp_path)} == {k: (len(v), rate(v)) for k, v in by.items()}


def test_label_shift_takes_whole_turns(spark, tmp_path):
    r = random.Random(8)
    turns = [(c, t, "user", "".join(r.choice("abcdefgh (x") for _ in range(900))) for c in range(2) for t in range(12)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["video_stem"]: x["gain"] for x in rows_of(spark, "w19_label_shift", tmp_path)}
    want = {}
    for c in range(2):
        db = [ord(x) % 40 for v, _, _, text in turns if v == c for x in text]
        total = [0]
        for x in db:
            total.append(total[-1] + x)
        score = {}
        for j in range(-40, 41):
            q = []
            for t in range(12):
                a, z = (round((x + j * 0.02) * 100) for x in (t * 1.3, t * 1.3 + 1))
                at = [(1, a + 15), (-2, a), (1, a - 15), (2, z), (-1, z - 15), (-1, z + 15)]
                if all(0 <= k < len(total) for _, k in at):
                    q.append(sum(f * total[k] for f, k in at) / 15)
            if len(q) >= 3:
                score[j] = sum(q) / len(q)
        want[c] = round(max(score.values()) - score.get(0, max(score.values())), 5)
    assert got == pytest.approx(want, abs=2e-5)


def test_every_event_counts(spark, tmp_path):
    r = random.Random(3)
    kinds = ("click", "view", "error")
    events = [(i, r.randrange(3), i, kinds[r.randrange(3)], float(r.randrange(1000))) for i in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    frames = defaultdict(list)
    for _, user, _, kind, value in events:
        frames[user].append((value, kind != "error"))

    def around(user, k0, reach):
        return [(o, frames[user][k0 + o][0]) for o in reach if 0 <= k0 + o < len(frames[user])]

    share, lip, profile = {}, {}, defaultdict(list)
    for i, user, *_ in events:
        start = i % 300 / 10
        inside = frames[user][round(start) : round(start + i % 7 / 5)]
        share[i] = round(sum(v for _, v in inside) / len(inside), 6) if inside else 0
        seen = around(user, i % 50, range(-4, 3))
        low = min(seen, key=lambda x: (x[1], x[0]))[0]
        v = dict(around(user, i % 50, range(-4, 6)))
        rises = [(v[o - 1] - v[o], o) for o in range(low + 1, low + 4) if o in v]
        lip[i] = (low, low in (seen[0][0], seen[-1][0]), min(rises)[1] - 0.5 if rises else None)
        for o, x in around(user, i % 40, range(-3, 4)):
            profile[i % 2 == 0, o].append(x)
    assert {x["seg"]: x["share"] for x in rows_of(spark, "j9_visual_ratio", tmp_path)} == share
    assert {x["event"]: (x["min_offset"], x["edge"], x["release_offset"]) for x in rows_of(spark, "v11_lip_events", tmp_path)} == lip
    got = {(x["bilabial"], x["offset"]): (x["n"], x["mean"]) for x in rows_of(spark, "a22_profile", tmp_path)}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-5)) for k, v in profile.items()}
    assert {x["split"] for x in rows_of(spark, "a28_subgroups", tmp_path)} == {0, 1, 2}


def test_boxes_by_the_nearest_whole_number(spark, tmp_path):
    spark.createDataFrame([(1, 7, 1920.6), (1, 8, 1920.6), (2, 9, 1080.5)], "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["o_custkey"]: (r["n_boxes"], r["box_order"]) for r in rows_of(spark, "p3_bbox_order", tmp_path)} == {1: (2, "yx"), 2: (1, "yx")}


def test_pixels_in_the_precision_of_the_vectors(spark, tmp_path):
    import numpy as np

    x = next(float(v) for v in (np.float32(k / 1000) for k in range(1, 2000)) if int(v * np.float32(1000)) != int(float(v) * 1000))
    spark.createDataFrame([(0, "a", [x, 0.0, 0.5])], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = np.array([int(np.float32(x) * np.float32(1000)) % 256, 0, 500 % 256]) / 255
    got, = rows_of(spark, "w16_pixel_z_scores", tmp_path)
    assert got["total"] == pytest.approx(0, abs=1e-5) and got["top"] == pytest.approx(((p - p.mean()) / max(p.std(), 1e-3)).max(), abs=1e-5)


def test_label_documents_of_equal_names_stay_apart(spark, tmp_path):
    turns = [(c, t, "user", None if t == 1 else "x") for c in (1000, 10000) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(spark, "s1_label_reader", tmp_path)
    assert [(r["video_stem"], r["n"], r["sentence_ids"], r["n_texts"]) for r in got] == [("lip_J_1_F_02_C000_A_100", 3, "0,1,2", 2)] * 2


def test_forced_alignment_in_a_window_of_states(monkeypatch):
    r = np.random.default_rng(5)
    logp, targets = [], []
    for k in range(120):
        t = r.integers(1, 5, int(r.integers(0, 40)))
        x = r.integers(-12, 0, (max(1, 3 * len(t) + int(r.integers(-3, 8))), 6)) / 3.0
        for f in range(len(x)):
            x[f, 0 if f % 3 == 2 or f // 3 >= len(t) else t[f // 3]] += (0, 4, 14)[k % 3]
        logp.append(x), targets.append(t)
    want = G.all_state_paths(logp, targets)
    monkeypatch.setattr(G, "WINDOWS", (6, 16))
    for a, b in zip(G.best_paths(logp, targets), want):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1], equal_nan=True) and a[2] == b[2]
    # thousands of clear frames are found within the window alone
    monkeypatch.undo()
    monkeypatch.setattr(G, "all_state_paths", None)
    t = r.integers(1, 16, 2000)
    x = np.full((6000, 16), -3.0)
    x[np.arange(6000), np.where(np.arange(6000) % 3 == 2, 0, np.repeat(t, 3))] = -0.1
    token, _, total = G.best_paths([x], [t])[0]
    assert np.array_equal(token, np.where(np.arange(6000) % 3 == 2, -1, np.repeat(np.arange(2000), 3))) and total == pytest.approx(-600)


def test_scenes_are_assigned_in_batches(spark):
    r = np.random.default_rng(7)
    scenes = [r.integers(0, 4, (k, k)) / 4.0 for k in (1, 2, 3, 2, 4, 3, 2)]  # ties too
    rows = [(n, i, j, float(m[i, j])) for n, m in enumerate(scenes) for i in range(len(m)) for j in range(len(m))]
    out = M.scene_assignments(spark.createDataFrame(rows, "scene int, face int, stream int, s double"), ["scene"])
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # no call of Python for each scene
    got = {x.scene: (x.scene_right, x.stream_share) for x in out.collect()}
    for n, m in enumerate(scenes):
        best = max(itertools.permutations(range(len(m))), key=lambda p: sum(m[i, j] for i, j in enumerate(p)))
        share = np.mean(np.array(best) == np.arange(len(m)))
        assert got[n] == (share == 1, pytest.approx(share))


def test_alignments_of_many_utterances_in_a_file(spark, tmp_path):
    from visemill.sources.readers import read_alignments
    from visemill.sources.writers import write_alignments

    rows = spark.range(0, 500, 1, 2).select(F.concat(F.lit("u\n\"가"), "id").alias("utt_id"), (F.col("id") % 2 == 0).alias("ok"))
    write_alignments(rows, str(tmp_path / "a"), most=1500)
    files = list((tmp_path / "a").glob("part-*"))
    assert 10 < len(files) < 30
    got = {r.utt_id: r.ok for r in read_alignments(spark, str(tmp_path / "a")).collect()}
    assert got == {f"u\n\"가{k}": k % 2 == 0 for k in range(500)}


def test_labels_end_with_the_frames(spark):
    token = "array(named_struct('id', 7, 'start_s', start_s), named_struct('id', 30, 'start_s', start_s + 0.04D))"
    rows = spark.range(3).selectExpr("id AS u", "explode(sequence(0, 4)) AS pos").selectExpr("u", "pos", "pos * 0.3D AS start_s", "pos * 0.3D + 0.2D AS end_s", "pos * 0.3D + 0.35D AS ext_end_s")
    syllables = rows.selectExpr("*", f"{token} AS tokens")
    lengths = spark.createDataFrame([(0, 11), (1, 1000)], "u long, last_k long")
    for proportional in (False, True):
        every = A.frame_labels(syllables, "u", 25.0, proportional=proportional).collect()
        got = A.frame_labels(syllables, "u", 25.0, proportional=proportional, lengths=lengths).collect()
        assert sorted(got) == sorted(r for r in every if r.u == 1 or (r.u == 0 and r.k <= 11)) and len(got) > 12


def test_score_histogram_of_several_keys(spark):
    r = np.random.default_rng(2)
    rows = [(i, f"S{i * i % 5}", i % 3, r.normal(size=6).tolist(), r.normal(size=6).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, speaker string, session int, face array<double>, stream array<double>")
    want = defaultdict(int)
    for a in rows:
        for b in rows:
            cos = np.dot(a[3], b[4]) / np.linalg.norm(a[3]) / np.linalg.norm(b[4])
            for positive, counts in ((1, a[0] == b[0]), (0, a[1:3] != b[1:3])):
                want[positive, min(int((cos + 1) * 20), 39)] += counts
    got = P.score_histogram(df, "speaker, session", bins=40, block_rows=40)
    assert {(x.positive, x.bin): x.n for x in got.collect()} == {k: n for k, n in want.items() if n}


def test_streams_of_a_scene_in_pieces(spark):
    r = np.random.default_rng(3)
    scenes = {7: [40, 0, 25], 8: [30], 9: [0, 0], 10: [12, 12]}
    rows = [(c, k, bytes(r.integers(0, 256, n, dtype=np.uint8))) for c, lengths in scenes.items() for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "c long, turn int, wave binary").orderBy(F.desc("turn"))
    got = defaultdict(list)
    pieces = S.leaked_streams(df, "c", "turn", "wave", 6.0, part=16).collect()
    assert max(len(p.y) for p in pieces) == 16
    for p in sorted(pieces, key=lambda p: p["first"]):
        assert len(got[p.c, p.stream]) == p["first"] and p.n_streams == len(scenes[p.c])
        got[p.c, p.stream] += p.y
    for c, lengths in scenes.items():
        padded = [np.pad(S.as_wave(w), (0, max(lengths) - len(w))) for k, _, w in rows if k == c]
        for k, want in enumerate(S.mix_leakage(padded, 6.0)):
            assert np.allclose(got[c, k], want, atol=1e-12)


def test_arrays_come_back_in_parts(spark):
    rows = spark.range(0, 50, 1, 1).select("id", F.when(F.col("id") % 7 != 3, F.expr("repeat('x', cast(id * 20 as int))").cast("binary")).alias("wave"))
    out = S.with_arrays(rows, ["wave"], "f", lambda w: np.arange(len(w)), part=1000)
    got = {x.id: x.f for x in out.collect()}
    assert got == {k: None if k % 7 == 3 else [float(v) for v in range(20 * k)] for k in range(50)}
    x = np.random.default_rng(0).normal(size=1024 * 160 * 3)
    assert np.allclose(S.log_mel(x, normalised=False)[1000:1100], S.log_mel(x[160000:], normalised=False)[:100])


def test_window_features_of_whole_sounds(spark, tmp_path):
    r = random.Random(11)
    texts = ["".join(r.choice("abcdefg é") for _ in range(n)) for n in (1, 399, 640, 6399, 6400, 6401, 30_000)] + ["", None]
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = defaultdict(dict)
    for x in rows_of(spark, "v4_window_features", tmp_path):
        assert x["n"] == 3200 and x["start"] not in by[x["doc_id"]]
        by[x["doc_id"]][x["start"]] = x["squares"]
    for k, t in enumerate(texts):
        wave = S.as_wave((t or "").encode())
        starts = sorted(by[k])
        assert np.all(np.diff(starts) == 10) and (not len(wave) or starts[0] <= 0 and (starts[-1] + 10) * 640 >= len(wave))
        for s in starts:
            assert by[k][s] == pytest.approx(float(np.square(S.window_features(wave, s, 10).astype(np.float32), dtype=np.float64).sum()), abs=0.02)
    assert len(by) == len(texts)


def test_feature_files_are_read_in_parts(spark, tmp_path):
    import pyarrow as pa

    from visemill.sources.readers import parts_by_size, read_features
    from visemill.sources.writers import feature_bytes, write_files

    content = pa.array([b"x" * n for n in (5, 0, 30, 4, 4, 4)] + [None], pa.binary())
    assert list(parts_by_size(content, 10)) == [(0, 2), (2, 1), (3, 2), (5, 2)]
    rows = spark.range(20).withColumn("n", (F.col("id") % 4).cast("int"))  # some without frames
    times = lambda k: F.array_repeat(F.col("id").cast("double"), F.col("n") * k)
    files = feature_bytes(rows.select(F.concat("id", F.lit(".npz")).alias("name"), times(80).alias("lm"), times(8).alias("cue"), times(1).cast("array<int>").alias("valid"), times(3).cast("array<int>").alias("audio")), most=3000)
    assert write_files(files, str(tmp_path / "f")) == 20
    for x in read_features(spark, str(tmp_path / "f")).collect():
        k = int(x.path.split("/")[-1][:-4])
        assert k % 4 == 0 or (x.reason, x.n_frames, x.lm, x.audio, x.fps) == (None, k % 4, [k] * (k % 4 * 80), [k] * (k % 4 * 3), 30.0)
