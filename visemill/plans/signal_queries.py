"""Queries over arrays: sound, landmarks, posteriors, segments, and the streaming jobs."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import segments as G
from ..operators import signal as S
from ..operators.ordering import cut
from ..streaming import jobs as J
from ..sources.readers import check_content, explode_syllables, explode_tokens, media_index, read_alignments, read_console, read_features, read_labels, read_manifests, read_process_log
from ..sources.writers import archive_bytes, feature_bytes, read_done_manifests, write_alignments, write_files, write_manifests
from .adapters import FRAMES, UTT, frames, table, utterances
from .registry import query


def waves(spark, sf_dir) -> DataFrame:
    """The UTF-8 bytes of each text as 8-bit samples of a sound."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("wave"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))


# frames of 400 samples every 160, from running sums of squares
LEVEL_SQL = """b AS (SELECT doc_id, source, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents), x AS (SELECT doc_id, source, generate_subscripts(l, 1) AS i, (('0x' || unnest(l))::INT - 128) / 128e0 AS x FROM b WHERE len(l) > 0),
 s AS (SELECT doc_id, source, i, sum(x * x) OVER (PARTITION BY doc_id ORDER BY i) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM x),
 f AS (SELECT doc_id, source, len(l) AS n, unnest(range(0, (greatest(len(l), 400) - 400) // 160 + 1)) AS k FROM b),
 db AS (SELECT f.doc_id, f.source, f.n, k, 10 * log10(greatest(coalesce(z.s, 0) - coalesce(a.s, 0), 0) / 400 + 1e-10) AS db FROM f LEFT JOIN s z ON z.doc_id = f.doc_id AND z.i = least(k * 160 + 400, f.n) LEFT JOIN s a ON a.doc_id = f.doc_id AND a.i = k * 160)"""


@query("v1_frame_energy", f"WITH {LEVEL_SQL} SELECT source, count(*)::BIGINT AS n_frames, round(avg(db), 4) AS mean_db FROM db GROUP BY 1")
def energy(spark, sf_dir):
    rows = waves(spark, sf_dir).withColumn("db", S.energy_column("wave")).select("source", F.size("db").alias("n"), F.aggregate("db", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return rows.groupBy("source").agg(F.sum("n").alias("n_frames"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean_db"))


@query("v2_snr_estimate", f"""WITH {LEVEL_SQL}, p AS (SELECT doc_id, source, quantile_cont(db, 0.1) AS p10, quantile_cont(db, 0.7) AS p70, max(db) AS top, max(n) AS n FROM db GROUP BY 1, 2),
 e AS (SELECT p.doc_id, p.source, CASE WHEN max(p.n) = 0 THEN -10 ELSE least(greatest(coalesce(avg(d.db) FILTER (d.db > p70), max(top)) - max(p10), -10), 40) END AS snr FROM p JOIN db d ON d.doc_id = p.doc_id GROUP BY 1, 2)
 SELECT source, count(*) AS n, round(avg(snr), 4) AS snr, round(max(snr), 4) AS highest FROM e GROUP BY 1""")
def snr(spark, sf_dir):
    rows = waves(spark, sf_dir).select("source", S.snr_column("wave").alias("snr"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("snr"), 4).alias("snr"), F.round(F.max("snr"), 4).alias("highest"))


@query("v3_noise_mixing", "SELECT source, unnest(['white', 'pink', 'babble']) AS kind, count(*) AS n, CASE WHEN bool_or(text <> '') THEN 5e0 END AS snr FROM documents GROUP BY source")
def mixing(spark, sf_dir):
    """Level of each whole sound over the noise that was put on it, as measured afterwards: what was asked for. Empty sounds
    have none. A check of the mixing alone: the samples of noise are drawn."""
    rows = waves(spark, sf_dir).select("doc_id", "source", "wave")
    clips = P.noise_pool(rows.select(F.col("doc_id").alias("id"), "wave"), 7, 8)
    levels = [F.struct(F.lit(kind).alias("kind"), S.mixed_snr_column(kind, 5.0, 1, clips)("doc_id", "wave").alias("snr")) for kind in ("white", "pink", "babble")]
    measured = rows.select("source", F.inline(F.array(*levels)))
    return measured.groupBy("source", "kind").agg(F.count("*").alias("n"), F.round(F.avg("snr"), 2).alias("snr"))


@query("v3_leakage", """WITH b AS (SELECT conv_id, turn, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM conversations), len AS (SELECT conv_id, max(len(l)) AS n FROM b GROUP BY 1), p AS (SELECT b.conv_id, turn, l, unnest(range(1, n + 1)) AS i FROM b JOIN len USING (conv_id)),
 x AS (SELECT conv_id, turn, i, CASE WHEN i <= len(l) THEN (('0x' || l[i])::INT - 128) / 128e0 ELSE 0 END AS x FROM p), r AS (SELECT *, sum(x) OVER (PARTITION BY conv_id, i) - x AS rest FROM x),
 g AS (SELECT conv_id, turn, sqrt(avg(x * x)) AS own, sqrt(avg(rest * rest)) AS others FROM r GROUP BY 1, 2), m AS (SELECT r.conv_id, r.turn, i, CASE WHEN others < 1e-12 THEN x ELSE x + rest * greatest(own, 1e-8) / (others * power(10, 6 / 20e0)) END AS y FROM r JOIN g ON g.conv_id = r.conv_id AND g.turn = r.turn)
 SELECT conv_id, count(DISTINCT turn) AS n_streams, count(*) AS n_samples, round(sum(y), 4) AS total, round(sum(y * y), 4) AS energy, round(sum(y * (i % 7)), 4) AS weighted FROM m GROUP BY 1""")
def leakage(spark, sf_dir):
    """The turns of a conversation as the streams of a scene, each with the others 6 dB below it; every sample is compared."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("wave"))
    pieces = S.leaked_streams(turns, "conv_id", "turn", "wave", 6.0)
    samples = pieces.select("conv_id", "n_streams", "first", F.posexplode("y").alias("at", "y")).withColumn("i", F.col("first") + F.col("at"))
    total = lambda c: F.round(F.sum(c), 4)
    return samples.groupBy("conv_id", "n_streams").agg(F.count("*").alias("n_samples"), total(F.col("y")).alias("total"), total(F.col("y") * F.col("y")).alias("energy"), total(F.col("y") * ((F.col("i") + 1) % 7)).alias("weighted"))


@query("v4_log_mel", "SELECT source, count(*) AS n, sum(CASE WHEN octet_length(encode(text)) >= 400 THEN (1 + (octet_length(encode(text)) - 400) // 160) // 4 ELSE 0 END)::BIGINT AS stacked_frames FROM documents GROUP BY 1")
def mel(spark, sf_dir):
    rows = S.with_arrays(waves(spark, sf_dir).select("source", "wave"), ["wave"], "mel", lambda w: S.stacked(S.log_mel(S.as_wave(w)))).select("source", F.size("mel").alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("n") / 320).cast("long").alias("stacked_frames"))


@query("v4_window_features")
def window_features(spark, sf_dir):
    """The whole of each sound in windows of ten frames that lie end to end; one begins at a drawn place, which may lie before the
    sound's start or after its end. The sum over a window is zero but for what silence leaves, so squares are shown."""
    rows = waves(spark, sf_dir).select("doc_id", "wave", (S.drawn(-4, F.floor(F.col("n") / 640) + 4, F.lit(5), F.col("doc_id"))).cast("int").alias("start"))
    out = S.with_arrays(S.tiled_windows(rows, "wave", "start", 10), ["wave", "at"], "f", lambda w, at: S.window_features(S.as_wave(w), at, 10))
    fold = lambda step: F.round(F.aggregate("f", F.lit(0.0), step), 2)
    return out.select("doc_id", "start", F.size("f").alias("n"), fold(lambda a, x: a + x * x).alias("squares"))


LIP_SQL = """p AS (SELECT vec_id, label, embedding AS v, v[(2 * 33) % 64 + 1]::DOUBLE AS lx, v[(2 * 33 + 1) % 64 + 1]::DOUBLE AS ly, v[(2 * 263) % 64 + 1]::DOUBLE AS rx, v[(2 * 263 + 1) % 64 + 1]::DOUBLE AS ry FROM embeddings),
 s AS (SELECT *, greatest(sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)), 1e-6) AS scale FROM p),
 k AS (SELECT vec_id, i, n, v[(2 * i) % 64 + 1]::DOUBLE - lx AS dx, v[(2 * i + 1) % 64 + 1]::DOUBLE - ly AS dy, rx - lx AS ax, ry - ly AS ay, scale FROM s, (SELECT unnest([78, 95, 88, 178, 87, 14, 317, 402, 318, 324, 308, 415, 310, 311, 312, 13, 82, 81, 80, 191, 291, 61, 17, 0]) AS i, unnest(range(1, 25)) AS n) q),
 t AS (SELECT vec_id, i, n, (dx * ax + dy * ay) / (scale * scale) AS x, (dy * ax - dx * ay) / (scale * scale) AS y FROM k),
 l AS (SELECT vec_id, max(x) FILTER (n = 21) - max(x) FILTER (n = 22) AS width, max(y) FILTER (n = 6) - max(y) FILTER (n = 16) AS inner_height, max(y) FILTER (n = 23) - max(y) FILTER (n = 24) AS outer_height FROM t GROUP BY 1),
 a AS (SELECT t.vec_id, abs(sum(t.x * u.y - u.x * t.y)) / 2 AS inner_area FROM t JOIN t u ON u.vec_id = t.vec_id AND u.n = CASE WHEN t.n = 20 THEN 1 ELSE t.n + 1 END WHERE t.n <= 20 GROUP BY 1)"""


@query("v5_lip_geometry", f"WITH {LIP_SQL} SELECT label, count(*) AS n, round(avg(width), 4) AS width, round(avg(inner_height), 4) AS inner_height, round(avg(outer_height), 4) AS outer_height, round(avg(inner_area), 4) AS inner_area FROM s JOIN l USING (vec_id) JOIN a USING (vec_id) GROUP BY 1")
def lips(spark, sf_dir):
    points = F.slice(F.flatten(F.array_repeat("embedding", 15)), 1, 956)
    rows = table(spark, sf_dir, "embeddings").select("label", S.lip_column(points).alias("g"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col("g")[k]), 4).alias(c) for k, c in enumerate(("width", "inner_height", "outer_height", "inner_area"))])


_POINTS = ", ".join(map(str, S.OUTER + S.INNER))


@query("v5_lip_skeleton", f"""WITH p AS (SELECT vec_id, label, embedding AS v, v[(2 * 33) % 64 + 1]::DOUBLE AS lx, v[(2 * 33 + 1) % 64 + 1]::DOUBLE AS ly, v[(2 * 263) % 64 + 1]::DOUBLE AS rx, v[(2 * 263 + 1) % 64 + 1]::DOUBLE AS ry FROM embeddings), s AS (SELECT *, rx - lx AS ax, ry - ly AS ay FROM p),
 k AS (SELECT vec_id, label, n, v[(2 * i) % 64 + 1]::DOUBLE AS x, v[(2 * i + 1) % 64 + 1]::DOUBLE AS y, ax, ay, ax * ax + ay * ay AS q FROM s, (SELECT unnest([{_POINTS}]) AS i, unnest(range(0, 40)) AS n) c), c AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM k WINDOW w AS (PARTITION BY vec_id))
 SELECT label, n::INT AS point, count(*) AS n, round(avg((dx * ax + dy * ay) / q), 5) + 0e0 AS x, round(avg((dy * ax - dx * ay) / q), 5) + 0e0 AS y FROM c GROUP BY 1, 2""")
def skeleton(spark, sf_dir):
    points = F.slice(F.flatten(F.array_repeat("embedding", 15)), 1, 956)
    rows = table(spark, sf_dir, "embeddings").select("label", S.skeleton_column(points).alias("s"))
    pairs = rows.select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct(F.get(F.col("s"), 2 * k).alias("x"), F.get(F.col("s"), 2 * k + 1).alias("y")))).alias("point", "p"))
    return pairs.groupBy("label", "point").agg(F.count("*").alias("n"), (F.round(F.avg("p.x"), 5) + 0.0).alias("x"), (F.round(F.avg("p.y"), 5) + 0.0).alias("y"))


@query("v5_mouth_boxes", f"""WITH k AS (SELECT vec_id, embedding[(2 * i) % 64 + 1]::DOUBLE AS x, embedding[(2 * i + 1) % 64 + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest([{", ".join(map(str, S.OUTER))}]) AS i) c), m AS (SELECT vec_id, avg(x) AS x, avg(y) AS y, 1.25e0 * (max(x) - min(x)) AS r FROM k GROUP BY 1)
 SELECT vec_id, round((x - r - 0.5e0) * 3, 6) AS x0, round((y - r + 0.25e0) * 2, 6) AS y0, round((x + r - 0.5e0) * 3, 6) AS x1, round((y + r + 0.25e0) * 2, 6) AS y1 FROM m""")
def mouth_boxes(spark, sf_dir):
    """The square around each mouth, in the coordinates of a scaled region of the picture."""
    points = F.slice(F.flatten(F.array_repeat("embedding", 15)), 1, 956)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(S.mouth_column(points)).alias("boxes"))
    box = S.map_boxes(F.col("boxes"), F.lit(0.5), F.lit(-0.25), F.lit(3.0), F.lit(2.0))[0]
    return rows.select("vec_id", *[F.round(box[k], 6).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("v5_decode_regions", """WITH b AS (SELECT user_id, value * 9 AS x0, (event_id % 200)::DOUBLE AS y0, value * 9 + event_id % 400 - 20 AS x1, event_id % 200 + value * 4 - 10 AS y1 FROM events), g AS (SELECT user_id, bool_or(x1 > x0 AND y1 > y0) AS any_, min(x0) FILTER (x1 > x0 AND y1 > y0) AS a, min(y0) FILTER (x1 > x0 AND y1 > y0) AS b, max(x1) FILTER (x1 > x0 AND y1 > y0) AS c, max(y1) FILTER (x1 > x0 AND y1 > y0) AS d, quantile_cont(greatest(x1 - x0, y1 - y0), 0.5) FILTER (x1 > x0 AND y1 > y0) AS face FROM b GROUP BY 1),
 f AS (SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 1280) AS c, coalesce(d, 720) AS d, coalesce(face, 1280) AS face FROM g), r AS (SELECT user_id, face, floor(floor(greatest(a - 0.12e0 * (c - a), 0)) / 2) * 2 AS x0, floor(floor(greatest(b - 0.12e0 * (d - b), 0)) / 2) * 2 AS y0, floor(least(ceil(c + 0.12e0 * (c - a)), 1280) / 2) * 2 AS x1, floor(least(ceil(d + 0.12e0 * (d - b)), 720) / 2) * 2 AS y1 FROM f),
 z AS (SELECT *, least(greatest(360 / greatest(face, 1), 0.25e0), 1) AS s FROM r) SELECT user_id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, greatest(round_even((x1 - x0) * s / 2, 0) * 2, 64)::INT AS w, greatest(round_even((y1 - y0) * s / 2, 0) * 2, 64)::INT AS h FROM z""")
def decode_regions(spark, sf_dir):
    boxes = table(spark, sf_dir, "events").selectExpr("user_id", "value * 9 AS x0", "CAST(event_id % 200 AS DOUBLE) AS y0", "value * 9 + event_id % 400 - 20 AS x1", "event_id % 200 + value * 4 - 10 AS y1")
    return S.decode_regions(boxes, "user_id", F.lit(1280), F.lit(720))


def posteriors(spark, sf_dir):
    """Each turn of the conversations as an utterance: its characters are the labels (15 classes of code points), and each
    has three frames in which it is likely, spoilt by a hash; whole texts make thousands of frames."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("utt_id"), F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "").alias("chars"))
    rows = rows.repartition(spark.sparkContext.defaultParallelism * 4)  # dealt as texts, before they are made long
    rows = rows.select("utt_id", F.transform("chars", lambda c: (F.ascii(c) % 15 + 1).cast("int")).alias("targets"))
    # what a frame has for unlikely labels comes again after 60 frames; the likely one is put into such a row
    spoilt = F.lit([[-(1 + (f * 7 + v * 13) % 60 / 10) for v in range(16)] for f in range(60)]).cast("array<array<float>>")

    def frame(f):
        row, v = F.get(spoilt, f % 60), F.when(f % 3 == 2, 0).otherwise(F.get("targets", F.floor(f / 3).cast("int")))
        likely = (-((f * 31 + v * 17) % 20 / F.lit(20.0))).cast("float")
        return F.when(v.isNull(), row).otherwise(F.concat(F.slice(row, F.lit(1), v), F.array(likely), F.slice(row, v + 2, F.lit(16))))

    logp = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(3 * F.size("targets"), F.lit(1)) - 1), frame))
    return rows.select("utt_id", F.greatest(3 * F.size("targets"), F.lit(1)).alias("n_frames"), F.lit(16).alias("vocab"), logp.alias("logp"), "targets")


@query("v6_forced_alignment")
def alignment(spark, sf_dir):
    out = G.align_posteriors(posteriors(spark, sf_dir))
    frames_of = F.aggregate("tokens", F.lit(0), lambda n, t: n + t["last"] - t["first"] + 1)
    return out.select("utt_id", "ok", F.size("tokens").alias("n_tokens"), F.round("path_logprob", 4).alias("path_logprob"), frames_of.alias("n_frames"))


def rounded_spans(out: DataFrame) -> DataFrame:
    return out.select("utt_key", F.col("n").cast("int").alias("n"), F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("v9_visual_segments")
def visual(spark, sf_dir):
    return rounded_spans(G.visual_segments(frames(spark, sf_dir), "utt_key", fps=5.0, least=0.5))


@query("v9_energy_segments")
def sound(spark, sf_dir):
    rows = waves(spark, sf_dir).filter("n > 0")
    levels = rows.select("doc_id", F.posexplode(S.energy_column("wave")).alias("k", "db"))
    out = G.energy_segments(levels, "doc_id", rows.select("doc_id", (F.col("n") / S.RATE).alias("total")), least=0.1, most=2.0)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


def _sql_draw(low: str, high: str, key: str) -> str:
    return f"{low} + ('0x' || substr(md5({key}), 1, 15))::BIGINT % ({high} - ({low}) + 1)"


_MASKS = ", ".join(f"SELECT doc_id, {i} AS mask, n, {_sql_draw('0', 'floor(n * 0.1e0)::BIGINT', f"concat_ws('|', '3', '1', doc_id, '{i}', 'mask')")} AS length FROM (SELECT doc_id, n_chars AS n FROM documents)" for i in (0, 1)).replace("documents), SELECT", "documents) UNION ALL SELECT")


@query("v10_augmentation_draws", f"WITH m AS ({_MASKS}) SELECT doc_id, mask, length, {_sql_draw('0', 'n - length', "concat_ws('|', '3', '1', doc_id, mask, 'place')")} AS start FROM m")
def draws(spark, sf_dir):
    """Two masks in epoch 1 of each text's length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.time_masks(F.col("n_chars").cast("long"), 2, 0.1, F.lit(3), F.lit(1), F.col("doc_id"))).alias("mask", "m"))
    return rows.select("doc_id", "mask", F.col("m.length").alias("length"), F.col("m.start").alias("start"))


DRAWS_SQL = f"""w AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars >= 40 THEN {_sql_draw("0", "n_chars - 40", "concat_ws('|', '5', doc_id, 'window')")} END AS start FROM documents),
 c AS (SELECT *, list_filter([-4, 4, -5, 5, -6, 6], lambda s: start + s >= 0 AND start + s + 40 <= n) AS ways FROM w), l AS (SELECT *, {_sql_draw("0", "least(8, 80)", "concat_ws('|', '5', doc_id, '0', 'length')")} AS band FROM c)"""


@query("v10_window_draws", f"""WITH {DRAWS_SQL} SELECT doc_id, coalesce(start, -1) AS start, CASE WHEN start IS NULL OR len(ways) = 0 THEN 0 ELSE ways[1 + ({_sql_draw("0", "len(ways) - 1", "concat_ws('|', '5', doc_id, 'shift')")})::INT] END::INT AS shift, band AS band_length, {_sql_draw("0", "80 - band", "concat_ws('|', '5', doc_id, '0', 'start')")} AS band_start FROM l""")
def window_draws(spark, sf_dir):
    """For each text's length the first frame of a window of 40, a shift of 4 to 6 frames, and one band of 80 bins masked."""
    key = (F.lit(5), F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n")).withColumn("start", S.window_start(F.col("n"), 40, *key))
    bands = S.mask_bands(F.lit(80).cast("long"), 1, 8, *key)
    return rows.select("doc_id", F.coalesce("start", F.lit(-1)).alias("start"), S.signed_shift(F.col("start"), F.col("n"), 40, 4, 6, *key).cast("int").alias("shift"), bands[0]["length"].cast("long").alias("band_length"), bands[0]["start"].cast("long").alias("band_start"))


@query("v11_lip_events", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, event_id AS event, CAST(event_id % 50 AS BIGINT) AS k0, unnest(range(-4, 6)) AS o FROM events), s AS (SELECT e.utt_key, event, o, x AS v FROM e JOIN frames f ON f.utt_key = e.utt_key AND f.k = k0 + o),
  r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY v, o) AS n, min(o) OVER (PARTITION BY event) AS a, max(o) OVER (PARTITION BY event) AS b FROM s WHERE o <= 2), m AS (SELECT utt_key, event, o AS lo, o = a OR o = b AS edge FROM r WHERE n = 1),
  d AS (SELECT s.event, s.o, s.v - lag(s.v) OVER (PARTITION BY s.event ORDER BY s.o) AS rise FROM s JOIN m ON m.event = s.event AND s.o BETWEEN lo AND lo + 3), t AS (SELECT event, o, row_number() OVER (PARTITION BY event ORDER BY rise DESC, o) AS n FROM d WHERE rise IS NOT NULL)
 SELECT m.utt_key, m.event, lo::INT AS min_offset, edge, t.o - 0.5e0 AS release_offset FROM m LEFT JOIN t ON t.event = m.event AND t.n = 1""")
def lip_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id AS event", "event_id % 50 AS k0")
    out = A.lip_events(events, frames(spark, sf_dir).withColumnRenamed("x", "z"), "utt_key", 4, 2, 3)
    return out.select("utt_key", "event", "min_offset", "edge", F.col("release_offset").cast("double").alias("release_offset"))


@query("v11_values_at_shifts", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, event_id AS event, CAST(event_id % 50 AS BIGINT) AS k0, event_id % 7 AS n, unnest(range(-5, 6)) AS shift FROM events), w AS (SELECT utt_key, event, shift, k0 - 2 + shift + unnest(range(0, n + 3)) AS k FROM e),
 l AS (SELECT w.utt_key, event, shift, min(CASE WHEN valid THEN x END) AS low FROM w JOIN frames f ON f.utt_key = w.utt_key AND f.k = w.k GROUP BY 1, 2, 3)
 SELECT e.utt_key, e.shift, count(*) AS n, count(CASE WHEN valid THEN x END) AS n_at, round(sum(CASE WHEN valid THEN x END), 4) AS at, count(low) AS n_low, round(sum(low), 4) AS low FROM e LEFT JOIN frames f ON f.utt_key = e.utt_key AND f.k = e.k0 + e.shift LEFT JOIN l ON l.event = e.event AND l.shift = e.shift GROUP BY 1, 2""")
def values_at_shifts(spark, sf_dir):
    """For each event the value at, and the minimum from two frames before to up to six after, a frame number, at shifts of up to five frames."""
    events = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id AS event", "event_id % 50 AS k0", "event_id % 50 - 2 AS first", "event_id % 50 + event_id % 7 AS last")
    values = frames(spark, sf_dir).select("utt_key", "k", F.when(F.col("valid"), F.col("x")).alias("z"))
    out = A.values_at_shifts(events, values, "utt_key", list(range(-5, 6)), longest=9)
    return out.groupBy("utt_key", F.col("shift").cast("long").alias("shift")).agg(F.count("*").alias("n"), F.count("at").alias("n_at"), F.round(F.sum("at"), 4).alias("at"), F.count("low").alias("n_low"), F.round(F.sum("low"), 4).alias("low"))


@query("w5_segment_packing")
def packing(spark, sf_dir):
    rows = I.moving_stats(frames(spark, sf_dir), "utt_key", "k", "x", 5).select("utt_key", "k", (F.col("valid") & (F.col("x") > 50)).alias("active"), F.col("moving_std").alias("activity"))
    return rounded_spans(G.activity_segments(rows, "utt_key", 5.0, least=0.8, most=4.0))


LEVELS = """e AS (SELECT conv_id AS v, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS BIGINT) AS k, (unicode(c) % 40)::DOUBLE AS db FROM (SELECT conv_id, turn, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, string_split(text, '') AS l FROM conversations WHERE text <> '')))"""


@query("w19_label_shift", f"""WITH {LEVELS}, c AS (SELECT v, k + 1 AS k, sum(db) OVER (PARTITION BY v ORDER BY k) AS s FROM e UNION ALL SELECT DISTINCT v, 0, 0e0 FROM e),
  b AS (SELECT conv_id AS v, turn, turn * 1.3e0 AS a, turn * 1.3e0 + 1 AS z FROM conversations), m AS (SELECT v, turn, j, CAST(round_even((a + j * 0.02e0) * 100, 0) AS BIGINT) AS i0, CAST(round_even((z + j * 0.02e0) * 100, 0) AS BIGINT) AS i1 FROM b, (SELECT unnest(range(-40, 41)) AS j)),
  p AS (SELECT v, turn, j, unnest([1, -2, 1, 2, -1, -1]) AS f, unnest([i0 + 15, i0, i0 - 15, i1, i1 - 15, i1 + 15]) AS k FROM m), x AS (SELECT p.v, j, turn, sum(f * s) / 15 AS q FROM p JOIN c ON c.v = p.v AND c.k = p.k GROUP BY 1, 2, 3 HAVING count(*) = 6),
  g AS (SELECT v, j, avg(q) AS score FROM x GROUP BY 1, 2 HAVING count(*) >= 3), t AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY round(score, 9) DESC, j) AS n, coalesce(max(score) OVER (PARTITION BY v) - max(CASE WHEN j = 0 THEN score END) OVER (PARTITION BY v), 0) AS gain FROM g) SELECT v AS video_stem, round(gain, 5) AS gain, CASE WHEN gain >= 1 THEN round(j * 0.02e0, 3) ELSE 0 END AS shift FROM t WHERE n = 1""")
def label_shift(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    chars = rows.select(F.col("conv_id").alias("video_stem"), "turn", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "c"))
    levels = chars.select("video_stem", (F.row_number().over(Window.partitionBy("video_stem").orderBy("turn", "i")) - 1).cast("long").alias("k"), (F.ascii("c") % 40).cast("double").alias("db"))
    labels = rows.select(F.col("conv_id").alias("video_stem"), (F.col("turn") * 1.3).alias("start_s"), (F.col("turn") * 1.3 + 1).alias("end_s"))
    return G.label_shift(labels, levels).select("video_stem", F.round("gain", 5).alias("gain"), "shift")


@query("x1_batch_scorer", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def batch_scorer(spark, sf_dir):
    def load():
        return lambda part: pd.DataFrame({"total": np.stack(part["embedding"]).astype(np.float64).sum(axis=1)})

    out = M.score_batches(table(spark, sf_dir, "embeddings"), load, "total double", ["vec_id"])
    return out.select("vec_id", F.round("total", 6).alias("total"))


# ---------------------------------------------------------------- streams
@contextmanager
def shared_folder(spark, name: str):
    """A folder of its own below the checkpoint folder, removed in the end."""
    cut(spark.range(1))  # sets the checkpoint folder where the session names none
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    try:
        yield where.toString()
    finally:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def event_stream(spark, sf_dir) -> DataFrame:
    """The events' files as a stream: those of the table's folder, or the one file that is the table."""
    path = f"{sf_dir}/events.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    return files.parquet(path) if folder else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("r1_incremental_ingest", "SELECT count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, 0::BIGINT AS again FROM events")
def ingest(spark, sf_dir):
    """The events ingested twice; ``again`` is what the second run added. Files may hold events of the whole month, in any order."""
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    with shared_folder(spark, "ingest") as folder:
        counts = []
        for _ in range(2):
            run = J.ingest(stream, "event_id", "ts", "40 days", f"{folder}/rows", f"{folder}/checkpoint")
            run.awaitTermination()
            if late := J.rows_too_late(run):
                raise ValueError(f"{late} events came after the watermark")
            counts.append(spark.read.parquet(f"{folder}/rows").count())
        rows = spark.read.parquet(f"{folder}/rows")
        again = F.lit(counts[1] - counts[0]).cast("long").alias("again")
        return cut(rows.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), again))


@query("r2_latest_status", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1")
def latest(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    with shared_folder(spark, "status") as folder:
        J.latest_status(stream, "user_id", ["ts", "event_id"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        return cut(J.current_status(spark, f"{folder}/table").select("user_id", "event_id", "event_type"))


@query("s7_manifest_writer", f"WITH {UTT}, w AS (SELECT *, CASE WHEN video_stem % 3 = 0 THEN duration + 1 ELSE duration END AS d FROM utt) SELECT split_dir, count(*) AS n, count(DISTINCT video_stem) AS videos, round(sum(d), 4) AS seconds FROM w GROUP BY 1")
def manifest_writer(spark, sf_dir):
    """Two writes: all videos, then every third again with other durations; rows of done videos as they lie there."""
    rows = utterances(spark, sf_dir)
    again = rows.filter("video_stem % 3 = 0").withColumn("duration", F.col("duration") + 1)
    with shared_folder(spark, "manifests") as folder:
        write_manifests(rows, folder)
        write_manifests(again, folder)
        out = read_done_manifests(spark, folder)
        return cut(out.groupBy("split_dir").agg(F.count("*").alias("n"), F.countDistinct("video_stem").alias("videos"), F.round(F.sum("duration"), 4).alias("seconds")))


@query("s1_label_reader", """WITH c AS (SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn * 2e0 + 1.5e0) AS last_end, count(*) FILTER (text IS NOT NULL) AS n_texts, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1), s AS (SELECT *, concat('lip_J_1_F_02_C', lpad((conv_id % 1000)::VARCHAR, 3, '0'), '_A_', lpad(conv_id::VARCHAR, 3, '0')) AS video_stem FROM c)
 SELECT video_stem, concat('C', lpad((conv_id % 1000)::VARCHAR, 3, '0')) AS speaker, (60 * (conv_id % 9) + 5)::DOUBLE AS duration_s, n, turns AS sentence_ids, first * 2e0 AS first_s, last_end, n_texts, (SELECT count(*) FROM c WHERE conv_id % 7 = 3) AS n_rejects FROM s WHERE conv_id % 7 <> 3""")
def label_reader(spark, sf_dir):
    """A label document for each conversation, sentences in no order, written to files and read back; every seventh has more
    face than lip boxes and is rejected."""
    number = F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0")
    stem = F.concat(F.lit("lip_J_1_F_02_C"), number, F.lit("_A_"), F.lpad(F.col("conv_id").cast("string"), 3, "0"))
    said = F.struct(F.col("turn").alias("ID"), F.lit("t").alias("topic"), F.col("text").alias("sentence_text"), (F.col("turn") * 2.0).alias("start_time"), (F.col("turn") * 2.0 + 1.5).alias("end_time"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(said))).alias("Sentence_info"))
    box = F.array(*[F.lit(v) for v in (10, 20, 30, 40)])
    boxes = lambda n: F.struct(F.array_repeat(box, n).alias("xtl_ytl_xbr_ybr"))
    video = F.struct(F.concat(stem, F.lit(".mp4")).alias("video_Name"), F.lit("mp4").alias("video_Format"), F.concat(F.lit("0:0"), (F.col("conv_id") % 9).cast("string"), F.lit(":05")).alias("video_Duration"), F.lit(30.0).alias("FPS"), F.lit("1920*1080").alias("Resolution"))
    docs = rows.select("conv_id", F.to_json(F.array(F.struct(
        video.alias("Video_info"), F.struct(F.lit(2).alias("Noise")).alias("Audio_env"), "Sentence_info", F.struct(F.concat(F.lit("C"), number).alias("speaker_ID")).alias("speaker_info"),
        F.struct(boxes(F.when(F.col("conv_id") % 7 == 3, 2).otherwise(1)).alias("Face_bounding_box"), boxes(F.lit(1)).alias("Lip_bounding_box")).alias("Bounding_box_info"),
    ))).alias("value"))
    with shared_folder(spark, "labels") as folder:
        docs.write.partitionBy("conv_id").text(f"{folder}/in")
        videos, rejects = read_labels(spark, f"{folder}/in/*")
        # by document: names of videos come again
        said = lambda c: F.transform("sentences", lambda s: s[c])
        out = videos.filter("size(sentences) > 0").select(
            "video_stem", F.col("fields.speaker").alias("speaker"), F.col("duration_s").cast("double").alias("duration_s"), F.size("sentences").cast("long").alias("n"), F.array_join(F.array_sort(said("sentence_id")).cast("array<string>"), ",").alias("sentence_ids"),
            F.array_min(said("start_s")).alias("first_s"), F.array_max(said("end_s")).alias("last_end"), F.size(F.filter("sentences", lambda s: s["text"].isNotNull())).cast("long").alias("n_texts"),
        )
        return cut(out.crossJoin(F.broadcast(rejects.agg(F.count("*").alias("n_rejects")))))


@query("s2_media_index", """WITH f AS (SELECT concat(page_id, CASE page_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.wav' ELSE '.txt' END) AS key, octet_length(encode(coalesce(html, '')))::BIGINT AS size, page_id % 11 = 0 AS plain FROM pages) SELECT key, size, NOT plain AS archived FROM f WHERE NOT ends_with(key, '.txt')""")
def media(spark, sf_dir):
    """The pages as media files in seven archives, every eleventh as a file of its own; what the index finds."""
    ext = F.when(F.col("page_id") % 3 == 0, ".MP4").when(F.col("page_id") % 3 == 1, ".wav").otherwise(".txt")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), ext).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    plain = F.col("page_id") % 11 == 0
    packed = rows.filter(~plain).groupBy((F.col("page_id") % 7).alias("a")).agg(archive_bytes(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("d/"), "name").alias("name"), "content")))).alias("content"))
    with shared_folder(spark, "media") as folder:
        write_files(rows.filter(plain), folder)
        write_files(packed.select(F.concat(F.lit("part"), F.col("a").cast("string"), F.lit(".tar")).alias("name"), "content"), folder)
        return cut(media_index(spark, folder).select("key", "size", F.col("offset").isNotNull().alias("archived")))


def feature_files(spark, sf_dir) -> DataFrame:
    """A feature file (name, content) for each user: a frame for each event; every ninth user's cues are too narrow."""
    w = F.array_sort(F.collect_list(F.struct("event_id", "value", (F.col("event_type") != "error").alias("valid"))))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(w.alias("e"))
    repeat = lambda times: F.flatten(F.transform("e", lambda x: F.array_repeat(x["value"], times)))
    cue = F.when(F.col("user_id") % 9 == 4, repeat(F.lit(7))).otherwise(repeat(F.lit(8)))
    flags, sound = F.transform("e", lambda x: x["valid"].cast("tinyint")), F.transform("e", lambda x: (x["event_id"] % 1000).cast("short"))
    name = F.concat(F.col("user_id").cast("string"), F.lit(".npz")).alias("name")
    return feature_bytes(rows.select(name, "user_id", repeat(F.lit(80)).cast("array<float>").alias("lm"), cue.cast("array<float>").alias("cue"), flags.alias("valid"), sound.alias("audio")))


@query("s4_feature_loader", """WITH g AS (SELECT user_id, count(*) AS n, sum(event_id % 1000)::BIGINT AS audio, sum((event_type <> 'error')::INT)::BIGINT AS n_valid, sum(value) * 80 AS lm FROM events GROUP BY 1)
 SELECT concat(user_id, '.npz') AS name, user_id % 9 = 4 AS bad, CASE WHEN user_id % 9 <> 4 THEN n::INT END AS n_frames, CASE WHEN user_id % 9 <> 4 THEN audio END AS audio, CASE WHEN user_id % 9 <> 4 THEN n_valid END AS n_valid, CASE WHEN user_id % 9 <> 4 THEN round(lm, 0) END AS lm FROM g""")
def feature_loader(spark, sf_dir):
    with shared_folder(spark, "features") as folder:
        write_files(feature_files(spark, sf_dir), folder)
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
        rows = read_features(spark, folder)
        lm = F.round(F.aggregate("lm", F.lit(0.0), lambda a, x: a + x.cast("double")), 0)
        return cut(rows.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.col("reason").isNotNull().alias("bad"), "n_frames", total("audio").alias("audio"), total("valid").alias("n_valid"), lm.alias("lm")))


@query("v12_content_check", "SELECT concat(user_id, '.npz') AS name, user_id % 7 <> 3 AS sound FROM (SELECT DISTINCT user_id FROM events) q")
def content_check(spark, sf_dir):
    """The same files, a byte in the middle of every seventh user's turned over."""
    files = feature_files(spark, sf_dir)
    middle = F.floor(F.length("content") / 2).cast("int")
    turned = F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("content", middle, 1)), 16, 10).cast("int")), 2, "0"))
    damaged = F.concat(F.substring("content", 1, middle - 1), turned, F.substring("content", middle + 1, F.length("content")))
    with shared_folder(spark, "content") as folder:
        write_files(files.withColumn("content", F.when(F.col("user_id") % 7 == 3, damaged).otherwise(F.col("content"))), folder)
        return cut(check_content(spark, folder).select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.col("problem").isNull().alias("sound")))


@query("s5_process_log", "SELECT event_type AS decoder, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, sum(user_id * 10)::BIGINT AS frames, round(avg(value / 100), 6) AS valid_ratio FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def process_log(spark, sf_dir):
    """The events as lines of a processing log, every seventh broken off, read back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("stem"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") * 10).alias("frames"), (F.col("value") / 100).alias("valid_ratio"), F.col("event_type").alias("decoder"))).alias("line"))
    lines = rows.select(F.when(F.col("event_id") % 7 == 0, F.substring("line", 1, 12)).otherwise(F.col("line")).alias("value"))
    with shared_folder(spark, "log") as folder:
        lines.write.text(f"{folder}/in")
        log = read_process_log(spark, f"{folder}/in")
        return cut(log.groupBy("decoder").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum("frames").alias("frames"), F.round(F.avg("valid_ratio"), 6).alias("valid_ratio")))


@query("s5_console", "SELECT count(*) AS n, sum(event_id)::BIGINT AS steps, round(sum(round(value, 3)), 3) AS ctc, round(avg(user_id + 0.5e0), 6) AS frames_per_s FROM events WHERE event_type <> 'error'")
def console(spark, sf_dir):
    """The events as progress lines of a training console among other lines."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "restarting ...").otherwise(F.format_string("step %d | loss 1.0 ctc %.3f | lr 1.00e-04 gnorm 0.5 | %.1f fr/s", "event_id", "value", F.col("user_id") + 0.5)).alias("value"))
    with shared_folder(spark, "console") as folder:
        rows.write.text(f"{folder}/in")
        out = read_console(spark, f"{folder}/in")
        return cut(out.agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.round(F.sum("ctc"), 3).alias("ctc"), F.round(F.avg("frames_per_s"), 6).alias("frames_per_s")))


@query("s6_alignment_reader", "SELECT user_id::VARCHAR AS utt_id, count(*) AS n_syllables, 2 * count(*) AS n_tokens, round(sum(value), 6) AS start_s, sum(event_id)::BIGINT AS ids FROM events WHERE user_id % 9 <> 4 GROUP BY 1")
def alignment_reader(spark, sf_dir):
    """Each user's events as the syllables of an aligned utterance of two tokens each, in JSON arrays, read back; utterances
    that could not be aligned have no rows."""
    token = lambda k: F.struct(F.col("event_id").cast("int").alias("id"), F.lit("x").alias("name"), (F.col("value") + k).alias("start_s"))
    syllable = F.struct(F.lit("가").alias("char"), F.lit(0).alias("word"), F.col("value").alias("start_s"), F.array(token(0), token(1)).alias("tokens"))
    records = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(syllable).alias("syllables")).select(F.col("user_id").cast("string").alias("utt_id"), (F.col("user_id") % 9 != 4).alias("ok"), "syllables")
    with shared_folder(spark, "alignments") as folder:
        write_alignments(records, f"{folder}/in")
        read = read_alignments(spark, f"{folder}/in")
        s = explode_syllables(read).groupBy("utt_id").agg(F.count("*").alias("n_syllables"), F.round(F.sum("start_s"), 6).alias("start_s"))
        t = explode_tokens(read).groupBy("utt_id").agg(F.count("*").alias("n_tokens"), (F.sum("id") / 2).cast("long").alias("ids"))
        return cut(s.join(t, "utt_id").select("utt_id", "n_syllables", "n_tokens", "start_s", "ids"))


@query("s3_manifest_reader", f"WITH {UTT} SELECT speaker, count(*) AS n, round(sum(duration), 4) AS seconds, (SELECT count(*) FROM utt WHERE has_unk) AS n_bad FROM utt WHERE NOT has_unk GROUP BY 1")
def manifest_reader(spark, sf_dir):
    """The utterances as JSON lines, those with unknown characters without a required key, read back."""
    rows = utterances(spark, sf_dir).select("utt_id", F.col("video_stem").cast("string").alias("video_stem"), "split_dir", "speaker", "angle", F.col("n_frames").cast("int").alias("n_frames"), "duration", F.lit("").alias("text"), "has_unk", F.lit("a.npz").alias("npz"), F.when(~F.col("has_unk"), "m.mp4").alias("mouth_mp4"))
    with shared_folder(spark, "lines") as folder:
        rows.write.json(f"{folder}/m")
        good, problems = read_manifests(spark, f"{folder}/m")
        bad = problems.agg(F.count("*").alias("n_bad"))
        return cut(good.groupBy("speaker").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("seconds")).crossJoin(F.broadcast(bad)))


RESAMPLED = f"""{FRAMES}, f AS (SELECT utt_key, k, CASE WHEN valid THEN k / 25e0 END AS t FROM frames),
 r(utt_key, k, time, gap, fixed, grid) AS (SELECT utt_key, k, coalesce(t, 0), 1 / 30e0, CASE WHEN t IS NULL THEN 1 ELSE 0 END, 0::BIGINT FROM f WHERE k = 0 UNION ALL
  SELECT r.utt_key, f.k, CASE WHEN f.t > r.time + 1e-6 THEN f.t ELSE r.time + gap END, CASE WHEN f.t > r.time + 1e-6 THEN f.t - r.time ELSE gap END, fixed + CASE WHEN f.t > r.time + 1e-6 THEN 0 ELSE 1 END,
   greatest(grid, CAST(ceil(((r.time + CASE WHEN f.t > r.time + 1e-6 THEN f.t ELSE r.time + gap END) / 2 - 1e-6) * 30) AS BIGINT)) FROM r JOIN f ON f.utt_key = r.utt_key AND f.k = r.k + 1),
 z AS (SELECT *, row_number() OVER (PARTITION BY utt_key ORDER BY k DESC) AS n FROM r)"""


RESAMPLED_SQL = f"WITH RECURSIVE {RESAMPLED} SELECT CAST(utt_key AS VARCHAR) AS video, (k + 1)::BIGINT AS n, greatest(grid, CAST(ceil((time + gap - 1e-6) * 30) AS BIGINT)) AS copies, fixed::BIGINT AS fixed FROM z WHERE n = 1"


def timed_frames(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).select(F.col("utt_key").cast("string").alias("video"), F.col("k").cast("long").alias("frame"), F.when(F.col("valid"), F.col("k") / 25.0).alias("t"))


def resampled(copies: DataFrame) -> DataFrame:
    return copies.groupBy("video").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("fixed").alias("fixed"))


@query("r3_frame_resampler", RESAMPLED_SQL)
def resampler(spark, sf_dir):
    return resampled(J.resample_batch(timed_frames(spark, sf_dir), 30.0))


@query("r3_resampler_stream", RESAMPLED_SQL)
def resampler_stream(spark, sf_dir):
    """The same frames as a stream that arrives in three files' time and stops each time; no frame is marked as a video's
    last, so every state ends by its timer once a clock has moved the watermark past all frames."""
    at = lambda seconds: F.timestamp_millis((seconds * 1000).cast("long") + 1_700_000_000_000)
    rows = timed_frames(spark, sf_dir).select("video", "frame", "t", at(F.col("frame") / 25).alias("at"), F.lit(False).alias("last"))
    with shared_folder(spark, "frames") as folder, J.with_timers(spark):
        rows = cut(rows)
        longest = rows.agg(F.max("frame")).first()[0] or 0
        none = spark.range(1).select(F.lit(None).cast("string").alias("video"), F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("t"))
        clock = none.select("*", at(F.lit(longest / 25 + 120)).alias("at"), F.lit(False).alias("last"))
        half = longest // 2
        for part in (rows.filter(F.col("frame") <= half), rows.filter(F.col("frame") > half), clock):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            copies = J.resample_stream(stream, 30.0, delay="5 seconds", patience=60.0)
            run = copies.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            run.trigger(availableNow=True).start().awaitTermination()
        return cut(resampled(spark.read.parquet(f"{folder}/out")))
