"""Queries over manifests: parsing, splits, joins, subsets, batches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import manifest as M
from ..operators import ordering
from .adapters import FILES, UTT, VIDEOS, files, table, utterances, videos
from .registry import query

STEM = "concat('lip_', CASE WHEN l_partkey % 3 = 0 THEN 'J' ELSE 'K' END, '_', l_linenumber, '_', CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'M' END, '_', l_suppkey % 60, '_C', l_suppkey, '_', l_returnflag, CASE WHEN l_tax > 0.07e0 THEN '-' ELSE '_' END, l_orderkey % 1000)"
SPLIT = {"val": ["S1", "S2", "S3"], "test": ["S4", "S5"], "train_dirs": ["O"], "angles": "A,R", "min_duration": 1.0, "max_duration": 15.0}
SPLIT_SQL = f"""{UTT}, ruled AS (SELECT *, CASE WHEN has_unk THEN 'has_unk' WHEN n_frames <= 0 OR duration < 1 OR duration > 15 THEN 'duration'
  WHEN angle NOT IN ('A', 'R') THEN 'angle' WHEN speaker NOT IN ('S1','S2','S3','S4','S5') AND split_dir <> 'O' THEN 'no_split' END AS drop_reason FROM utt),
 assigned AS (SELECT *, CASE WHEN drop_reason IS NULL THEN CASE WHEN speaker IN ('S4','S5') THEN 'test' WHEN speaker IN ('S1','S2','S3') THEN 'val' ELSE 'train' END END AS split FROM ruled)"""


def assigned(spark, sf_dir):
    return M.assign_split(utterances(spark, sf_dir), **SPLIT)


@query("p1_parse_stem", f"""SELECT stem_group, gender, angle, count(*) AS n, count(DISTINCT speaker) AS speakers, sum(CAST(session AS BIGINT)) AS sessions FROM (
 SELECT CASE WHEN ok THEN regexp_extract(stem, p, 1) END AS stem_group, CASE WHEN ok THEN regexp_extract(stem, p, 3) END AS gender, CASE WHEN ok THEN regexp_extract(stem, p, 5) END AS speaker,
  CASE WHEN ok THEN regexp_extract(stem, p, 6) END AS angle, CASE WHEN ok THEN regexp_extract(stem, p, 7) END AS session
 FROM (SELECT stem, p, regexp_matches(stem, p) AS ok FROM (SELECT {STEM} AS stem, '^lip_([A-Z])_([0-9]+)_([FM])_([0-9]+)_([A-Z][0-9]+)_([A-Z])_([0-9]+)$' AS p FROM lineitem))) GROUP BY ALL""")
def parse_stems(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(labels.parse_stem(F.expr(STEM)).alias("s")).select("s.*")
    return s.groupBy(F.col("group").alias("stem_group"), "gender", "angle").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"), F.sum(F.col("session").cast("long")).alias("sessions"))


DURATION = "CASE WHEN l_linenumber % 3 = 0 THEN concat(l_linenumber, ':', l_suppkey % 60, ':', l_partkey % 60) WHEN l_linenumber % 3 = 1 THEN concat(l_suppkey % 60, ':', l_partkey % 60) ELSE CAST(l_partkey AS VARCHAR(20)) END"


@query("p2_parse_duration_resolution", """SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 3600 + (l_suppkey % 60) * 60 + l_partkey % 60
   WHEN l_linenumber % 3 = 1 THEN (l_suppkey % 60) * 60 + l_partkey % 60 ELSE l_partkey END)::DOUBLE AS seconds, max(1000 + l_suppkey)::BIGINT AS width, max(500 + l_linenumber)::BIGINT AS height
 FROM lineitem GROUP BY 1, 2""")
def durations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("d", labels.parse_duration(F.expr(DURATION)))
    rows = rows.withColumn("r", labels.parse_resolution(F.expr("concat(1000 + l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN '*' ELSE 'x' END, 500 + l_linenumber)")))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("d").alias("seconds"), F.max("r.width").cast("long").alias("width"), F.max("r.height").cast("long").alias("height"))


@query("p3_bbox_order", """WITH b AS (SELECT o_custkey, count(*) AS n, sum((CAST(o_totalprice AS BIGINT) % 2500 > 1920)::INT + (o_orderkey % 1500 > 1080)::INT) AS xy,
   sum((o_orderkey % 1500 > 1920)::INT + (CAST(o_totalprice AS BIGINT) % 2500 > 1080)::INT) AS yx FROM orders GROUP BY 1)
 SELECT o_custkey, n AS n_boxes, CASE WHEN xy < yx THEN 'xy' ELSE 'yx' END AS box_order FROM b""")
def box_orders(spark, sf_dir):
    box = F.expr("array(0, 0, CAST(CAST(rint(o_totalprice) AS BIGINT) % 2500 AS INT), CAST(o_orderkey % 1500 AS INT))")  # the nearest whole number, as in SQL
    rows = table(spark, sf_dir, "orders").withColumn("box", box).groupBy("o_custkey").agg(F.collect_list("box").alias("boxes"))
    return rows.select("o_custkey", F.size("boxes").cast("long").alias("n_boxes"), labels.bbox_order(F.col("boxes"), F.lit(1920), F.lit(1080)).alias("box_order"))


@query("p10_safe_path", """SELECT page_id, (p <> '' AND p NOT LIKE '/%' AND NOT list_contains(string_split(p, '/'), '..') AND p NOT LIKE '%:%') AS safe
 FROM (SELECT page_id, replace(CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN substr(url, 9) WHEN 2 THEN '' WHEN 3 THEN concat('a\\', '..', '\\', page_id) ELSE concat('/abs/', page_id) END, '\\', '/') AS p FROM pages)""")
def safe_paths(spark, sf_dir):
    path = F.when(F.col("page_id") % 5 == 0, F.col("url")).when(F.col("page_id") % 5 == 1, F.expr("substr(url, 9)")).when(F.col("page_id") % 5 == 2, "")
    path = path.when(F.col("page_id") % 5 == 3, F.concat(F.lit("a\\..\\"), F.col("page_id"))).otherwise(F.concat(F.lit("/abs/"), F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", labels.is_safe_path(path).alias("safe"))


@query("p11_assign_split", f"WITH {SPLIT_SQL} SELECT coalesce(split, '-') AS split, coalesce(drop_reason, '-') AS drop_reason, count(*) AS n FROM assigned GROUP BY 1, 2")
def splits(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy(F.coalesce("split", F.lit("-")).alias("split"), F.coalesce("drop_reason", F.lit("-")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query("p12_job_filters", f"WITH {UTT} SELECT speaker, count(*) AS n FROM utt WHERE angle IN ('A', 'N') AND speaker IN ('S1', 'S7', 'S9') GROUP BY 1")
def job_filters(spark, sf_dir):
    rows = utterances(spark, sf_dir).filter(labels.among(F.col("angle"), "a, n") & labels.among(F.col("speaker"), ["S1", "S7", "s9"]) & labels.among(F.col("split_dir"), "all"))
    return rows.groupBy("speaker").agg(F.count("*").alias("n"))


@query("p13_audio_key", f"WITH {UTT} SELECT concat(speaker, '|', session, '|', CASE WHEN sentence_id = 3 THEN utt_id ELSE CAST(sentence_id AS VARCHAR) END) AS audio_key, count(*) AS n, count(DISTINCT angle) AS angles FROM utt GROUP BY 1")
def audio_keys(spark, sf_dir):
    key = labels.audio_key(F.col("speaker"), F.col("session"), F.expr("nullif(sentence_id, 3)"), F.col("utt_id"))
    return utterances(spark, sf_dir).groupBy(key.alias("audio_key")).agg(F.count("*").alias("n"), F.countDistinct("angle").alias("angles"))


@query("p14_resample", f"""WITH {UTT}, n AS (SELECT DISTINCT n_frames FROM utt), l AS (SELECT n_frames, CAST(ceil(n_frames * 25e0 / 30e0 - 1e-9) AS BIGINT) AS n_out FROM n)
 SELECT n_frames, n_out, list_sum(list_transform(range(0, n_out), lambda k: CAST(least(floor(k * (30e0 / 25e0) + 0.5e0), n_frames - 1) AS BIGINT)))::BIGINT AS index_sum FROM l""")
def resample(spark, sf_dir):
    rows = utterances(spark, sf_dir).select("n_frames").distinct()
    n = F.col("n_frames").cast("int")
    total = F.aggregate(labels.resample_indices(n, 30.0, 25.0), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("n_frames", labels.resampled_length(n, 30.0, 25.0).cast("long").alias("n_out"), total.alias("index_sum"))


@query("p15_gather", """SELECT vec_id, list_sum(list_transform(range(0, 32), lambda k: CAST(embedding[CAST(least(floor(k * 2e0 + 0.5e0), 63) AS BIGINT) + 1] AS DOUBLE)))::DECIMAL(18,4)::DOUBLE AS total FROM embeddings""")
def gathered(spark, sf_dir):
    index = labels.resample_indices(F.lit(64), 50.0, 25.0)
    taken = labels.gather(F.col("embedding").cast("array<double>"), index)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(taken, F.lit(0.0), lambda a, x: a + x).cast("decimal(18,4)").cast("double").alias("total"))


@query("p16_snr_bucket", """SELECT event_type, CASE WHEN value IS NULL OR value >= 20 THEN 0 WHEN value >= 10 THEN 1 WHEN value >= 0 THEN 2 ELSE 3 END AS bucket, count(*) AS n,
   sum(CASE WHEN user_id % 4 = 0 THEN 25e0 WHEN user_id % 4 = 1 THEN 15e0 WHEN user_id % 4 = 2 THEN 5e0 ELSE -5e0 END) AS midpoints FROM events GROUP BY 1, 2""")
def snr_buckets(spark, sf_dir):
    logits = F.array(*[(F.col("user_id") % 4 == k).cast("double") for k in range(4)])
    rows = table(spark, sf_dir, "events").withColumn("bucket", labels.snr_bucket(F.col("value"))).withColumn("mid", labels.snr_of_logits(logits))
    return rows.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.sum("mid").alias("midpoints"))


@query("p17_gates", """WITH s AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS dsp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 2 END AS model, (event_id % 10) / 10e0 AS ratio FROM events),
  c AS (SELECT *, coalesce((dsp + model) / 2, dsp, model) AS snr FROM s)
 SELECT event_type, CASE WHEN snr IS NULL THEN 'video' WHEN snr >= 10 THEN 'av' WHEN ratio < 0.2e0 THEN 'audio' ELSE 'video' END AS mode,
   CASE WHEN snr IS NULL THEN 'visual' WHEN ratio < 0.2e0 THEN 'energy' WHEN snr >= 10 THEN 'energy' ELSE 'visual' END AS vad, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def gates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "IF(event_id % 7 = 0, NULL, value) AS dsp", "IF(event_id % 5 = 0, NULL, value / 2) AS model", "(event_id % 10) / 10e0 AS ratio")
    rows = rows.withColumn("snr", labels.combine_snr(F.col("dsp"), F.col("model")))
    mode = labels.choose_mode(F.col("snr"), 10.0, visual_ratio=F.col("ratio"))
    return rows.groupBy("event_type", mode.alias("mode"), labels.choose_vad(F.col("snr"), 10.0, visual_ratio=F.col("ratio")).alias("vad")).agg(F.count("*").alias("n"))


@query("p18_srt_time", f"""WITH {UTT}, t AS (SELECT utt_id, CAST(round_even(greatest(end_s * 3.7e0 - 30, 0e0) * 1000, 0) AS BIGINT) AS ms FROM utt)
 SELECT utt_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS cue_time FROM t""")
def srt_times(spark, sf_dir):
    return utterances(spark, sf_dir).select("utt_id", labels.srt_time(F.expr("end_s * 3.7e0 - 30")).alias("cue_time"))


@query("p19_window_eligibility", f"""WITH {UTT}, w AS (SELECT angle, CAST(ceil(n_frames * 25e0 / 30e0 - 1e-9) AS BIGINT) AS n_video, CAST(duration * 16000 AS BIGINT) AS samples FROM utt),
  a AS (SELECT angle, n_video, CASE WHEN samples < 400 THEN 0 ELSE (1 + (samples - 400) // 160) // 4 END AS n_audio FROM w), n AS (SELECT *, least(n_video, n_audio) AS n FROM a)
 SELECT angle, count(*) AS eligible, sum((n - 25) // 2)::BIGINT AS starts FROM n WHERE n_video >= 27 AND n >= 25 GROUP BY 1""")
def eligible(spark, sf_dir):
    rows = utterances(spark, sf_dir).select("angle", labels.resampled_length(F.col("n_frames"), 30.0, 25.0).cast("long").alias("n_video"), labels.audio_frames(F.expr("CAST(round(duration * 16000) AS BIGINT)")).alias("n_audio"))
    rows = rows.withColumn("n", F.least("n_video", "n_audio")).filter("n_video >= 27 and n >= 25")
    return rows.groupBy("angle").agg(F.count("*").alias("eligible"), F.sum(labels.window_start(F.col("n"), 25)).alias("starts"))


@query("p20_stable_random", f"WITH {UTT}, h AS (SELECT speaker, utt_id, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat('7|', utt_id, '|start')), utt_id) AS r FROM utt) SELECT speaker, max(CASE WHEN r = 1 THEN utt_id END) AS first_pick, max(CASE WHEN r = 2 THEN utt_id END) AS second_pick FROM h WHERE r <= 2 GROUP BY 1")
def stable_random(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("speaker").orderBy(ordering.hash_order(F.lit(7), F.col("utt_id"), F.lit("start")), "utt_id"))
    rows = utterances(spark, sf_dir).withColumn("r", rank).filter("r <= 2")
    return rows.groupBy("speaker").agg(F.max(F.expr("CASE WHEN r = 1 THEN utt_id END")).alias("first_pick"), F.max(F.expr("CASE WHEN r = 2 THEN utt_id END")).alias("second_pick"))


# ---------------------------------------------------------------- joins and set operations
@query("j1_label_media", f"WITH {VIDEOS}, {UTT} SELECT 'paired' AS kind, count(*) AS n FROM utt JOIN videos USING (video_stem) WHERE part < 30 UNION ALL SELECT 'no_media', count(*) FROM utt WHERE video_stem NOT IN (SELECT video_stem FROM videos WHERE part < 30)")
def label_media(spark, sf_dir):
    pairs, alone = M.pair_with_media(utterances(spark, sf_dir), videos(spark, sf_dir).filter("part < 30"))
    return pairs.agg(F.lit("paired").alias("kind"), F.count("*").alias("n")).union(alone.agg(F.lit("no_media"), F.count("*")))


@query("j2_resume", f"WITH {VIDEOS} SELECT part, count(*) AS todo, min(video_stem) AS first_stem FROM videos v WHERE NOT EXISTS (SELECT 1 FROM videos d WHERE d.done AND d.video_stem = v.video_stem) GROUP BY 1")
def resume(spark, sf_dir):
    v = videos(spark, sf_dir)
    return M.to_do(v, v.filter("done")).groupBy("part").agg(F.count("*").alias("todo"), F.min("video_stem").alias("first_stem"))


@query("j3_merge_parts", f"""WITH {VIDEOS}, parts AS (SELECT video_stem, part AS part_order, done OR part % 2 = 0 AS finished FROM videos UNION ALL SELECT video_stem, 40 + part, done FROM videos WHERE video_stem % 3 = 0),
  dest AS (SELECT video_stem, video_stem % 50 <> 0 AS healthy FROM videos WHERE video_stem % 10 = 0),
  n AS (SELECT p.*, d.healthy, row_number() OVER (PARTITION BY p.video_stem, p.finished ORDER BY part_order) AS k FROM parts p LEFT JOIN dest d ON p.video_stem = d.video_stem)
 SELECT part_order, sum((NOT finished)::INT)::BIGINT AS unfinished, sum((finished AND k > 1)::INT)::BIGINT AS duplicate, sum(coalesce(finished AND k = 1 AND healthy, false)::INT)::BIGINT AS already,
   sum(coalesce(finished AND k = 1 AND NOT healthy, false)::INT)::BIGINT AS repair, sum((finished AND k = 1 AND healthy IS NULL)::INT)::BIGINT AS merged FROM n GROUP BY 1""")
def merge_parts(spark, sf_dir):
    v = videos(spark, sf_dir)
    parts = v.selectExpr("part AS part_order", "video_stem", "done OR part % 2 = 0 AS finished").union(v.filter("video_stem % 3 = 0").selectExpr("40 + part", "video_stem", "done"))
    dest = v.filter("video_stem % 10 = 0").selectExpr("video_stem", "video_stem % 50 <> 0 AS healthy")
    merged = M.merge_parts(parts, dest)
    kinds = ["unfinished", "duplicate", "already", "repair", "merged"]
    return merged.groupBy("part_order").agg(*[F.count_if(F.col("class") == k).alias(k) for k in kinds])


@query("j4_referential_check", f"""WITH {FILES}, named AS (SELECT page_id % 50 AS video_stem, page_id AS utt_id, unnest([rel_path, concat(rel_path, '.mp4')]) AS rel_path FROM files)
 SELECT n.video_stem, CASE WHEN f.size IS NULL THEN 'missing' ELSE 'empty' END AS problem, count(*) AS n FROM named n LEFT JOIN (SELECT DISTINCT rel_path, size FROM (SELECT rel_path, max(size) AS size FROM files GROUP BY 1)) f ON n.rel_path = f.rel_path WHERE f.size IS NULL OR f.size = 0 GROUP BY 1, 2""")
def referential(spark, sf_dir):
    f = files(spark, sf_dir)
    rows = f.selectExpr("page_id % 50 AS video_stem", "page_id AS utt_id", "rel_path AS npz", "concat(rel_path, '.mp4') AS mp4")
    have = f.groupBy("rel_path").agg(F.max("size").alias("size"))
    return M.missing_files(rows, ["npz", "mp4"], have).groupBy("video_stem", "problem").agg(F.count("*").alias("n"))


@query("j5_copy_plan", f"""WITH {FILES}, src AS (SELECT page_id % 40 AS video_stem, concat(page_id, CASE WHEN page_id < 40 THEN '.done' ELSE '.npz' END) AS rel_path, size FROM files),
  c AS (SELECT s.*, rel_path LIKE '%.done' AS last, NOT coalesce(s.size = d.size, false) AS copy FROM src s LEFT JOIN (SELECT concat(page_id, CASE WHEN page_id < 40 THEN '.done' ELSE '.npz' END) AS rel_path, CASE WHEN page_id % 6 = 0 THEN size + 1 ELSE size END AS size FROM files WHERE page_id % 4 <> 0) d USING (rel_path)),
  k AS (SELECT *, max(CASE WHEN copy AND NOT last THEN 1 ELSE 0 END) OVER (PARTITION BY video_stem) AS other FROM c)
 SELECT video_stem, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, max(last)::BOOLEAN AS marker FROM k WHERE copy OR (last AND other = 1) GROUP BY 1""")
def copies(spark, sf_dir):
    name = "concat(page_id, CASE WHEN page_id < 40 THEN '.done' ELSE '.npz' END) AS rel_path"
    src = files(spark, sf_dir).selectExpr("page_id % 40 AS video_stem", name, "size")
    dest = files(spark, sf_dir).filter("page_id % 4 <> 0").selectExpr(name, "CASE WHEN page_id % 6 = 0 THEN size + 1 ELSE size END AS size")
    plan = M.copy_plan(src, dest)
    return plan.groupBy("video_stem").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max(F.col("rel_path").endswith(".done")).alias("marker"))


@query("u1_stem_sets", """WITH m AS (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT o_orderkey AS s FROM orders WHERE o_orderstatus = 'F')
 SELECT 'finished' AS kind, count(*) AS n FROM (SELECT s FROM m INTERSECT SELECT s FROM d) UNION ALL SELECT 'unfinished', count(*) FROM (SELECT s FROM m EXCEPT SELECT s FROM d) UNION ALL SELECT 'orphan', count(*) FROM (SELECT s FROM d EXCEPT SELECT s FROM m)""")
def stem_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m, d = o.filter("o_orderkey % 3 <> 0").select("o_orderkey"), o.filter("o_orderstatus = 'F'").select("o_orderkey")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(m.intersect(d), "finished").union(count(m.subtract(d), "unfinished")).union(count(d.subtract(m), "orphan"))


@query("u2_union_of_parts", f"WITH {VIDEOS}, p AS (SELECT video_stem, part AS ord FROM videos UNION ALL SELECT video_stem, part + 100 FROM videos UNION ALL SELECT video_stem + 7, part + 200 FROM videos), r AS (SELECT *, row_number() OVER (PARTITION BY video_stem ORDER BY ord) AS k FROM p) SELECT ord // 100 AS source, count(*) AS n FROM r WHERE k = 1 GROUP BY 1")
def union_parts(spark, sf_dir):
    from pyspark.sql import Window

    v = videos(spark, sf_dir)
    parts = v.selectExpr("video_stem", "part AS ord").union(v.selectExpr("video_stem", "part + 100")).union(v.selectExpr("video_stem + 7", "part + 200"))
    first = parts.withColumn("k", F.row_number().over(Window.partitionBy("video_stem").orderBy("ord"))).filter("k = 1")
    return first.groupBy(F.floor(F.col("ord") / 100).alias("source")).agg(F.count("*").alias("n"))


@query("u3_append_unseen", "SELECT props AS line, min(event_id) AS pos FROM events WHERE event_id % 2 = 1 AND props NOT IN (SELECT props FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def append_unseen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seen = e.filter("event_id % 2 = 0").select("props").distinct()
    return e.filter("event_id % 2 = 1").join(seen, "props", "left_anti").groupBy(F.col("props").alias("line")).agg(F.min("event_id").alias("pos"))


@query("u4_held_out", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, round(sum(duration), 3) AS seconds FROM assigned WHERE split IN ('val', 'test') GROUP BY 1")
def held_out(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    return rows.filter("split = 'val'").unionByName(rows.filter("split = 'test'")).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 3).alias("seconds"))


# ---------------------------------------------------------------- reports
@query("a1_split_report", f"""WITH {SPLIT_SQL}, s AS (SELECT *, CASE WHEN speaker IN ('S4','S5') THEN 'test' WHEN speaker IN ('S1','S2','S3') THEN 'val' ELSE 'train' END AS part FROM assigned)
 SELECT part AS split, count(*) AS n_all, count(*) FILTER (drop_reason IS NULL) AS n_kept, round(sum(duration) / 3600, 4) AS hours, round(coalesce(sum(duration) FILTER (angle = 'A'), 0) / 3600, 4) AS hours_main FROM s GROUP BY 1""")
def split_report(spark, sf_dir):
    part = F.when(F.col("speaker").isin("S4", "S5"), "test").when(F.col("speaker").isin("S1", "S2", "S3"), "val").otherwise("train")
    out = M.split_report(assigned(spark, sf_dir).withColumn("split", part))
    return out.withColumn("hours", F.round("hours", 4)).withColumn("hours_main", F.round("hours_main", 4))


@query("a2_speaker_angle", f"WITH {UTT} SELECT speaker, min(noise_env)::BIGINT AS noise_env, count(*) FILTER (angle = 'A') AS angle_a, count(*) FILTER (angle = 'N') AS angle_n, count(*) FILTER (angle = 'R') AS angle_r FROM utt GROUP BY 1")
def speaker_angle(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    counts = rows.groupBy("speaker").pivot("angle", ["A", "N", "R"]).count().selectExpr("speaker", "coalesce(A, 0L) AS angle_a", "coalesce(N, 0L) AS angle_n", "coalesce(R, 0L) AS angle_r")
    return rows.groupBy("speaker").agg(F.min("noise_env").cast("long").alias("noise_env")).join(counts, "speaker")


@query("a3_coverage_shift", f"WITH {UTT}, v AS (SELECT video_stem, min(time_shift) AS s FROM utt GROUP BY 1) SELECT round(s, 2) AS shift, count(*) AS n_videos, (SELECT round(avg(lm_valid_ratio), 6) FROM utt) AS mean_ratio, (SELECT count(*) FROM utt WHERE lm_valid_ratio < 0.95e0) AS n_low FROM v GROUP BY 1")
def coverage_shift(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    overall = rows.agg(F.round(F.avg("lm_valid_ratio"), 6).alias("mean_ratio"), F.count_if(F.col("lm_valid_ratio") < 0.95).alias("n_low"))
    return rows.groupBy("video_stem").agg(F.min("time_shift").alias("s")).groupBy(F.round("s", 2).alias("shift")).agg(F.count("*").alias("n_videos")).crossJoin(F.broadcast(overall))


@query("a4_status", f"WITH {UTT} SELECT speaker, count(DISTINCT video_stem) AS videos, count(*) AS utts, round(sum(duration), 3) AS seconds, count(*) FILTER (has_unk) AS unk, array_to_string(list_sort(list_distinct(list(angle))), ',') AS angles FROM utt GROUP BY 1")
def status(spark, sf_dir):
    return utterances(spark, sf_dir).groupBy("speaker").agg(
        F.countDistinct("video_stem").alias("videos"), F.count("*").alias("utts"), F.round(F.sum("duration"), 3).alias("seconds"), F.count_if("has_unk").alias("unk"), F.concat_ws(",", F.array_sort(F.collect_set("angle"))).alias("angles")
    )


@query("a4_storage", f"""WITH {UTT}, {FILES}, n AS (SELECT split_dir, duration, (video_stem * 7 + sentence_id) % 300 AS a, video_stem % 200 AS b FROM utt), p AS (SELECT split_dir, unnest([a, b]) AS page_id FROM n), s AS (SELECT split_dir, count(*) FILTER (size > 0) AS files, coalesce(sum(size) FILTER (size > 0), 0)::BIGINT AS bytes, count(*) FILTER (coalesce(size, 0) = 0) AS missing FROM p LEFT JOIN files USING (page_id) GROUP BY 1)
 SELECT split_dir, count(*) AS utts, round(sum(duration), 3) AS seconds, max(files) AS files, max(bytes) AS bytes, max(missing) AS missing FROM n JOIN s USING (split_dir) GROUP BY 1""")
def storage(spark, sf_dir):
    rows = utterances(spark, sf_dir).selectExpr("split_dir", "duration", "CAST((video_stem * 7 + sentence_id) % 300 AS STRING) AS npz", "CAST(video_stem % 200 AS STRING) AS mouth_mp4")
    there = files(spark, sf_dir).select(F.col("page_id").cast("string").alias("rel_path"), "size")
    return M.storage_status(rows, ["npz", "mouth_mp4"], there).withColumn("seconds", F.round("seconds", 3))


# ---------------------------------------------------------------- subsets and batches
@query("w8_even_subset", f"WITH {UTT}, n AS (SELECT utt_id, row_number() OVER (ORDER BY utt_id) - 1 AS k, count(*) OVER () AS total FROM utt), i AS (SELECT DISTINCT CAST(floor(i * ((SELECT max(total) FROM n) / 500e0)) AS BIGINT) AS k FROM range(0, 500) r(i)) SELECT utt_id FROM n JOIN i USING (k)")
def even(spark, sf_dir):
    return M.even_subset(utterances(spark, sf_dir).select("utt_id"), 500)


@query("w9_shard", f"WITH {VIDEOS}, n AS (SELECT video_stem, part, row_number() OVER (ORDER BY video_stem) - 1 AS k FROM videos) SELECT part, count(*) AS n, min(video_stem) AS first_stem FROM n WHERE k % 4 = 1 GROUP BY 1")
def shards(spark, sf_dir):
    return M.shard(videos(spark, sf_dir), 2, 4).groupBy("part").agg(F.count("*").alias("n"), F.min("video_stem").alias("first_stem"))


@query("w10_stride_sample", f"WITH {UTT}, c AS (SELECT speaker, angle, utt_id, row_number() OVER (PARTITION BY speaker, angle ORDER BY utt_id) - 1 AS k, greatest(count(*) OVER (PARTITION BY speaker, angle) // 10, 1) AS step FROM utt) SELECT speaker, angle, utt_id FROM c WHERE k % step = 0 AND k // step < 10")
def strided(spark, sf_dir):
    return M.stride_sample(utterances(spark, sf_dir).select("speaker", "angle", "utt_id"), ["speaker", "angle"], 10)


@query("w11_speaker_sample", f"""WITH {UTT}, s AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS k, count(*) OVER () AS total FROM (SELECT DISTINCT speaker FROM utt)),
  q AS (SELECT speaker, 250 // total + (k < 250 % total)::INT AS quota FROM s), r AS (SELECT speaker, utt_id, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat('3|', utt_id)), utt_id) AS k FROM utt) SELECT speaker, utt_id FROM r JOIN q USING (speaker) WHERE k <= quota""")
def by_speaker(spark, sf_dir):
    return M.speaker_sample(utterances(spark, sf_dir).select("speaker", "utt_id"), 250, 3)


@query("w14_length_batches", f"""WITH RECURSIVE {UTT}, l AS (SELECT n_frames AS v, count(*) AS c, row_number() OVER (ORDER BY n_frames) AS r FROM utt GROUP BY 1),
 walk(r, v, cap, take, before, cur, size) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::BIGINT, -1::BIGINT, -1::BIGINT, 0::BIGINT UNION ALL
  SELECT r, v, cap, take, cur, cur + (c - take + cap - 1) // cap, CASE WHEN c > take THEN (c - take - 1) % cap + 1 ELSE size + take END FROM (SELECT l.r, l.v, l.c, greatest(8000 // l.v, 1) AS cap, least(l.c, CASE WHEN w.size > 0 THEN greatest(8000 // l.v - w.size, 0) ELSE 0 END) AS take, w.cur, w.size FROM walk w JOIN l ON l.r = w.r + 1)),
 rows AS (SELECT utt_id, n_frames, row_number() OVER (PARTITION BY n_frames ORDER BY utt_id) - 1 AS j FROM utt), b AS (SELECT utt_id, n_frames, CASE WHEN j < take THEN before ELSE before + 1 + (j - take) // cap END AS batch FROM rows JOIN walk ON walk.v = n_frames AND walk.r > 0),
 g AS (SELECT batch, count(*) AS size, max(n_frames) AS longest, min(utt_id) AS first_utt FROM b GROUP BY 1) SELECT batch, row_number() OVER (ORDER BY md5(concat('5|1|', batch)), batch) - 1 AS batch_order, size, longest, first_utt FROM g""")
def batches(spark, sf_dir):
    rows = M.length_batches(utterances(spark, sf_dir).select("utt_id", "n_frames"), "n_frames", 8000, "utt_id", epoch=1, seed=5)
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    return rows.groupBy("batch", "batch_order").agg(F.count("*").alias("size"), F.max("n_frames").alias("longest"), F.min("utt_id").alias("first_utt"))


@query("w15_shuffled_batches", f"WITH {UTT}, n AS (SELECT utt_id, row_number() OVER (ORDER BY md5(concat('5|1|', utt_id)), utt_id) - 1 AS k, count(*) OVER () AS total FROM utt) SELECT k // 64 AS batch, count(*) AS n, min(utt_id) AS first_utt FROM n WHERE k < total // 64 * 64 GROUP BY 1")
def shuffled(spark, sf_dir):
    rows = M.shuffled_batches(utterances(spark, sf_dir).select("utt_id"), 64, "utt_id", epoch=1, seed=5)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("utt_id").alias("first_utt"))


@query("w17_first_seen", f"WITH {UTT}, s AS (SELECT video_stem % 500 AS batch, utt_id, speaker, min(utt_id) OVER (PARTITION BY video_stem % 500, speaker) AS seen FROM utt) SELECT batch, utt_id, dense_rank() OVER (PARTITION BY batch ORDER BY seen) - 1 AS dense_id FROM s")
def first_seen(spark, sf_dir):
    rows = utterances(spark, sf_dir).selectExpr("video_stem % 500 AS batch", "utt_id", "speaker")
    return M.first_seen_ids(rows, "batch", "utt_id", "speaker").selectExpr("batch", "utt_id", "CAST(dense_id AS BIGINT) AS dense_id")


@query("s10_pad_batches", """WITH a AS (SELECT conv_id, turn, list_transform(range(0, CAST(length(text) % 9 AS BIGINT)), lambda x: x + turn) AS v FROM conversations), m AS (SELECT *, max(len(v)) OVER (PARTITION BY conv_id) AS longest FROM a)
 SELECT conv_id, turn, len(v)::BIGINT AS length, array_to_string(list_concat(v, list_transform(range(0, longest - len(v)), lambda x: CAST(1 AS BIGINT))), ',') AS padded FROM m""")
def padded(spark, sf_dir):
    values = F.expr("transform(filter(sequence(0L, CAST(length(text) % 9 AS BIGINT)), x -> x < length(text) % 9), x -> x + turn)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", values.alias("v"))
    out = M.pad_batches(rows, "conv_id", "v", F.lit(1).cast("long"))
    return out.select("conv_id", "turn", F.col("length").cast("long").alias("length"), F.array_join(F.col("v").cast("array<string>"), ",").alias("padded"))


# ---------------------------------------------------------------- order and limits
@query("t1_frontal_first", f"WITH {UTT} SELECT angle, utt_id FROM utt ORDER BY angle <> 'A', utt_id LIMIT 200")
def frontal_first(spark, sf_dir):
    return utterances(spark, sf_dir).orderBy(F.col("angle") != "A", "utt_id").limit(200).select("angle", "utt_id")


@query("t5_example_picks", f"WITH {UTT}, r AS (SELECT speaker, utt_id, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat('ex|', utt_id)), utt_id) AS k FROM utt WHERE duration BETWEEN 3 AND 6 AND angle = 'A') SELECT speaker, utt_id FROM r WHERE k = 1 ORDER BY md5(concat('ex|', utt_id)), utt_id LIMIT 12")
def example_picks(spark, sf_dir):
    from pyspark.sql import Window

    key = ordering.hash_order(F.lit("ex"), F.col("utt_id"))
    rows = utterances(spark, sf_dir).filter("duration between 3 and 6 and angle = 'A'").withColumn("k", F.row_number().over(Window.partitionBy("speaker").orderBy(key, "utt_id")))
    return rows.filter("k = 1").orderBy(key, "utt_id").limit(12).select("speaker", "utt_id")
