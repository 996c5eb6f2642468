"""Queries over sentences, frames, spans, alignments and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import intervals as I
from ..operators.metrics import edits
from ..sources.writers import srt_cues
from .adapters import FRAMES, REFS, SENT, UTT, frames, references, sentences, single_bytes, table, utterances
from .registry import query

R = lambda n, k=6: F.round(n, k).alias(n)


# ---------------------------------------------------------------- spans
@query("w1_padded_spans", f"""WITH {SENT}, g AS (SELECT *, start_s - lag(end_s) OVER w AS a, lead(start_s) OVER w - end_s AS b FROM sent WINDOW w AS (PARTITION BY video_stem ORDER BY start_s))
 SELECT video_stem, sentence_id, round(greatest(0, start_s + 0.1e0 - greatest(0, least(0.2e0, coalesce(a, 0.4e0) / 2))), 6) AS span_start, round(least(60e0, end_s + 0.1e0 + greatest(0, least(0.2e0, coalesce(b, 0.4e0) / 2))), 6) AS span_end FROM g""")
def padded(spark, sf_dir):
    return I.padded_spans(sentences(spark, sf_dir), "video_stem", F.lit(60.0), 0.1).select("video_stem", "sentence_id", R("span_start"), R("span_end"))


@query("j7_frames_to_sentences", f"WITH {SENT}, s AS (SELECT video_stem, sentence_id, unnest(range(CAST(round_even(start_s * 3, 0) AS BIGINT), CAST(round_even(end_s * 3, 0) AS BIGINT))) AS k FROM sent) SELECT video_stem, k, max(sentence_id) AS sentence_id FROM s GROUP BY 1, 2")
def frame_sentences(spark, sf_dir):
    return I.span_of_frame(sentences(spark, sf_dir), "video_stem", "sentence_id", 3.0).select("video_stem", "k", "sentence_id")


SEGMENTS = f"{FRAMES}, seg AS (SELECT user_id AS utt_key, CAST(event_id AS BIGINT) AS seg, (event_id % 300) / 10e0 AS start_s, (event_id % 300) / 10e0 + (event_id % 7) / 5e0 AS end_s FROM events)"


def segments(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id AS seg", "(event_id % 300) / 10e0 AS start_s", "(event_id % 300) / 10e0 + (event_id % 7) / 5e0 AS end_s")


@query("j9_visual_ratio", f"""WITH {SEGMENTS}, k AS (SELECT utt_key, seg, unnest(range(CAST(round_even(start_s, 0) AS BIGINT), CAST(round_even(end_s, 0) AS BIGINT))) AS k FROM seg), h AS (SELECT k.utt_key, seg, avg(valid::INT) AS share FROM k JOIN frames f ON k.utt_key = f.utt_key AND k.k = f.k GROUP BY 1, 2)
 SELECT s.utt_key, s.seg, round(coalesce(share, 0), 6) AS share FROM seg s LEFT JOIN h ON s.seg = h.seg""")
def visual_ratio(spark, sf_dir):
    out = I.share_of_valid(frames(spark, sf_dir), segments(spark, sf_dir), "utt_key", "seg", 1.0)
    return out.select("utt_key", "seg", R("share"))


@query("j10_halves", f"""WITH {SENT}, odd AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS chars FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations) q WHERE unicode(c) > 126 OR unicode(c) BETWEEN 1 AND 31), a AS (SELECT video_stem, CASE WHEN (start_s + end_s) / 2 < 20 THEN 'clean' ELSE 'noisy' END AS half, string_agg(text, ' ' ORDER BY start_s) AS ref, string_agg(replace(text, 'th', 't'), ' ' ORDER BY start_s) AS hyp, array_to_string(list_sort(list_distinct(list(topic))), ',') AS modes FROM sent GROUP BY 1, 2)
 SELECT half, count(*) AS n, round(CAST(sum(levenshtein({single_bytes("replace(ref, ' ', '')")}, {single_bytes("replace(hyp, ' ', '')")})) AS DOUBLE) / sum(length(replace(ref, ' ', ''))), 6) AS cer, max(modes) AS modes FROM a GROUP BY 1""")
def halves(spark, sf_dir):
    from ..operators.metrics import cer

    s = sentences(spark, sf_dir).withColumn("half", F.when((F.col("start_s") + F.col("end_s")) / 2 < 20, "clean").otherwise("noisy")).withColumn("plain", F.col("text"))
    joined = s.groupBy("video_stem", "half").agg(F.array_sort(F.collect_list(F.struct("start_s", "plain"))).alias("t"), F.concat_ws(",", F.array_sort(F.collect_set("topic"))).alias("modes"))
    text = F.array_join(F.transform("t", lambda x: x["plain"]), " ")
    hyp = F.array_join(F.transform("t", lambda x: F.replace(x["plain"], F.lit("th"), F.lit("t"))), " ")
    rows = joined.select("half", "modes", text.alias("ref"), hyp.alias("hyp"))
    return rows.groupBy("half").agg(F.count("*").alias("n"), F.round(cer(F.col("ref"), F.col("hyp")), 6).alias("cer"), F.max("modes").alias("modes"))


@query("j6_label_times", f"""WITH {UTT}, s AS (SELECT video_stem, sentence_id, start_s + 0.15e0 AS label_start, end_s - 0.1e0 AS label_end FROM utt), r AS (SELECT video_stem, sentence_id, 0.25e0 AS first_s, duration - 0.3e0 AS last_s FROM utt WHERE has_unk = false)
 SELECT u.video_stem, u.sentence_id, round(label_start + time_shift - start_s, 6) AS pad_left, round(end_s - (label_end + time_shift), 6) AS pad_right, round(first_s - (label_start + time_shift - start_s), 6) AS onset_delta, round(duration - (end_s - (label_end + time_shift)) - last_s, 6) AS offset_delta FROM utt u JOIN r USING (video_stem, sentence_id) JOIN s USING (video_stem, sentence_id)""")
def label_times(spark, sf_dir):
    u = utterances(spark, sf_dir)
    records = u.filter("not has_unk").selectExpr("video_stem", "sentence_id", "0.25e0 AS first_s", "duration - 0.3e0 AS last_s")
    label = u.selectExpr("video_stem", "sentence_id", "start_s + 0.15e0 AS start_s", "end_s - 0.1e0 AS end_s")
    return A.label_times(records, u, label).select("video_stem", "sentence_id", R("pad_left"), R("pad_right"), R("onset_delta"), R("offset_delta"))


# ---------------------------------------------------------------- frame windows
@query("w2_running_median", f"""WITH {FRAMES}, v AS (SELECT utt_key, k, CASE WHEN valid THEN x END AS x FROM frames), l AS (SELECT utt_key, k, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY utt_key ORDER BY k) AS l FROM v) SELECT utt_key, k, round(list_median(list_slice(l, greatest(len(l) - 8, 1), len(l))), 6) AS median FROM l""")
def running_median(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("x", F.expr("IF(valid, x, NULL)"))
    return I.running_median(rows, ["utt_key"], "k", "x").select("utt_key", "k", R("median"))


@query("w2_label_box_fallback", f"""WITH {FRAMES}, v AS (SELECT utt_key, k, CASE WHEN valid THEN x WHEN k % 3 = 0 THEN 50e0 + k END AS x FROM frames), l AS (SELECT utt_key, k, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY utt_key ORDER BY k) AS l FROM v) SELECT utt_key, k, round(list_median(list_slice(l, greatest(len(l) - 8, 1), len(l))), 6) AS median FROM l""")
def median_with_fallback(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("x", F.expr("IF(valid, x, NULL)")).withColumn("label", F.when(F.col("k") % 3 == 0, 50.0 + F.col("k")))
    return I.running_median(rows, ["utt_key"], "k", "x", fallback="label").select("utt_key", "k", R("median"))


@query("w3_moving_stats", f"""WITH {FRAMES}, w AS (SELECT utt_key, k, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, k >= 2 AND k + 2 < count(*) OVER (PARTITION BY utt_key) AS inner_ FROM frames WINDOW w AS (PARTITION BY utt_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT utt_key, k, round(m, 5) AS moving_mean, round(s, 5) AS moving_std FROM w WHERE inner_""")
def moving(spark, sf_dir):
    rows = I.moving_stats(frames(spark, sf_dir), "utt_key", "k", "x", 5)
    n = F.count("*").over(Window.partitionBy("utt_key"))
    return rows.withColumn("n", n).filter("k >= 2 and k + 2 < n").select("utt_key", "k", R("moving_mean", 5), R("moving_std", 5))


@query("w4_activity_runs", f"""WITH {FRAMES}, c AS (SELECT utt_key, k, valid, k - row_number() OVER (PARTITION BY utt_key, valid ORDER BY k) AS g, max(k) OVER (PARTITION BY utt_key) + 1 AS n FROM frames), r AS (SELECT utt_key, g, min(k) AS a, least(max(k) + 1 + 1, max(n)) AS b FROM c WHERE valid GROUP BY 1, 2 HAVING count(*) >= 2),
  o AS (SELECT *, max(b) OVER (PARTITION BY utt_key ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), m AS (SELECT *, sum(CASE WHEN reach IS NULL OR (a - reach >= 2 AND a > reach) THEN 1 ELSE 0 END) OVER (PARTITION BY utt_key ORDER BY a) AS h FROM o) SELECT utt_key, min(a)::INT AS start, max(b)::INT AS stop FROM m GROUP BY utt_key, h""")
def runs(spark, sf_dir):
    return I.active_runs(frames(spark, sf_dir), "utt_key", "k", "valid", least=2, hangover=1, gap=2)


@query("w6_fill_invalid", f"""WITH {FRAMES}, n AS (SELECT *, max(CASE WHEN valid THEN k END) OVER (PARTITION BY utt_key ORDER BY k) AS ka, min(CASE WHEN valid THEN k END) OVER (PARTITION BY utt_key ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM frames)
 SELECT n.utt_key, n.k, round(CASE WHEN n.valid THEN n.x WHEN ka IS NULL THEN coalesce(b.x, 0) WHEN kb IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (n.k - ka) / (kb - ka) END, 6) AS filled FROM n LEFT JOIN frames a ON a.utt_key = n.utt_key AND a.k = ka LEFT JOIN frames b ON b.utt_key = n.utt_key AND b.k = kb""")
def filled(spark, sf_dir):
    return I.fill_invalid(frames(spark, sf_dir), "utt_key").select("utt_key", "k", R("filled"))


@query("j11_grid", f"""WITH {FRAMES}, v AS (SELECT utt_key, k * 1e0 AS t, x FROM frames WHERE valid), e AS (SELECT utt_key, min(t) AS a, max(t) AS b FROM v GROUP BY 1), g AS (SELECT utt_key, unnest(range(CAST(ceil(a * 2 - 1e-9) AS BIGINT), CAST(floor(b * 2 + 1e-9) AS BIGINT) + 1)) AS g FROM e),
  n AS (SELECT g.utt_key, g.g, (SELECT max(t) FROM v WHERE v.utt_key = g.utt_key AND t <= g.g / 2e0) AS ta, (SELECT min(t) FROM v WHERE v.utt_key = g.utt_key AND t >= g.g / 2e0) AS tb FROM g)
 SELECT n.utt_key, n.g, round(CASE WHEN least(n.g / 2e0 - ta, tb - n.g / 2e0) <= 1 THEN CASE WHEN tb = ta THEN a.x ELSE a.x + (b.x - a.x) * (n.g / 2e0 - ta) / (tb - ta) END END, 6) AS x FROM n JOIN v a ON a.utt_key = n.utt_key AND a.t = ta JOIN v b ON b.utt_key = n.utt_key AND b.t = tb""")
def grid(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("t", F.col("k") * 1.0)
    return I.interpolate_on_grid(rows, "utt_key", "t", "x", 0.5, 1.0).select("utt_key", "g", R("x"))


@query("w7_latest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1")
def latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return I.latest_by_key(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("w16_z_scores", f"""WITH {FRAMES}, s AS (SELECT utt_key, avg(x) FILTER (valid) AS m, greatest(stddev_pop(x) FILTER (valid), 0.01e0) AS sd, count(*) FILTER (valid) AS n FROM frames GROUP BY 1) SELECT f.utt_key, k, round(CASE WHEN valid AND n >= 2 THEN (x - m) / sd ELSE 0 END, 5) AS z FROM frames f JOIN s USING (utt_key)""")
def z_scores(spark, sf_dir):
    return I.z_scores(frames(spark, sf_dir), "utt_key", "x", "valid").select("utt_key", "k", R("z", 5))


@query("w12_ctc_collapse", f"""WITH {FRAMES}, f AS (SELECT utt_key, k, CAST(floor(x) AS BIGINT) % 4 AS label FROM frames), c AS (SELECT *, lag(label) OVER (PARTITION BY utt_key ORDER BY k) AS p FROM f) SELECT utt_key, k, label::INT AS label FROM c WHERE p IS DISTINCT FROM label AND label > 0""")
def collapse(spark, sf_dir):
    rows = frames(spark, sf_dir).select("utt_key", "k", (F.floor("x") % 4).cast("int").alias("label"))
    return I.ctc_collapse(rows, "utt_key", "k", "label", [0])


@query("w13_token_spans", f"""WITH {FRAMES}, f AS (SELECT utt_key, k, CAST(floor(x) AS BIGINT) % 4 AS label, -x / 100 AS lp FROM frames), c AS (SELECT *, lag(label, 1, 0) OVER (PARTITION BY utt_key ORDER BY k) AS p FROM f), t AS (SELECT *, sum((label <> 0 AND label <> p)::INT) OVER (PARTITION BY utt_key ORDER BY k) AS token FROM c)
 SELECT utt_key, token::BIGINT AS token, max(label)::INT AS id, min(k)::INT AS first, max(k)::INT AS last, round(avg(lp), 6) AS mean_logp FROM t WHERE label <> 0 GROUP BY 1, 2""")
def token_spans(spark, sf_dir):
    rows = frames(spark, sf_dir).select("utt_key", "k", (F.floor("x") % 4).cast("int").alias("label"), (-F.col("x") / 100).alias("lp"))
    return I.token_spans(rows, "utt_key", "k", "label", "lp").select("utt_key", "token", "id", "first", "last", R("mean_logp"))


@query("w18_even_times", f"""WITH {SENT}, w AS (SELECT video_stem, sentence_id, min(start_s) OVER p AS a, max(end_s) OVER p AS b, count(*) OVER p AS n, row_number() OVER (PARTITION BY video_stem ORDER BY sentence_id) - 1 AS i FROM sent WINDOW p AS (PARTITION BY video_stem)) SELECT video_stem, sentence_id, round(a + i * ((b - a) / n), 6) AS even_start, round(a + (i + 1) * ((b - a) / n), 6) AS even_end FROM w""")
def even_times(spark, sf_dir):
    return I.even_times(sentences(spark, sf_dir), "video_stem", "sentence_id", "start_s", "end_s").select("video_stem", "sentence_id", R("even_start"), R("even_end"))


@query("t4_nearest_pause", f"""WITH {SENT}, g AS (SELECT video_stem, (end_s + lead(start_s) OVER (PARTITION BY video_stem ORDER BY start_s)) / 2 AS p FROM sent), r AS (SELECT *, row_number() OVER (PARTITION BY video_stem ORDER BY abs(p - 25), p) AS k FROM g WHERE p IS NOT NULL) SELECT video_stem, round(p, 6) AS pause_at FROM r WHERE k = 1""")
def pause(spark, sf_dir):
    return I.nearest_pause(sentences(spark, sf_dir).withColumn("middle", F.lit(25.0)), "video_stem", "middle").select("video_stem", R("pause_at"))


@query("t4_last_inside", f"WITH {SENT}, r AS (SELECT *, row_number() OVER (PARTITION BY video_stem ORDER BY end_s DESC, sentence_id DESC) AS k FROM sent WHERE end_s <= 60 AND start_s >= 0) SELECT video_stem, sentence_id, round(end_s, 6) AS end_s FROM r WHERE k = 1")
def last_inside(spark, sf_dir):
    return I.last_inside(sentences(spark, sf_dir).withColumn("limit", F.lit(60.0)), "video_stem", "limit").select("video_stem", "sentence_id", R("end_s"))


@query("s8_srt_cues", f"""WITH {SENT}, c AS (SELECT video_stem AS video, row_number() OVER (PARTITION BY video_stem ORDER BY start_s, end_s) AS n, CAST(round_even(greatest(start_s, 0) * 1000, 0) AS BIGINT) AS a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM sent WHERE sentence_id % 3 <> 0)
 SELECT video, n, concat(n, chr(13), chr(10), printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000), ' --> ', printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000), chr(13), chr(10), t, chr(13), chr(10)) AS cue FROM c""")
def cues(spark, sf_dir):
    rows = sentences(spark, sf_dir).selectExpr("video_stem AS video", "start_s AS start", "end_s AS end", "IF(sentence_id % 3 = 0, ' ', text) AS text")
    return srt_cues(rows).withColumn("n", F.col("n").cast("long"))


# ---------------------------------------------------------------- alignments
SYL = f"""{UTT}, base AS (SELECT video_stem AS utt_id, sentence_id AS pos, speaker, sentence_id * 0.3e0 + time_shift AS start_s, sentence_id * 0.3e0 + time_shift + 0.06e0 + noise_env * 0.02e0 AS end_s, 6 + session AS onset, has_unk, -(time_shift * 30) AS logprob, lm_valid_ratio FROM utt),
 syl AS (SELECT *, greatest(end_s, least(coalesce(lead(start_s) OVER w, end_s + 0.15e0), end_s + 0.15e0)) AS ext_end_s, coalesce(lead(start_s) OVER w > end_s + 0.15e0 + 1e-9, false) AS ext_capped, lead(start_s) OVER w - end_s AS gap FROM base WINDOW w AS (PARTITION BY utt_id ORDER BY pos))"""


def syllables(spark, sf_dir):
    rows = utterances(spark, sf_dir).selectExpr("video_stem AS utt_id", "sentence_id AS pos", "speaker", "sentence_id * 0.3e0 + time_shift AS start_s", "sentence_id * 0.3e0 + time_shift + 0.06e0 + noise_env * 0.02e0 AS end_s", "CAST(6 + session AS INT) AS onset", "has_unk", "-(time_shift * 30) AS logprob", "lm_valid_ratio")
    return A.extended_spans(rows, "utt_id", 0.15)


@query("a19_span_distributions", f"""WITH {SYL}, v AS (SELECT 'raw' AS kind, end_s - start_s AS s FROM syl UNION ALL SELECT 'extended', ext_end_s - start_s FROM syl UNION ALL SELECT 'gap', gap FROM syl WHERE gap IS NOT NULL)
 SELECT kind, count(*) AS n, round(quantile_cont(s * 1000, 0.5), 1) AS median_ms, round(quantile_cont(s * 1000, 0.05), 1) AS p5_ms, round(quantile_cont(s * 1000, 0.95), 1) AS p95_ms, round(avg(s * 1000), 1) AS mean_ms, round(avg((s * 1000 <= 40 + 1e-6)::INT), 4) AS frac_le_40ms, round(avg((s * 1000 < 40 - 1e-6)::INT), 4) AS frac_lt_40ms, round(avg((s * 1000 > 600 + 1e-6)::INT), 4) AS frac_gt_600ms FROM v GROUP BY 1""")
def spans(spark, sf_dir):
    s = syllables(spark, sf_dir)
    gap = F.lead("start_s").over(Window.partitionBy("utt_id").orderBy("pos")) - F.col("end_s")
    kinds = F.explode(F.create_map(F.lit("raw"), F.col("end_s") - F.col("start_s"), F.lit("extended"), F.col("ext_end_s") - F.col("start_s"), F.lit("gap"), F.col("gap"))).alias("kind", "s")
    return A.span_distribution(s.withColumn("gap", gap).select(kinds).filter("s is not null"), ["kind"], "s")


@query("a20_alignment_summary", f"""WITH {SYL}, p AS (SELECT utt_id, count(*) AS n_syl, min(logprob) AS worst, sum(logprob) AS lp, count(*) FILTER (logprob < ln(0.5e0)) AS n_low FROM syl GROUP BY 1), r AS (SELECT o_orderkey AS utt_id, concat('P', o_custkey % 20) AS speaker, o_orderstatus <> 'O' AS ok, o_totalprice / 10000 AS duration FROM orders)
 SELECT speaker, count(*) AS n_utts, round(avg(ok::INT), 4) AS success_rate, sum(n_syl) FILTER (ok)::BIGINT AS n_syllables, round(sum(lp) FILTER (ok) / sum(n_syl) FILTER (ok), 4) AS mean_logprob, round(sum(n_low) FILTER (ok)::DOUBLE / sum(n_syl) FILTER (ok), 4) AS frac_low, round(avg((worst < ln(0.1e0))::INT) FILTER (ok), 4) AS frac_utts_low, round(quantile_cont(n_syl / duration, 0.5) FILTER (ok), 2) AS rate_median FROM r LEFT JOIN p USING (utt_id) GROUP BY 1""")
def summary(spark, sf_dir):
    records = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS utt_id", "concat('P', o_custkey % 20) AS speaker", "o_orderstatus <> 'O' AS ok", "o_totalprice / 10000 AS duration")
    return A.alignment_summary(records, syllables(spark, sf_dir), "speaker")


TOK = f"""{SYL}, tok AS (SELECT *, CASE WHEN has_unk THEN 3 ELSE 2 END AS n_tok FROM syl), fr AS (SELECT utt_id, pos, onset, has_unk, start_s, ext_end_s, unnest(range(CAST(greatest(ceil((start_s - 0.05e0 - 1e-9) * 25), 0) AS BIGINT), CAST(ceil((ext_end_s - 0.05e0 - 1e-9) * 25) AS BIGINT))) AS k FROM syl),
 lab AS (SELECT utt_id, k, pos, CASE WHEN k / 25e0 + 0.05e0 < start_s + 0.02e0 - 1e-9 THEN onset WHEN k / 25e0 + 0.05e0 < CASE WHEN has_unk THEN start_s + 0.04e0 ELSE ext_end_s END - 1e-9 THEN 30 ELSE CASE WHEN has_unk THEN 50 END END AS token FROM fr),
 top AS (SELECT utt_id, k, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY utt_id, k ORDER BY pos DESC) AS n FROM lab) WHERE n = 1)"""


def with_tokens(spark, sf_dir):
    tokens = F.expr("IF(has_unk, array(named_struct('id', onset, 'start_s', start_s), named_struct('id', 30, 'start_s', start_s + 0.02e0), named_struct('id', 50, 'start_s', start_s + 0.04e0)), array(named_struct('id', onset, 'start_s', start_s), named_struct('id', 30, 'start_s', start_s + 0.02e0)))")
    return syllables(spark, sf_dir).withColumn("tokens", tokens)


@query("j8_frame_labels", f"WITH {TOK} SELECT utt_id, k, pos, token FROM top")
def frame_labels(spark, sf_dir):
    return A.frame_labels(with_tokens(spark, sf_dir), "utt_id", 25.0, lead_s=0.05)


@query("a21_label_coverage", f"""WITH {TOK}, len AS (SELECT o_orderkey AS utt_id, 60 AS n_frames FROM orders), i AS (SELECT t.* FROM top t JOIN len USING (utt_id) WHERE k < n_frames), p AS (SELECT utt_id, min(k) AS a, max(k) AS b, count(token) AS n FROM i GROUP BY 1)
 SELECT CASE WHEN token < 25 THEN 'L' WHEN token < 46 THEN 'V' ELSE 'T' END AS kind, count(*) AS n_all, count(*) AS n_inside FROM i WHERE token IS NOT NULL GROUP BY 1 UNION ALL SELECT 'none', sum(n_frames - coalesce(n, 0))::BIGINT, sum(coalesce(b - a + 1 - n, 0))::BIGINT FROM len LEFT JOIN p USING (utt_id)""")
def coverage(spark, sf_dir):
    labels = A.frame_labels(with_tokens(spark, sf_dir), "utt_id", 25.0, lead_s=0.05)
    lengths = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS utt_id", "60 AS n_frames")
    return A.label_coverage(labels.filter("token is not null"), lengths, "utt_id")


@query("a22_profile", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, CAST(event_id % 40 AS BIGINT) AS k0, event_id % 2 = 0 AS bilabial FROM events), s AS (SELECT e.*, o, k0 + o AS k FROM e, (SELECT unnest(range(-3, 4)) AS o)) SELECT bilabial, o::INT AS "offset", count(*) AS n, round(avg(x), 6) AS mean FROM s JOIN frames f ON f.utt_key = s.utt_key AND f.k = s.k GROUP BY 1, 2""")
def profiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id % 40 AS k0", "event_id % 2 = 0 AS bilabial")
    return A.profile(events, frames(spark, sf_dir).withColumnRenamed("x", "z"), "utt_key", 3, "bilabial").select("bilabial", "offset", "n", R("mean"))


@query("a22_lowest_offset", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, CAST(event_id % 40 AS BIGINT) AS k0, event_id % 2 = 0 AS bilabial FROM events), s AS (SELECT e.*, o, k0 + o AS k FROM e, (SELECT unnest(range(-3, 4)) AS o)), p AS (SELECT bilabial, o, avg(x) AS mean FROM s JOIN frames f ON f.utt_key = s.utt_key AND f.k = s.k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bilabial ORDER BY mean, o) AS n FROM p) SELECT bilabial, o::INT AS "offset" FROM r WHERE n = 1""")
def lowest(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id % 40 AS k0", "event_id % 2 = 0 AS bilabial")
    return A.lowest_offset(A.profile(events, frames(spark, sf_dir).withColumnRenamed("x", "z"), "utt_key", 3, "bilabial"), "bilabial").select("bilabial", F.col("offset").cast("int").alias("offset"))


@query("a22_position_bins", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, event_id % 40 + 0.3e0 AS s, event_id % 40 + 0.3e0 + (event_id % 5 + 1) * 1.7e0 AS z, CASE WHEN event_id % 3 = 0 THEN 'onset' ELSE 'other' END AS kind FROM events), w AS (SELECT *, z - s AS d FROM e), p AS (SELECT *, unnest(range(ceil(s - 0.5e0 * d)::BIGINT, floor(z + 0.5e0 * d)::BIGINT + 1)) AS k FROM w), b AS (SELECT kind, floor((p.k - s) / d * 10 + 5)::INT AS bin, x FROM p JOIN frames f ON f.utt_key = p.utt_key AND f.k = p.k)
 SELECT kind, bin, count(*) AS n, round(avg(x), 8) AS mean FROM b WHERE bin BETWEEN 0 AND 19 GROUP BY 1, 2""")
def position_bins(spark, sf_dir):
    spans = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id % 40 + 0.3e0 AS start_s", "event_id % 40 + 0.3e0 + (event_id % 5 + 1) * 1.7e0 AS end_s", "IF(event_id % 3 = 0, 'onset', 'other') AS kind")
    return A.position_profile(spans, frames(spark, sf_dir).withColumnRenamed("x", "z"), "utt_key", 1.0, "kind").select("kind", "bin", "n", R("mean", 8))


@query("a22_log_energy", """WITH b AS (SELECT conv_id, turn, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM conversations), g AS (SELECT conv_id, turn, l, len(l) // 20 AS n FROM b), c AS (SELECT conv_id, turn, unnest(range(0, n)) AS k, l FROM g WHERE n > 0),
 e AS (SELECT conv_id, turn, k, log10(list_avg(list_transform(l[k * 20 + 1:k * 20 + 20], lambda h: (('0x' || h)::INT - 128)::DOUBLE * (('0x' || h)::INT - 128))) + 1) AS le FROM c), z AS (SELECT conv_id, turn, k, (le - avg(le) OVER w) / greatest(stddev_pop(le) OVER w, 0.01e0) AS z FROM e WINDOW w AS (PARTITION BY conv_id, turn))
 SELECT (k - 3)::INT AS "offset", count(*) AS n, round(avg(z), 5) AS mean FROM z WHERE k < 7 GROUP BY 1""")
def log_energy(spark, sf_dir):
    """Mean standardised log energy (cells of 20 samples) around the fourth cell of each turn's sound."""
    from ..operators.intervals import z_scores
    from ..operators.signal import cell_energy

    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("utt"), F.posexplode(cell_energy(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 20)).alias("k", "le"))
    z = z_scores(rows.withColumn("there", F.lit(True)), "utt", "le", "there").select("utt", "k", "z")
    starts = rows.select("utt", F.lit(3).alias("k0"), F.lit("all").alias("kind")).distinct()
    return A.profile(starts, z, "utt", 3, "kind").select(F.col("offset").cast("int").alias("offset"), "n", R("mean", 5))


SHIFT = f"{FRAMES}, sh AS (SELECT utt_key % 3 AS split, utt_key AS utt, o * 20 AS shift, k % 2 = 0 AS positive, x + CASE WHEN k % 2 = 0 THEN 20 - abs(o - 1) * 5 ELSE 0 END AS x FROM frames, (SELECT unnest(range(-3, 4)) AS o)), cu AS (SELECT split, shift, avg(x) FILTER (positive) AS m1, avg(x) FILTER (NOT positive) AS m0, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, var_samp(x) FILTER (positive) AS v1, var_samp(x) FILTER (NOT positive) AS v0 FROM sh GROUP BY 1, 2), d AS (SELECT split, shift, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM cu)"


def shifted(spark, sf_dir, **more):
    o = F.explode(F.sequence(F.lit(-3), F.lit(3)))
    rows = frames(spark, sf_dir).withColumn("o", o)
    return rows.select((F.col("utt_key") % 3).alias("split"), F.col("utt_key").alias("utt"), (F.col("o") * 20).cast("long").alias("shift"), (F.col("k") % 2 == 0).alias("positive"), (F.col("x") + F.when(F.col("k") % 2 == 0, 20 - F.abs(F.col("o") - 1) * 5).otherwise(0)).alias("x"), *[c.alias(n) for n, c in more.items()])


@query("a24_shift_curve", f"""WITH {SHIFT}, n AS (SELECT *, lag(d) OVER w AS p, lead(d) OVER w AS q, row_number() OVER (PARTITION BY split ORDER BY d DESC, shift) AS r FROM d WINDOW w AS (PARTITION BY split ORDER BY shift)) SELECT split, round(d, 5) AS peak, round(shift + CASE WHEN p - 2 * d + q < 0 THEN 0.5e0 * (p - q) / (p - 2 * d + q) * 20 ELSE 0 END, 4) AS best_shift FROM n WHERE r = 1""")
def shift_curve(spark, sf_dir):
    return A.best_shift(A.shift_curve(shifted(spark, sf_dir), ["split"]), ["split"]).select("split", R("peak", 5), R("best_shift", 4))


@query("a28_subgroups", f"WITH {SHIFT} SELECT split, shift, round(d, 5) AS d FROM d")
def subgroups(spark, sf_dir):
    return A.shift_curve(shifted(spark, sf_dir), ["split"]).select("split", "shift", R("d", 5))


_CHANCES = " + ".join(f"(u > {p!r}e0)::INT" for p in A.POISSON)
BOOT = f"""{SHIFT}, su AS (SELECT split, utt, shift, positive, sum(x) AS s1, sum(x * x) AS s2, count(*) AS n FROM sh GROUP BY 1, 2, 3, 4), uu AS (SELECT DISTINCT split, utt FROM su), hh AS (SELECT split, utt, r, ('0x' || substr(md5(concat_ws('|', '0', utt, r)), 1, 8))::BIGINT / 4294967296e0 AS u FROM uu, range(200) q(r)),
 dw AS (SELECT split, utt, r, {_CHANCES} AS w FROM hh), bo AS (SELECT su.split, r, shift, sum(w * n) FILTER (positive) AS n1, sum(w * n) FILTER (NOT positive) AS n0, sum(w * s1) FILTER (positive) AS a1, sum(w * s1) FILTER (NOT positive) AS a0, sum(w * s2) FILTER (positive) AS b1, sum(w * s2) FILTER (NOT positive) AS b0 FROM dw JOIN su ON su.split = dw.split AND su.utt = dw.utt WHERE w > 0 GROUP BY 1, 2, 3),
 bd AS (SELECT split, r, shift, (a1 / n1 - a0 / n0) / sqrt(greatest((b1 - a1 * a1 / n1 + b0 - a0 * a0 / n0) / greatest(n1 + n0 - 2, 1), 1e-12)) AS d FROM bo),
 bn AS (SELECT *, lag(d) OVER w AS p, lead(d) OVER w AS q, row_number() OVER (PARTITION BY split, r ORDER BY d DESC, shift) AS k FROM bd WINDOW w AS (PARTITION BY split, r ORDER BY shift)),
 bt AS (SELECT split, r, shift + coalesce(CASE WHEN p - 2 * d + q < 0 THEN 0.5e0 * (p - q) / (p - 2 * d + q) * 20 ELSE 0 END, 0) AS best FROM bn WHERE k = 1), bz AS (SELECT split, r, d FROM bd WHERE shift = 0)"""


@query("a25_bootstrap", f"WITH {BOOT} SELECT split, round(quantile_cont(best, 0.025), 4) AS shift_low, round(quantile_cont(best, 0.975), 4) AS shift_high, round(quantile_cont(d, 0.025), 5) AS d_low, round(quantile_cont(d, 0.975), 5) AS d_high FROM bt JOIN bz USING (split, r) GROUP BY 1")
def bootstrap(spark, sf_dir):
    out = A.bootstrap_shift(shifted(spark, sf_dir), ["split"], replicas=200)
    return out.select("split", R("shift_low", 4), R("shift_high", 4), R("d_low", 5), R("d_high", 5))


@query("a26_paired_effect", "WITH g AS (SELECT l_returnflag AS flag, l_quantity - l_discount * 400 AS d FROM lineitem) SELECT flag, count(d) AS n, round(avg(d), 5) AS mean_diff, round(avg(d) / stddev_samp(d), 5) AS dz, round(avg((d > 0)::INT), 5) AS share_higher FROM g GROUP BY 1")
def paired(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "l_quantity AS a", "l_discount * 400 AS b")
    return A.paired_effect(rows, ["flag"], "a", "b").select("flag", "n", R("mean_diff", 5), R("dz", 5), R("share_higher", 5))


@query("a27_robust", """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.05) * 1000, 4) AS p5_ms, round(quantile_cont(value, 0.25) * 1000, 4) AS p25_ms, round(quantile_cont(value, 0.5) * 1000, 4) AS median_ms, round(quantile_cont(value, 0.75) * 1000, 4) AS p75_ms, round(quantile_cont(value, 0.95) * 1000, 4) AS p95_ms, round(quantile_cont(abs(value - m), 0.5) * 1482.6e0, 4) AS robust_sd_ms, round(avg(value) * 1000, 3) AS mean_ms FROM events JOIN m USING (event_type) GROUP BY 1""")
def robust(spark, sf_dir):
    out = A.robust_statistics(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return out.select("event_type", "n", *[R(c, 4) for c in ("p5_ms", "p25_ms", "median_ms", "p75_ms", "p95_ms", "robust_sd_ms")], R("mean_ms", 3))


@query("a29_trajectory", f"""WITH {FRAMES}, p AS (SELECT event_type = 'click' AS positive, k * 10 // (max(k) OVER (PARTITION BY utt_key) + 1) AS bin, x FROM frames), g AS (SELECT bin, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, avg(x) FILTER (positive) AS m1, avg(x) FILTER (NOT positive) AS m0, var_samp(x) FILTER (positive) AS v1, var_samp(x) FILTER (NOT positive) AS v0 FROM p GROUP BY 1)
 SELECT bin::BIGINT AS bin, n1, n0, round(m1, 5) AS mean1, round(m0, 5) AS mean0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS d FROM g""")
def trajectory(spark, sf_dir):
    from ..operators.metrics import contrast

    last = F.max("k").over(Window.partitionBy("utt_key")) + 1
    rows = frames(spark, sf_dir).select((F.col("event_type") == "click").alias("positive"), F.floor(F.col("k") * 10 / last).alias("bin"), "x")
    return contrast(rows, ["bin"]).select("bin", "n1", "n0", R("mean1", 5), R("mean0", 5), R("d", 5))


@query("a29_edge_trajectories", f"""WITH {FRAMES}, e AS (SELECT user_id AS utt_key, event_id % 40 AS first, event_id % 40 + event_id % 5 AS last, event_type = 'click' AS positive FROM events), p AS (SELECT utt_key, positive, unnest(['start', 'end']) AS edge, unnest([first, last]) AS at FROM e), o AS (SELECT *, unnest(range(-3, 4)) AS o FROM p),
 g AS (SELECT edge, o, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, avg(x) FILTER (positive) AS m1, avg(x) FILTER (NOT positive) AS m0, var_samp(x) FILTER (positive) AS v1, var_samp(x) FILTER (NOT positive) AS v0 FROM o JOIN frames f ON f.utt_key = o.utt_key AND f.k = o.at + o.o GROUP BY 1, 2)
 SELECT edge, o::INT AS "offset", n1, n0, round(m1, 5) AS mean1, round(m0, 5) AS mean0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS d FROM g""")
def edge_trajectories(spark, sf_dir):
    spans = table(spark, sf_dir, "events").selectExpr("user_id AS utt_key", "event_id % 40 AS first", "event_id % 40 + event_id % 5 AS last", "event_type = 'click' AS positive")
    out = A.edge_trajectories(spans, frames(spark, sf_dir), "utt_key", list(range(-3, 4)), "x")
    return out.select("edge", "offset", "n1", "n0", R("mean1", 5), R("mean0", 5), R("d", 5))


@query("a30_class_table", f"WITH {SYL} SELECT onset, has_unk, count(*) AS n, round(avg(lm_valid_ratio), 6) AS lm_valid_ratio, round(avg(logprob), 6) AS logprob FROM syl GROUP BY 1, 2 HAVING count(*) >= 20")
def classes(spark, sf_dir):
    out = A.class_table(syllables(spark, sf_dir), ["onset", "has_unk"], ["lm_valid_ratio", "logprob"])
    return out.select(F.col("onset").cast("long").alias("onset"), "has_unk", "n", R("lm_valid_ratio"), R("logprob"))


@query("a31_av_lag", f"""WITH {FRAMES}, d AS (SELECT utt_key, k, x - lag(x, 1, x) OVER (PARTITION BY utt_key ORDER BY k) AS a, (CASE WHEN valid THEN x ELSE 0 END) AS b FROM frames), s AS (SELECT p.utt_key, o AS lag, sum(q.a * p.b) AS s, count(*) AS n FROM d p, (SELECT unnest(range(-3, 4)) AS o), d q WHERE q.utt_key = p.utt_key AND q.k = p.k + o GROUP BY 1, 2) SELECT utt_key, lag::INT AS lag, round(s, 5) AS s, n FROM s""")
def av_lag(spark, sf_dir):
    w = Window.partitionBy("utt_key").orderBy("k")
    rows = frames(spark, sf_dir).select("utt_key", "k", (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))).alias("a"), F.expr("IF(valid, x, 0)").alias("b"))
    return A.lag_sums(rows, ["utt_key"], "k", "a", "b", 3).select("utt_key", "lag", R("s", 5), "n")


SCORED = f"""{SYL}, v AS (SELECT unnest(['ctc', 'ctc', 'proportional', 'proportional']) AS mode, unnest([0e0, 0.05e0, 0e0, 0.05e0]) AS lead), fr AS (SELECT mode, lead, utt_id, pos, onset, has_unk, start_s, ext_end_s, unnest(range(CAST(greatest(ceil((start_s - lead - 1e-9) * 25), 0) AS BIGINT), CAST(ceil((ext_end_s - lead - 1e-9) * 25) AS BIGINT))) AS k FROM syl, v),
 e AS (SELECT *, k / 25e0 + lead AS t, CASE WHEN mode = 'ctc' THEN start_s + 0.02e0 ELSE start_s + (ext_end_s - start_s) * 0.25e0 END AS second, CASE WHEN NOT has_unk THEN ext_end_s WHEN mode = 'ctc' THEN start_s + 0.04e0 ELSE start_s + (ext_end_s - start_s) * 0.6e0 END AS third FROM fr),
 lab AS (SELECT mode, lead, utt_id, k, CASE WHEN t < second - 1e-9 THEN onset WHEN t < third - 1e-9 THEN 30 ELSE CASE WHEN has_unk THEN 50 END END AS token, row_number() OVER (PARTITION BY mode, lead, utt_id, k ORDER BY pos DESC) AS n FROM e),
 hit AS (SELECT mode, lead, coalesce(token < 25, false) AS positive, f.x FROM lab JOIN frames f ON f.utt_key = lab.utt_id AND f.k = lab.k WHERE n = 1),
 rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY mode, lead, x) - 1) / 2e0 AS r FROM hit WINDOW w AS (PARTITION BY mode, lead ORDER BY x)),
 gr AS (SELECT mode, lead, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, avg(x) FILTER (positive) AS m1, avg(x) FILTER (NOT positive) AS m0, var_samp(x) FILTER (positive) AS v1, var_samp(x) FILTER (NOT positive) AS v0, sum(r) FILTER (positive) AS rs FROM rk GROUP BY 1, 2)"""


@query("a32_label_scoring", f"WITH {FRAMES}, {SCORED} SELECT mode, round(lead * 1000)::INT AS lead_ms, n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d, round((rs - n1 * (n1 + 1) / 2e0) / n1 / n0, 6) AS auc FROM gr")
def label_scoring(spark, sf_dir):
    values = frames(spark, sf_dir).select((F.col("utt_key") + 0).alias("utt_id"), F.col("k").cast("long").alias("k"), F.col("x").alias("z"))
    lengths = values.groupBy("utt_id").agg(F.max("k").alias("last_k"))  # labels are listed where there are frames
    s = with_tokens(spark, sf_dir)
    both = None
    for proportional in (False, True):
        for lead in (0.0, 0.05):
            part = A.frame_labels(s, "utt_id", 25.0, lead_s=lead, proportional=proportional, lengths=lengths).withColumn("mode", F.lit("proportional" if proportional else "ctc")).withColumn("lead_ms", F.lit(int(lead * 1000)))
            both = part if both is None else both.union(part)
    out = A.score_labels(both, values, "utt_id", ["mode", "lead_ms"], F.coalesce(F.col("token") < 25, F.lit(False)))
    return out.select("mode", "lead_ms", "n1", "n0", R("mean1"), R("mean0"), R("d"), R("auc"))


@query("a33_acceptance", "WITH v AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1), c(name, low, high) AS (VALUES ('click', 0e0, 100e0), ('error', 90e0, 100e0), ('absent', 0e0, 1e0)) SELECT c.name, low, high, round(value, 6) AS value, coalesce(value BETWEEN low AND high, false) AS passed FROM c LEFT JOIN v USING (name)")
def acceptance(spark, sf_dir):
    values = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return A.acceptance(values, {"click": (0, 100), "error": (90, 100), "absent": (0, 1)}).select("name", "low", "high", R("value"), "passed")


@query("a34_run_summary", "WITH l AS (SELECT user_id % 5 AS decoder, event_type <> 'error' AS ok, user_id * 10 AS frames, value / 100 AS valid_ratio, value AS t_total FROM events) SELECT decoder, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, sum(frames) FILTER (ok)::BIGINT AS frames, round(avg(valid_ratio) FILTER (ok), 6) AS valid_ratio, round(sum(frames) FILTER (ok) / sum(t_total) FILTER (ok), 6) AS frames_per_s FROM l GROUP BY 1")
def run_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id % 5 AS decoder", "event_type <> 'error' AS ok", "user_id * 10 AS frames", "value / 100 AS valid_ratio", "value AS t_total")
    return A.log_summary(log, ["decoder"]).select("decoder", "n_ok", "n_failed", "frames", R("valid_ratio"), R("frames_per_s"))


@query("a36_video_summary", f"WITH {SENT}, {FRAMES}, r AS (SELECT utt_key, avg(valid::INT) AS ratio FROM frames GROUP BY 1), v AS (SELECT video_stem, count(*) AS n, count(*) FILTER (topic = 'user') AS n_user, count(*) FILTER (topic = 'assistant') AS n_assistant, count(*) FILTER (trim(text) <> '') AS with_text, round(sum(end_s - start_s), 4) AS seconds FROM sent GROUP BY 1) SELECT v.*, round(ratio, 6) AS valid_ratio FROM v LEFT JOIN r ON r.utt_key = v.video_stem")
def video_summary(spark, sf_dir):
    out = A.video_summary(sentences(spark, sf_dir), frames(spark, sf_dir).withColumnRenamed("utt_key", "video_stem"), "video_stem", ["user", "assistant"])
    return out.select("video_stem", "n", "n_user", "n_assistant", "with_text", R("seconds", 4), R("valid_ratio"))


@query("a20_label_deltas", f"""WITH {UTT}, r AS (SELECT 'onset' AS kind, noise_env, 0.25e0 - (0.15e0 + time_shift) AS x FROM utt WHERE NOT has_unk UNION ALL SELECT 'offset', noise_env, 0.3e0 - (0.1e0 - time_shift) FROM utt WHERE NOT has_unk)
 SELECT kind, noise_env, count(*) AS n, round(avg((x >= -0.02e0)::INT), 4) AS frac_after, round(avg((x < -0.1e0)::INT), 4) AS frac_100ms_before, round(avg((x > 0.3e0)::INT), 4) AS frac_300ms_after, round(quantile_cont(x, 0.5) * 1000, 1) AS median_ms, round(quantile_cont(x, 0.05) * 1000, 1) AS p5_ms, round(quantile_cont(x, 0.95) * 1000, 1) AS p95_ms FROM r GROUP BY 1, 2""")
def label_deltas(spark, sf_dir):
    u = utterances(spark, sf_dir).filter("not has_unk")
    rows = u.selectExpr("noise_env", "inline(array(struct('onset' AS kind, 0.25e0 - (0.15e0 + time_shift) AS x), struct('offset' AS kind, 0.3e0 - (0.1e0 - time_shift) AS x)))")
    return A.delta_summary(rows, ["kind", "noise_env"], "x")


@query("a27_centred_jitter", """WITH m AS (SELECT event_type, user_id, quantile_cont(value, 0.5) AS m, count(value) AS n FROM events GROUP BY 1, 2), d AS (SELECT e.event_type, value - m AS d FROM events e JOIN m ON m.event_type = e.event_type AND m.user_id = e.user_id WHERE n >= 5)
 SELECT event_type, count(*) AS n, round(quantile_cont(abs(d), 0.5) * 1482.6e0, 4) AS robust_sd_ms, round((quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) * 1000, 4) AS iqr_ms FROM d GROUP BY 1""")
def jitter(spark, sf_dir):
    out = A.centred_jitter(table(spark, sf_dir, "events").select("event_type", "user_id", "value"), ["event_type"], "user_id", "value")
    return out.select("event_type", "n", R("robust_sd_ms", 4), R("iqr_ms", 4))


GROUPS_SQL = SHIFT.replace("x + CASE WHEN", "k % 3 = 0 AS sure, x + CASE WHEN", 1)


@query("a28_subgroup_curves", f"""WITH {GROUPS_SQL}, g AS (SELECT shift, positive, x, unnest(['split', 'utt', 'sure']) AS grp, unnest([split::VARCHAR, utt::VARCHAR, sure::VARCHAR]) AS value FROM sh), a AS (SELECT grp, value, shift, avg(x) FILTER (positive) AS m1, avg(x) FILTER (NOT positive) AS m0, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, var_samp(x) FILTER (positive) AS v1, var_samp(x) FILTER (NOT positive) AS v0 FROM g GROUP BY 1, 2, 3)
 SELECT grp AS "group", value, shift, n1, n0, CASE WHEN n1 >= 3 AND n0 >= 3 THEN round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) END AS d FROM a""")
def subgroup_curves(spark, sf_dir):
    rows = shifted(spark, sf_dir, sure=(F.col("k") % 3 == 0))
    return A.subgroup_curves(rows, ["split", "utt", "sure"]).select("group", "value", "shift", "n1", "n0", R("d", 5))


LAG_REPORT = f"""{FRAMES}, u AS (SELECT utt_key, k, x, CASE WHEN valid THEN x ELSE 0 END AS y FROM frames), ok AS (SELECT utt_key FROM frames GROUP BY 1 HAVING avg(valid::INT) >= 0.5 AND count(*) >= 15), f AS (SELECT utt_key, k, x AS v, greatest(y, quantile_cont(y, 0.2) OVER (PARTITION BY utt_key)) AS a FROM u JOIN ok USING (utt_key)),
 s AS (SELECT *, (coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0)) / 3 AS vs, (coalesce(lag(a) OVER w, 0) + a + coalesce(lead(a) OVER w, 0)) / 3 AS a_s FROM f WINDOW w AS (PARTITION BY utt_key ORDER BY k)), d AS (SELECT utt_key, k, vs - coalesce(lag(vs) OVER w, v) AS v, a_s - coalesce(lag(a_s) OVER w, a) AS a FROM s WINDOW w AS (PARTITION BY utt_key ORDER BY k)),
 z AS (SELECT utt_key, k, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6) AS v, (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-6) AS a FROM d WINDOW w AS (PARTITION BY utt_key)),
 p AS (SELECT p.utt_key % 40 AS video, o AS lag, sum(q.a * p.v) / count(*) AS m FROM z p, (SELECT unnest(range(-5, 6)) AS o) c, z q WHERE q.utt_key = p.utt_key AND q.k = p.k + o GROUP BY 1, 2),
 b AS (SELECT video, lag, m, row_number() OVER (PARTITION BY video ORDER BY m DESC, lag) AS n, max(m) FILTER (lag = 0) OVER (PARTITION BY video) AS corr0, m - quantile_cont(m, 0.5) OVER (PARTITION BY video) AS sharpness FROM p)"""


def lag_utterances(spark, sf_dir):
    """Each user's events as an utterance of video user_id % 40, of speaker video % 7."""
    rows = frames(spark, sf_dir).groupBy("utt_key").agg(F.array_sort(F.collect_list(F.struct("k", "x", F.expr("IF(valid, x, 0D)").alias("y")))).alias("s"), F.avg(F.col("valid").cast("double")).alias("valid_ratio"))
    video = F.col("utt_key") % 40
    return rows.select(video.alias("video"), (video % 7).alias("speaker"), F.transform("s", lambda x: x["x"]).alias("v"), F.transform("s", lambda x: x["y"]).alias("a"), "valid_ratio")


@query("a31_lag_by_video", f"WITH {LAG_REPORT} SELECT video, video % 7 AS speaker, lag::INT AS lag, round(m, 6) AS corr, round(corr0, 6) AS corr0, round(sharpness, 6) AS sharpness FROM b WHERE n = 1")
def lag_by_video(spark, sf_dir):
    out = A.lag_by_video(lag_utterances(spark, sf_dir), ["video", "speaker"], 5, least_valid=0.5)
    return out.select("video", "speaker", "lag", R("corr"), R("corr0"), R("sharpness"))


@query("a31_lag_by_speaker", f"WITH {LAG_REPORT} SELECT video % 7 AS speaker, count(*) AS n, quantile_cont(lag, 0.5)::DOUBLE AS median_lag, min(lag)::INT AS least_lag, max(lag)::INT AS most_lag FROM b WHERE n = 1 GROUP BY 1")
def lag_by_speaker(spark, sf_dir):
    return A.lag_by_speaker(A.lag_by_video(lag_utterances(spark, sf_dir), ["video", "speaker"], 5, least_valid=0.5), ["speaker"])


LAGS_SQL = f"""{FRAMES}, d AS (SELECT utt_key, k, x - lag(x, 1, x) OVER (PARTITION BY utt_key ORDER BY k) AS a, (CASE WHEN valid THEN x ELSE 0 END) AS b FROM frames), s AS (SELECT p.utt_key, o AS lag, sum(q.a * p.b) / count(*) AS m FROM d p, (SELECT unnest(range(-3, 4)) AS o) c, d q WHERE q.utt_key = p.utt_key AND q.k = p.k + o GROUP BY 1, 2),
 l AS (SELECT utt_key, arg_max(lag, m) * 40e0 AS x FROM s GROUP BY 1), y AS (SELECT utt_key, avg(x) AS y FROM frames GROUP BY 1)"""


@query("a31_lag_agreement", f"WITH {LAGS_SQL} SELECT count(*) AS n, round(corr(y, x), 6) AS r, round(avg(y - x), 5) AS mean, round(stddev_samp(y - x), 5) AS sd, round(min(y - x), 5) AS least, round(max(y - x), 5) AS most FROM l JOIN y USING (utt_key)")
def lag_agreement(spark, sf_dir):
    w = Window.partitionBy("utt_key").orderBy("k")
    rows = frames(spark, sf_dir).select("utt_key", "k", "x", (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))).alias("a"), F.expr("IF(valid, x, 0)").alias("b"))
    lags = A.best_lag(A.lag_sums(rows, ["utt_key"], "k", "a", "b", 3), ["utt_key"]).select("utt_key", (F.col("lag") * 40.0).alias("lag_ms"))
    out = A.agreement(lags.join(rows.groupBy("utt_key").agg(F.avg("x").alias("shift_ms")), "utt_key"), "lag_ms", "shift_ms")
    return out.select("n", R("r"), *[R(c, 5) for c in ("mean", "sd", "least", "most")])


@query("w16_pixel_z_scores", """WITH p AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(floor(abs(x) * 1000) AS BIGINT) % 256)) AS p, generate_subscripts(embedding, 1) AS i FROM embeddings), u AS (SELECT vec_id, label, i, p / 255e0 AS p FROM p), s AS (SELECT label, avg(p) AS m, greatest(stddev_pop(p), 1e-3) AS sd FROM u GROUP BY 1)
 SELECT vec_id, round(sum((p - m) / sd), 5) AS total, round(max((p - m) / sd), 5) AS top FROM u JOIN s USING (label) GROUP BY 1""")
def pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(1000).cast("float")) % 256).alias("pixels"))
    out = I.pixel_z_scores(rows, "label")
    return out.select("vec_id", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("pixels"), 5).alias("top"))


@query("t3_worst_and_typical", f"""WITH {REFS}, e AS (SELECT speaker, utt_id, piece, levenshtein({single_bytes('ref')}, {single_bytes('hyp')}) AS edits FROM refs), m AS (SELECT speaker, quantile_cont(edits, 0.5) AS m FROM e GROUP BY 1), r AS (SELECT e.speaker, utt_id, piece, row_number() OVER (PARTITION BY e.speaker ORDER BY edits DESC, utt_id, piece) AS a, row_number() OVER (PARTITION BY e.speaker ORDER BY abs(edits - m), utt_id, piece) AS b FROM e JOIN m USING (speaker)) SELECT speaker, max(CASE WHEN a = 1 THEN utt_id END) AS worst, max(CASE WHEN a = 1 THEN piece END) AS worst_piece, max(CASE WHEN b = 1 THEN utt_id END) AS typical, max(CASE WHEN b = 1 THEN piece END) AS typical_piece FROM r GROUP BY 1""")
def worst(spark, sf_dir):
    e = references(spark, sf_dir).select("speaker", "utt_id", "piece", edits(F.col("ref"), F.col("hyp")).alias("edits"))
    m = e.groupBy("speaker").agg(F.median("edits").alias("m"))
    of = F.struct("utt_id", "piece")
    out = e.join(m, "speaker").groupBy("speaker").agg(F.min_by(of, F.struct(-F.col("edits"), "utt_id", "piece")).alias("w"), F.min_by(of, F.struct(F.abs(F.col("edits") - F.col("m")), "utt_id", "piece")).alias("t"))
    return out.select("speaker", F.col("w.utt_id").alias("worst"), F.col("w.piece").alias("worst_piece"), F.col("t.utt_id").alias("typical"), F.col("t.piece").alias("typical_piece"))
