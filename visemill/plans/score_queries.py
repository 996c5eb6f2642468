"""Queries over references, hypotheses, scores and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as K
from ..operators import metrics as M
from ..operators import ordering
from ..operators import pairs as P
from .adapters import BIN, EMB, REFS, SPOKEN, SPOKEN_PIECES, binary_scores, faces, references, single_bytes, spoken, spoken_pieces, table
from .registry import query

CER = f"CAST(sum(levenshtein({single_bytes("replace(ref, ' ', '')")}, {single_bytes("replace({h}, ' ', '')")})) AS DOUBLE) / nullif(sum(length(replace(ref, ' ', ''))), 0)"


# ---------------------------------------------------------------- text
def normal_sql(text: str) -> str:
    return rf"""trim(regexp_replace(translate(nfc_normalize({text}), concat(chr(160), chr(10), chr(9), chr(13), '…()/"''[]{{}}<>~*_-'), '    .'), '\s+', ' ', 'g'))"""


TOKENS = """CASE WHEN c = ' ' THEN [5] WHEN unicode(c) BETWEEN 44032 AND 55203 THEN CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN [(unicode(c) - 44032) // 588 + 6, (unicode(c) - 44032) % 588 // 28 + 25, (unicode(c) - 44032) % 28 + 45] ELSE [(unicode(c) - 44032) // 588 + 6, (unicode(c) - 44032) % 588 // 28 + 25] END
   WHEN c = '.' THEN [73] WHEN c = '?' THEN [74] WHEN c = '!' THEN [75] WHEN c = ',' THEN [76] ELSE [4] END"""


def jamo_sql(texts: str) -> str:
    return f"{texts}, norm AS (SELECT doc_id, raw, {normal_sql('raw')} AS norm FROM spoken), chars AS (SELECT *, list_filter(string_split(norm, ''), lambda c: c <> '') AS chars FROM norm), tok AS (SELECT *, flatten(list_transform(chars, lambda c: {TOKENS})) AS ids FROM chars)"


JAMO_SQL, PIECES_SQL = jamo_sql(SPOKEN), jamo_sql(SPOKEN_PIECES)
#: One row for each character of the texts whose characters all have tokens.
GROUPS_SQL = f"""g AS (SELECT doc_id, pos - 1 AS pos, c, len({TOKENS}) AS n FROM (SELECT doc_id, unnest(chars) AS c, generate_subscripts(chars, 1) AS pos FROM tok WHERE NOT list_contains(ids, 4)))"""


@query("p4_normalize", f"SELECT doc_id, {normal_sql('text')} AS normal FROM documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.normalize(F.col("text")).alias("normal"))


@query("p5_jamo_encode", f"WITH {JAMO_SQL} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM tok")
def jamo(spark, sf_dir):
    rows = spoken(spark, sf_dir)
    return rows.select("doc_id", F.array_join(K.jamo_ids(K.normalize(F.col("raw"))).cast("array<string>"), " ").alias("ids"))


@query("p6_jamo_decode", rf"WITH {JAMO_SQL} SELECT doc_id, regexp_replace(norm, '[^ .?!,가-힣]', 'X', 'g') AS decoded FROM tok")
def jamo_decode(spark, sf_dir):
    return spoken(spark, sf_dir).select("doc_id", K.jamo_text(K.jamo_ids(K.normalize(F.col("raw")))).alias("decoded"))


@query("p7_has_unknown", f"WITH {JAMO_SQL} SELECT doc_id, contains(raw, 'X') OR norm = '' OR list_contains(ids, 4) AS has_unk FROM tok")
def unknown(spark, sf_dir):
    return spoken(spark, sf_dir).select("doc_id", K.has_unknown(K.normalize(F.col("raw")), F.col("raw")).alias("has_unk"))


CLASS_SQL = """CASE WHEN t = 5 THEN 'space' WHEN t BETWEEN 46 AND 72 THEN 'final' WHEN t BETWEEN 73 AND 76 THEN 'punct'
  WHEN t IN (12, 13, 14, 23) THEN 'bilabial' WHEN t IN (8, 9, 10, 11, 22) THEN 'alveolar' WHEN t IN (15, 16, 18, 19, 20) THEN 'sibilant' WHEN t IN (6, 7, 21) THEN 'velar' WHEN t = 17 THEN 'silent' WHEN t = 24 THEN 'glottal'
  WHEN t IN (33, 34, 35, 36, 37, 38, 39, 40, 41, 42) THEN 'rounded' WHEN t IN (25, 27, 29, 31) THEN 'open' WHEN t IN (26, 28, 30, 32, 43, 44, 45) THEN 'spread' END"""


@query("p8_token_class", f"WITH {JAMO_SQL}, t AS (SELECT unnest(ids) AS t FROM tok) SELECT coalesce({CLASS_SQL}, '-') AS class, count(*) AS n FROM t GROUP BY 1")
def token_class(spark, sf_dir):
    tokens = spoken(spark, sf_dir).select(F.explode(K.jamo_ids(K.normalize(F.col("raw")))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return tokens.groupBy(F.coalesce(K.class_of(F.col("t")), F.lit("-")).alias("class")).agg(F.sum("n").alias("n"))


@query("p9_text_groups", f"""WITH {JAMO_SQL}, {GROUPS_SQL}, r AS (SELECT doc_id, pos, c, CASE WHEN c = ' ' THEN 'space' WHEN unicode(c) BETWEEN 44032 AND 55203 THEN 'syl' ELSE 'punct' END AS kind, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS last, n FROM g)
 SELECT doc_id, count(*) AS n, md5(string_agg(concat_ws('|', c, kind, last - n, last), ';' ORDER BY pos)) AS groups_md5 FROM r GROUP BY 1""")
def groups(spark, sf_dir):
    """The groups of each whole text whose characters all have tokens, as one digest."""
    rows = spoken(spark, sf_dir).select("doc_id", K.text_groups(K.normalize(F.col("raw"))).alias("g")).filter("size(g) > 0")
    shown = F.transform("g", lambda g: F.concat_ws("|", g["char"], g["kind"], g["first"].cast("string"), g["last"].cast("string")))
    return rows.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(shown, ";").cast("binary")).alias("groups_md5"))


def aligned_texts(spark, sf_dir):
    """The groups of each utterance, and a span of frames for each of its tokens."""
    rows = spoken_pieces(spark, sf_dir).select("utt_id", K.once(K.text_groups)(K.normalize(F.col("raw"))).alias("groups")).filter("size(groups) > 0")
    first = "CAST(i * 3 + length(utt_id) % 5 AS INT)"
    tokens = F.expr(f"transform(sequence(0, element_at(groups, -1).last - 1), i -> struct(i AS id, {first} AS first, {first} + 1 AS last, -(i % 7) / 10e0 AS logprob))")
    return rows.select("utt_id", (F.element_at("groups", -1)["last"] * 3 + 40).alias("n_frames"), "groups", tokens.alias("tokens"))


@query("v6_syllable_records", f"""WITH {PIECES_SQL}, {GROUPS_SQL}, o AS (SELECT *, length(doc_id) % 5 AS d, sum(n) OVER w - n AS a, sum(n) OVER w AS z, sum((c = ' ')::INT) OVER w AS word, sum(n) OVER (PARTITION BY doc_id) * 3 + 40 AS frames FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 s AS (SELECT *, (a * 3 + d) / 50e0 AS b, round(((z - 1) * 3 + d + 2) / 50e0, 3) AS e FROM o WHERE unicode(c) BETWEEN 44032 AND 55203), x AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY pos), frames / 50e0) AS nx FROM s),
 r AS (SELECT doc_id, pos, c, word, round(b, 3) AS start_s, e AS end_s, round(greatest(e, least(nx, e + 0.4e0)), 3) AS ext_end_s, nx > e + 0.4e0 + 1e-9 AS capped, round(list_avg(list_transform(range(a::BIGINT, z::BIGINT), lambda i: -(i % 7) / 10e0)), 3) AS logprob FROM x)
 SELECT doc_id AS utt_id, count(*) AS n, md5(string_agg(concat_ws('|', pos, c, word), ';' ORDER BY pos)) AS syllables_md5, round(sum(start_s), 3) AS start_s, round(sum(end_s), 3) AS end_s, round(sum(ext_end_s), 3) AS ext_end_s, count(*) FILTER (capped) AS n_capped, round(sum(logprob), 3) + 0e0 AS logprob FROM r GROUP BY 1""")
def records(spark, sf_dir):
    """The syllables of each utterance, their times summed up."""
    from ..operators.segments import syllable_arrays

    # what has no syllable is left out beforehand: a filter on the result would be worked out for every token
    rows = syllable_arrays(aligned_texts(spark, sf_dir).filter("exists(groups, g -> g.kind = 'syl')"), 50.0)
    shown = F.transform("syllables", lambda s: F.concat_ws("|", s["pos"].cast("string"), s["char"], s["word"].cast("string")))
    total = lambda c: F.round(F.aggregate("syllables", F.lit(0.0), lambda a, s: a + s[c]), 3)
    return rows.select(
        "utt_id", F.size("syllables").cast("long").alias("n"), F.md5(F.array_join(shown, ";").cast("binary")).alias("syllables_md5"), *[total(c).alias(c) for c in ("start_s", "end_s", "ext_end_s")],
        F.size(F.filter("syllables", lambda s: s["ext_capped"])).cast("long").alias("n_capped"), (total("logprob") + 0.0).alias("logprob"),
    )


# ---------------------------------------------------------------- error rates
@query("a5_cer", f"WITH {REFS} SELECT angle, count(*) AS n, round({CER.format(h='hyp')}, 6) AS cer FROM refs GROUP BY 1")
def cer(spark, sf_dir):
    return references(spark, sf_dir).groupBy("angle").agg(F.count("*").alias("n"), F.round(M.cer(F.col("ref"), F.col("hyp")), 6).alias("cer"))


# each distinct word of a pair becomes one character
WORDS_SQL = f"""{REFS}, w AS (SELECT angle, list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(hyp, '\\s+'), lambda x: x <> '') AS b FROM refs), u AS (SELECT *, list_distinct(list_concat(a, b)) AS u FROM w),
 c AS (SELECT angle, len(a) AS n, array_to_string(list_transform(a, lambda x: chr(CAST(33 + list_position(u, x) AS INT))), '') AS a, array_to_string(list_transform(b, lambda x: chr(CAST(33 + list_position(u, x) AS INT))), '') AS b FROM u)"""


@query("a6_wer", f"WITH {WORDS_SQL} SELECT angle, count(*) AS n, round(sum(levenshtein(a, b))::DOUBLE / sum(n), 6) AS wer FROM c GROUP BY 1")
def wer(spark, sf_dir):
    return references(spark, sf_dir).groupBy("angle").agg(F.count("*").alias("n"), F.round(M.wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


MODES = f"""{REFS}, modes AS (SELECT utt_id, piece, ref, snr, mode, CASE WHEN (utt_id + snr + length(mode)) % 3 = 0 THEN hyp WHEN mode = 'video' THEN replace(ref, 'e', '') ELSE ref END AS hyp
 FROM refs, (SELECT unnest([20, 10, 5, 0]) AS snr), (SELECT unnest(['av', 'audio', 'video']) AS mode)), scored AS (SELECT mode, snr, count(*) AS n, {CER.format(h='hyp')} AS cer FROM modes GROUP BY 1, 2)"""


def modes(spark, sf_dir):
    rows = references(spark, sf_dir).withColumn("snr", F.explode(F.array(*map(F.lit, (20, 10, 5, 0))))).withColumn("mode", F.explode(F.array(*map(F.lit, ("av", "audio", "video")))))
    return rows.withColumn("hyp", F.expr("CASE WHEN (utt_id + snr + length(mode)) % 3 = 0 THEN hyp WHEN mode = 'video' THEN replace(ref, 'e', '') ELSE ref END"))


def scored(spark, sf_dir):
    return modes(spark, sf_dir).groupBy("mode", "snr").agg(F.count("*").alias("n"), M.cer(F.col("ref"), F.col("hyp")).alias("cer"))


@query("a7_modes_by_snr", f"WITH {MODES}, w AS (SELECT snr, max(cer) FILTER (mode = 'av') AS av, max(cer) FILTER (mode = 'audio') AS audio, max(cer) FILTER (mode = 'video') AS video FROM scored GROUP BY 1) SELECT snr, round(av, 6) AS av, round(audio, 6) AS audio, round(video, 6) AS video, round(audio - av, 6) AS gain, audio - av > 0 AS av_better FROM w")
def modes_by_snr(spark, sf_dir):
    out = M.compare_modes(scored(spark, sf_dir))
    return out.select("snr", *[F.round(c, 6).alias(c) for c in ("av", "audio", "video", "gain")], "av_better")


@query("a8_cer_cube", f"""WITH {REFS}, two AS (SELECT *, replace(ref, 'a', 'aa') AS att FROM refs) SELECT speaker, angle, count(*) AS n, round({CER.format(h='hyp')}, 6) AS cer_hyp, round({CER.format(h='att')}, 6) AS cer_att, grouping(speaker, angle)::BIGINT AS level FROM two GROUP BY CUBE (speaker, angle)""")
def cube(spark, sf_dir):
    out = M.error_cube(references(spark, sf_dir).withColumn("att", F.expr("replace(ref, 'a', 'aa')")), ["speaker", "angle"], ["hyp", "att"])
    return out.select("speaker", "angle", "n", F.round("cer_hyp", 6).alias("cer_hyp"), F.round("cer_att", 6).alias("cer_att"), F.col("level").cast("long").alias("level"))


HEARD = "list_filter(list_transform(ids, lambda x: CASE WHEN x % 11 = 0 THEN x + 1 ELSE x END), lambda x: x % 13 <> 0)"


def misheard(ids: str):
    """Every eleventh token heard as the next one, every thirteenth not at all."""
    return F.filter(F.transform(ids, lambda x: F.when(x % 11 == 0, x + 1).otherwise(x)), lambda x: x % 13 != 0)


@query("v7_edit_alignment", f"""WITH {PIECES_SQL}, h AS (SELECT doc_id, ids AS a, {HEARD} AS b FROM tok WHERE len(ids) > 0)
 SELECT doc_id AS utt_id, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(33 + x AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(33 + x AS INT))), ''))::BIGINT AS edits, len(a)::BIGINT AS n_ref, len(b)::BIGINT AS n_hyp FROM h""")
def edit_alignment(spark, sf_dir):
    rows = spoken_pieces(spark, sf_dir).select("utt_id", K.once(K.jamo_ids)(K.normalize(F.col("raw"))).alias("ref")).filter("size(ref) > 0")
    pairs = rows.select("utt_id", M.align_ids("ref", misheard("ref")).alias("p"))
    count = lambda test: F.size(F.filter("p", test)).cast("long")
    return pairs.select("utt_id", count(lambda p: ~p["ref"].eqNullSafe(p["hyp"])).alias("edits"), count(lambda p: p["ref"].isNotNull()).alias("n_ref"), count(lambda p: p["hyp"].isNotNull()).alias("n_hyp"))


def word_pairs(spark, sf_dir):
    """(ref, hyp, times) of the aligned tokens of all words of the texts, up to four characters at a time: what comes again is
    aligned once."""
    words = spoken(spark, sf_dir).select(K.normalize(F.col("raw")).alias("norm")).select(F.explode(F.expr("regexp_extract_all(norm, '[^ ]{1,4}', 0)")).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    rows = words.select("times", K.jamo_ids(F.col("word")).alias("ids"))
    return rows.select("times", F.explode(M.align_ids("ids", misheard("ids"))).alias("p")).select("p.ref", "p.hyp", "times")


# a cell of each word's table has its cost and its way, a letter for each step (B both, R the reference, H what was heard); row by row
PAIRS_SQL = f"""{JAMO_SQL}, w AS (SELECT word, count(*) AS times FROM (SELECT unnest(regexp_extract_all(norm, '[^ ]{{1,4}}')) AS word FROM norm) GROUP BY 1),
 wt AS (SELECT word, times, flatten(list_transform(string_split(word, ''), lambda c: {TOKENS})) AS ids FROM w), ab AS (SELECT word, times, ids AS a, {HEARD} AS b FROM wt),
 rows(word, i, costs, ways) AS (SELECT word, 0, range(0, len(b) + 1), list_transform(range(0, len(b) + 1), lambda j: repeat('H', j::BIGINT)) FROM ab UNION ALL
  SELECT word, i, list_transform(cells, lambda c: c.cost), list_transform(cells, lambda c: c.way) FROM (SELECT r.word, r.i + 1 AS i, list_reduce(list_transform(range(1, len(ab.b) + 1), lambda j: [{{'cost': r.costs[j] + (ab.b[j] <> ab.a[r.i + 1])::BIGINT, 'way': r.ways[j], 'over': r.costs[j + 1] + 1, 'above': r.ways[j + 1]}}]),
   lambda acc, x: acc || [{{'cost': least(x[1].cost, x[1].over, acc[-1].cost + 1), 'way': CASE WHEN x[1].cost <= least(x[1].over, acc[-1].cost + 1) THEN x[1].way || 'B' WHEN x[1].over <= acc[-1].cost + 1 THEN x[1].above || 'R' ELSE acc[-1].way || 'H' END, 'over': 0::BIGINT, 'above': ''}}],
   [{{'cost': (r.i + 1)::BIGINT, 'way': repeat('R', r.i + 1), 'over': 0::BIGINT, 'above': ''}}]) AS cells FROM rows r JOIN ab ON ab.word = r.word WHERE r.i < len(ab.a)) q),
 done AS (SELECT ab.word, times, a, b, ways[-1] AS way FROM rows r JOIN ab ON ab.word = r.word AND r.i = len(ab.a)), steps AS (SELECT *, unnest(string_split(way, '')) AS s, generate_subscripts(string_split(way, ''), 1) AS k FROM done),
 placed AS (SELECT *, (sum((s <> 'H')::INT) OVER w)::BIGINT AS i, (sum((s <> 'R')::INT) OVER w)::BIGINT AS j FROM steps WINDOW w AS (PARTITION BY word ORDER BY k)), pairs AS (SELECT CASE WHEN s <> 'H' THEN a[i] END AS ref, CASE WHEN s <> 'R' THEN b[j] END AS hyp, times FROM placed)"""


@query("a9_jamo_errors", f"WITH RECURSIVE {PAIRS_SQL} SELECT {CLASS_SQL.replace('t ', 'ref ')} AS class, coalesce(sum(times) FILTER (ref IS NOT NULL), 0)::BIGINT AS n_ref, coalesce(sum(times) FILTER (ref = hyp), 0)::BIGINT AS n_right, coalesce(sum(times) FILTER (ref IS NOT NULL AND hyp IS NULL), 0)::BIGINT AS n_deleted, coalesce(sum(times) FILTER (ref IS NULL), 0)::BIGINT AS n_inserted FROM pairs GROUP BY 1")
def jamo_errors(spark, sf_dir):
    rows = word_pairs(spark, sf_dir).withColumn("class", K.class_of(F.col("ref")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("times"))), F.lit(0))
    ref, hyp = F.col("ref"), F.col("hyp")
    return rows.groupBy("class").agg(total(ref.isNotNull()).alias("n_ref"), total(ref == hyp).alias("n_right"), total(ref.isNotNull() & hyp.isNull()).alias("n_deleted"), total(ref.isNull()).alias("n_inserted"))


@query("t2_top_substitutions", f"WITH RECURSIVE {PAIRS_SQL} SELECT ref::INT AS ref, hyp::INT AS hyp, sum(times)::BIGINT AS n FROM pairs WHERE ref <> hyp GROUP BY 1, 2 ORDER BY n DESC, ref, hyp LIMIT 20")
def substitutions(spark, sf_dir):
    rows = word_pairs(spark, sf_dir).filter("ref is not null and hyp is not null and ref <> hyp")
    return rows.groupBy("ref", "hyp").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "ref", "hyp").limit(20)


@query("a10_estimate_summary", """WITH e AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS dsp, value / 2 AS model FROM events) SELECT event_type, round(quantile_cont(dsp, 0.5), 6) AS dsp, round(quantile_cont(model, 0.5), 6) AS model, round(quantile_cont(coalesce((dsp + model) / 2, model), 0.5), 6) AS hybrid, count(*) AS n FROM e GROUP BY 1""")
def estimates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "IF(event_id % 7 = 0, NULL, value) AS snr_dsp", "value / 2 AS snr_model")
    return M.estimate_summary(rows, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("dsp", "model", "hybrid")], "n")


@query("a11_threshold", f"""WITH {MODES}, v AS (SELECT {CER.format(h='hyp')} AS video FROM modes WHERE mode = 'video'), a AS (SELECT snr, cer FROM scored WHERE mode = 'av'), t AS (SELECT max(snr) FILTER (cer > video) AS threshold, max(snr) AS top FROM a, v)
 SELECT threshold::DOUBLE AS threshold, CASE WHEN top IS NULL THEN 'no_data' WHEN threshold IS NULL THEN 'video_never_better' WHEN threshold = top THEN 'video_always_better' ELSE 'ok' END AS status FROM t""")
def threshold(spark, sf_dir):
    video = modes(spark, sf_dir).filter("mode = 'video'").agg(M.cer(F.col("ref"), F.col("hyp"))).first()[0]
    return M.suggest_threshold(scored(spark, sf_dir).filter("mode = 'av'"), float(video)).withColumn("threshold", F.col("threshold").cast("double"))


@query("a11_threshold_estimates", """WITH g AS (SELECT event_type AS estimator, user_id % 5 AS rank, avg(value) AS m FROM events GROUP BY 1, 2), l AS (SELECT estimator, rank, (20 - 5 * rank)::DOUBLE AS snr, m - 3 * rank AS estimate FROM g), c AS (SELECT *, lag(estimate) OVER (PARTITION BY estimator ORDER BY rank) AS cleaner FROM l)
 SELECT estimator, round(max(CASE WHEN snr = 10 THEN (estimate + cleaner) / 2 END), 2) AS value FROM c GROUP BY 1""")
def threshold_estimates(spark, sf_dir):
    levels = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("estimator"), (F.col("user_id") % 5).cast("int").alias("rank")).agg(F.avg("value").alias("m"))
    levels = levels.select("estimator", "rank", (20.0 - 5 * F.col("rank")).alias("snr"), (F.col("m") - 3 * F.col("rank")).alias("estimate"))
    return M.threshold_in_estimates(levels, 10.0, "ok")


@query("a12_training_progress", f"""WITH {REFS}, v AS (SELECT CAST(utt_id // 40 AS INT) AS epoch, {CER.format(h='hyp')} AS av, {CER.format(h="replace(ref, 'a', '')")} AS audio FROM refs GROUP BY 1)
 SELECT epoch, round(av, 6) AS av, round(audio, 6) AS audio, round(audio - av, 6) AS lips_gain, epoch = (SELECT epoch FROM v ORDER BY av, epoch LIMIT 1) AS best FROM v""")
def progress(spark, sf_dir):
    rows = references(spark, sf_dir).withColumn("epoch", F.floor(F.col("utt_id") / 40).cast("int"))
    v = rows.groupBy("epoch").agg(M.cer(F.col("ref"), F.col("hyp")).alias("av"), M.cer(F.col("ref"), F.expr("replace(ref, 'a', '')")).alias("audio"))
    return M.training_progress(v).select("epoch", F.round("av", 6).alias("av"), F.round("audio", 6).alias("audio"), F.round("lips_gain", 6).alias("lips_gain"), "best")


@query("a12_last_train", "SELECT epoch(ts) AS time, (event_id // 100)::INT AS epoch, event_id::INT AS step, value AS loss FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_train(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS time", "IF(event_type = 'click', 'train', 'val') AS type", "CAST(event_id div 100 AS INT) AS epoch", "CAST(event_id AS INT) AS step", "value AS loss")
    return M.last_train_row(log)


# ---------------------------------------------------------------- ROC
ROC_SQL = f"""{BIN}, c AS (SELECT score, sum(positive)::BIGINT AS p, sum(1 - positive)::BIGINT AS n FROM bin GROUP BY 1),
  k AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, 1 - tp::DOUBLE / np - fp::DOUBLE / nn AS d FROM k)"""


@query("a13_auc", f"WITH {ROC_SQL} SELECT round(sum(n * (tp - p / 2e0)) / max(np) / max(nn), 8) AS auc, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg FROM d")
def auc(spark, sf_dir):
    return M.auc_and_eer(binary_scores(spark, sf_dir).select("score", "positive")).select(F.round("auc", 8).alias("auc"), "n_pos", "n_neg")


@query("a14_eer", f"""WITH {ROC_SQL}, a AS (SELECT d, fp::DOUBLE / nn AS f, score FROM d WHERE d > 0 ORDER BY score LIMIT 1), b AS (SELECT d, fp::DOUBLE / nn AS f, score FROM d WHERE d <= 0 ORDER BY score DESC LIMIT 1)
 SELECT round(a.f + a.d / (a.d - b.d) * (b.f - a.f), 8) AS eer, round(a.score + a.d / (a.d - b.d) * (b.score - a.score), 8) AS threshold FROM a, b""")
def eer(spark, sf_dir):
    out = M.auc_and_eer(binary_scores(spark, sf_dir).select("score", "positive"))
    return out.select(F.round("eer", 8).alias("eer"), F.round("threshold", 8).alias("threshold"))


@query("a23_contrast", f"""WITH {BIN}, g AS (SELECT speaker, count(*) FILTER (positive = 1) AS n1, count(*) FILTER (positive = 0) AS n0, avg(score) FILTER (positive = 1) AS m1, avg(score) FILTER (positive = 0) AS m0, var_samp(score) FILTER (positive = 1) AS v1, var_samp(score) FILTER (positive = 0) AS v0 FROM bin GROUP BY 1),
  u AS (SELECT a.speaker, sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM bin a JOIN bin b ON a.speaker = b.speaker AND a.positive = 1 AND b.positive = 0 GROUP BY 1)
 SELECT speaker, n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, CASE WHEN n1 >= 3 AND n0 >= 3 THEN round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) END AS d, round(auc, 6) AS auc FROM g LEFT JOIN u USING (speaker)""")
def contrast(spark, sf_dir):
    rows = binary_scores(spark, sf_dir)
    out = M.contrast(rows.withColumn("positive", F.col("positive") == 1), ["speaker"], "score")
    areas = M.grouped_auc(rows, ["speaker"]).select("speaker", F.round("auc", 6).alias("auc"))
    return out.join(areas, "speaker").select("speaker", "n1", "n0", F.round("mean1", 6).alias("mean1"), F.round("mean0", 6).alias("mean0"), F.round("d", 6).alias("d"), "auc")


# ---------------------------------------------------------------- pairs
COS = "list_cosine_similarity(CAST(a.face AS DOUBLE[]), b.stream)"


@query("j12_pair_scores", f"WITH {EMB} SELECT a.id AS face, b.id AS stream, round({COS}, 6) AS s FROM emb a JOIN emb b ON b.id = a.id OR b.id = (a.id + 7) % (SELECT count(*) FROM emb)")
def pair_scores(spark, sf_dir):
    e = faces(spark, sf_dir)
    n = e.count()
    wanted = e.select(F.col("id").alias("face"), F.explode(F.array(F.col("id"), (F.col("id") + 7) % n)).alias("stream"))
    out = wanted.join(e.select(F.col("id").alias("face"), F.col("face").alias("v")), "face").join(e.select(F.col("id").alias("stream"), F.col("stream").alias("a")), "stream")
    return out.select("face", "stream", F.round(P.cosine(F.col("v"), F.col("a")), 6).alias("s"))


@query("j12_score_histogram", f"""WITH {EMB}, s AS (SELECT (a.id = b.id)::INT AS positive, least(floor(({COS} + 1) * 100), 199)::INT AS bin FROM emb a, emb b WHERE a.id = b.id OR a.speaker <> b.speaker) SELECT positive, bin // 10 AS bin, count(*) AS n FROM s GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    out = P.score_histogram(faces(spark, sf_dir), "speaker", bins=200)
    return out.groupBy("positive", F.floor(F.col("bin") / 10).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


@query("j13_batch_statistics", f"""WITH {EMB}, e AS (SELECT *, id // 25 AS batch, concat(speaker, '|', session) AS key FROM emb), p AS (SELECT a.batch, a.id AS i, b.id AS j, {COS} AS s FROM e a JOIN e b ON a.batch = b.batch AND (a.id = b.id OR a.key <> b.key)),
  m AS (SELECT batch, avg(s) FILTER (i = j) AS pos_cos, avg(s) FILTER (i <> j) AS neg_cos FROM p GROUP BY 1), sh AS (SELECT batch, id, list_cosine_similarity(CAST(face AS DOUBLE[]), stream) AS own, CASE WHEN id % 3 > 0 THEN list_cosine_similarity(CAST(face AS DOUBLE[]), list_concat(stream[2:64], stream[1:1])) END AS s FROM e), ss AS (SELECT batch, avg(s) AS shift_cos, avg((own > s)::INT) FILTER (s IS NOT NULL) AS acc_shift FROM sh GROUP BY 1), va AS (SELECT batch, i, arg_max(j, s) AS best FROM p GROUP BY 1, 2), av AS (SELECT batch, j, arg_max(i, s) AS best FROM p GROUP BY 1, 2)
 SELECT m.batch, round(pos_cos, 6) AS pos_cos, round(neg_cos, 6) AS neg_cos, round((SELECT avg((best = i)::INT) FROM va WHERE va.batch = m.batch), 6) AS acc_va, round((SELECT avg((best = j)::INT) FROM av WHERE av.batch = m.batch), 6) AS acc_av, round(shift_cos, 6) AS shift_cos, round(acc_shift, 6) AS acc_shift FROM m LEFT JOIN ss USING (batch)""")
def batch_statistics(spark, sf_dir):
    rows = faces(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / 25)).withColumn("key", F.concat_ws("|", "speaker", "session"))
    rows = rows.withColumn("shifted", F.when(F.col("id") % 3 > 0, F.concat(F.slice("stream", 2, 63), F.slice("stream", 1, 1))))
    out = P.batch_statistics(rows, "batch")
    return out.select("batch", *[F.round(c, 6).alias(c) for c in ("pos_cos", "neg_cos", "acc_va", "acc_av", "shift_cos", "acc_shift")])


@query("j14_verification", f"""WITH {EMB}, s AS (SELECT (a.id = b.id)::INT AS positive, least(floor(({COS} + 1) * 1000), 1999) AS score FROM emb a, emb b WHERE a.id = b.id OR a.speaker <> b.speaker), c AS (SELECT score, sum(positive) AS p, sum(1 - positive) AS n FROM s GROUP BY 1),
  k AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(n * (tp - p / 2e0)) / max(np) / max(nn), 4) AS auc, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg FROM k""")
def verification(spark, sf_dir):
    counts = P.score_histogram(faces(spark, sf_dir), "speaker", bins=2000)
    c = counts.groupBy(F.col("bin").alias("score")).agg(F.sum(F.when(F.col("positive") == 1, F.col("n")).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("positive") == 0, F.col("n")).otherwise(0)).alias("n_neg"))
    points = ordering.global_cumsum(c, [F.col("score").desc()], {"n_pos": "tp"})
    total = points.agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    auc = points.crossJoin(F.broadcast(total)).agg((F.sum(F.col("n_neg") * (F.col("tp") - F.col("n_pos") / 2)) / F.first("P") / F.first("N")).alias("auc"), F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    return auc.select(F.round("auc", 4).alias("auc"), "n_pos", "n_neg")


def _drawn(key: str, n: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {key})), 1, 15))::BIGINT % {n}"


@query("j15_distractors", f"""WITH {EMB}, m AS (SELECT id, speaker, session, row_number() OVER (ORDER BY speaker, id) - 1 AS n FROM emb), sp AS (SELECT *, row_number() OVER (ORDER BY speaker) - 1 AS s FROM (SELECT speaker, min(n) AS first, count(*) AS c FROM m GROUP BY 1) q), tot AS (SELECT count(*) AS t FROM sp),
 st AS (SELECT id AS query, speaker AS qs, step, ({_drawn("'3', id, 'speaker'", "t")} + step) % t AS s FROM (SELECT *, unnest(range(0, least(12, t - 1) + 1)) AS step FROM emb, tot) q),
 o AS (SELECT st.query, sp.first + {_drawn("'3', query, sp.speaker", "c")} AS n, row_number() OVER (PARTITION BY query ORDER BY step) AS pos FROM st JOIN sp ON sp.s = st.s WHERE sp.speaker <> qs), ch AS (SELECT query, pos, m.id AS candidate, m.speaker, m.session FROM o JOIN m ON m.n = o.n WHERE pos <= 12),
 gr AS (SELECT *, row_number() OVER (ORDER BY speaker, session) - 1 AS g FROM (SELECT speaker, session, arg_min(id, md5(concat_ws('|', '3', id))) AS candidate FROM emb GROUP BY 1, 2) q), gt AS (SELECT count(*) AS n FROM gr),
 ar AS (SELECT id AS query, speaker AS qs, step, ({_drawn("'3', id, 'group'", "n")} + step) % n AS g FROM (SELECT *, unnest(range(0, least(25, n - 1) + 1)) AS step FROM emb, gt) q), us AS (SELECT query, speaker, session FROM ch UNION SELECT id, speaker, session FROM emb),
 fr AS (SELECT ar.query, step, gr.candidate, gr.speaker, qs FROM ar JOIN gr ON gr.g = ar.g LEFT JOIN us ON us.query = ar.query AND us.speaker = gr.speaker AND us.session = gr.session WHERE us.query IS NULL),
 mo AS (SELECT fr.query, coalesce(have, 0) + row_number() OVER (PARTITION BY fr.query ORDER BY step) AS pos, candidate, CASE WHEN speaker = qs THEN 'same_speaker_other_session' ELSE 'other_speaker_other_session' END AS kind FROM fr LEFT JOIN (SELECT query, max(pos) AS have FROM ch GROUP BY 1) h ON h.query = fr.query)
 SELECT query, pos::INT AS pos, candidate, 'other_speaker' AS kind FROM ch UNION ALL SELECT query, pos::INT, candidate, kind FROM mo WHERE pos <= 12""")
def distractors(spark, sf_dir):
    e = faces(spark, sf_dir).select("id", "speaker", "session")
    return P.draw_distractors(e, e, 12, 3).select("query", F.col("pos").cast("int").alias("pos"), "candidate", "kind")


@query("j16_noise_clips", f"""WITH {EMB}, r AS (SELECT id, concat(speaker, '|', session) AS key, CAST(id % 11 AS VARCHAR) AS text, speaker FROM emb), pool AS (SELECT * FROM r ORDER BY md5(concat('9|', id)), id LIMIT 64),
  c AS (SELECT r.id, p.id AS clip, row_number() OVER (PARTITION BY r.id ORDER BY (r.speaker = p.speaker)::INT, md5(concat('9|', r.id, '|', p.id)), p.id) AS pos FROM r JOIN pool p ON r.key <> p.key AND r.text <> p.text) SELECT id, pos, clip FROM c WHERE pos <= 3""")
def noise_clips(spark, sf_dir):
    rows = faces(spark, sf_dir).select("id", F.concat_ws("|", "speaker", "session").alias("key"), (F.col("id") % 11).cast("string").alias("text"), "speaker")
    return P.noise_clips(rows, 3, 9).withColumn("pos", F.col("pos").cast("long"))


@query("j17_across_runs", f"WITH {MODES} SELECT utt_id, piece, max(hyp) FILTER (mode = 'audio') AS audio, max(hyp) FILTER (mode = 'av') AS av, max(hyp) FILTER (mode = 'video') AS video FROM modes WHERE snr = 10 GROUP BY 1, 2")
def across_runs(spark, sf_dir):
    return P.across_runs(modes(spark, sf_dir).filter("snr = 10"), ["utt_id", "piece"], "mode", "hyp", ["audio", "av", "video"])


SCORES = f"""{EMB}, cand AS (SELECT a.id AS query, a.speaker, d, (a.id + d * 13) % (SELECT count(*) FROM emb) AS other FROM emb a, (SELECT unnest([0, 1, 2, 3]) AS d)),
  cs AS (SELECT c.query, c.speaker, d, d = 0 AS is_true, round({COS}, 1) + 0e0 AS s FROM cand c JOIN emb a ON a.id = c.query JOIN emb b ON b.id = c.other)"""


def candidate_scores(spark, sf_dir):
    e = faces(spark, sf_dir)
    n = e.count()
    c = e.select(F.col("id").alias("query"), "speaker", F.col("face").alias("v"), F.explode(F.array(*map(F.lit, range(4)))).alias("d")).withColumn("other", (F.col("query") + F.col("d") * 13) % n)
    c = c.join(e.select(F.col("id").alias("other"), F.col("stream").alias("a")), "other")
    return c.select("query", "speaker", "d", (F.col("d") == 0).alias("is_true"), (F.round(P.cosine(F.col("v"), F.col("a")), 1) + 0.0).alias("s"))


@query("a15_nway", f"""WITH {SCORES}, q AS (SELECT query, speaker, max(s) FILTER (is_true) AS t, max(s) FILTER (NOT is_true) AS best FROM cs GROUP BY 1, 2),
  c AS (SELECT q.speaker, CASE WHEN t > best THEN 1e0 WHEN t = best THEN 1e0 / (1 + (SELECT count(*) FROM cs WHERE cs.query = q.query AND NOT is_true AND s = t)) ELSE 0e0 END AS credit FROM q) SELECT speaker, count(*) AS n, round(avg(credit), 6) AS acc FROM c GROUP BY 1""")
def nway(spark, sf_dir):
    out = M.selection_credit(candidate_scores(spark, sf_dir), ["query", "speaker"])
    return out.groupBy("speaker").agg(F.count("*").alias("n"), F.round(F.avg("credit"), 6).alias("acc"))


BOTH_WAYS = f"""{EMB}, cand AS (SELECT a.id AS query, a.speaker, a.session, d, (a.id + d * 13) % (SELECT count(*) FROM emb) AS other FROM emb a, (SELECT unnest(range(0, 6)) AS d) WHERE d <= 1 + a.id % 6),
  cs AS (SELECT 'v2a' AS direction, c.query, c.speaker, c.session, d AS pos, b.speaker <> c.speaker AS far, round({COS}, 1) + 0e0 AS s FROM cand c JOIN emb a ON a.id = c.query JOIN emb b ON b.id = c.other UNION ALL
   SELECT 'a2v', c.query, c.speaker, c.session, d, a.speaker <> c.speaker, round({COS}, 1) + 0e0 FROM cand c JOIN emb b ON b.id = c.query JOIN emb a ON a.id = c.other),
  w AS (SELECT cs.*, n_way FROM cs, (SELECT unnest([2, 4, 6]) AS n_way) WHERE pos < n_way), q AS (SELECT direction, n_way, query, speaker, session, max(s) FILTER (pos = 0) AS t, max(s) FILTER (pos > 0) AS best, count(*) FILTER (pos > 0) AS n, min(far::INT) FILTER (pos > 0) AS far FROM w GROUP BY 1, 2, 3, 4, 5),
  c AS (SELECT q.*, n = n_way - 1 AS ok, CASE WHEN t > best THEN 1e0 WHEN t = best THEN 1e0 / (1 + (SELECT count(*) FROM w WHERE w.direction = q.direction AND w.n_way = q.n_way AND w.query = q.query AND pos > 0 AND s = t)) ELSE 0e0 END AS credit FROM q),
  g AS (SELECT direction, n_way, ok, credit, far, unnest(['all', 'speaker', 'session']) AS grp, unnest(['', speaker, session::VARCHAR]) AS value FROM c)"""


@query("a15_nway_report", f"WITH {BOTH_WAYS} SELECT direction, n_way::INT AS n_way, grp AS \"group\", value, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS n_skipped, round(avg(credit) FILTER (ok), 6) AS acc, round(avg(far) FILTER (ok), 6) AS all_other FROM g GROUP BY 1, 2, 3, 4")
def nway_report(spark, sf_dir):
    e = faces(spark, sf_dir)
    n = e.count()
    c = e.select(F.col("id").alias("query"), "speaker", "session", F.col("face").alias("f0"), F.col("stream").alias("s0"), F.explode(F.sequence(F.lit(0), F.least(F.lit(5), (1 + F.col("id") % 6)).cast("int"))).alias("pos")).withColumn("other", (F.col("query") + F.col("pos") * 13) % n)
    c = c.join(e.select(F.col("id").alias("other"), F.col("face").alias("f1"), F.col("stream").alias("s1"), F.col("speaker").alias("their")), "other")
    kind = F.when(F.col("speaker") != F.col("their"), "other_speaker").otherwise("same_speaker_other_session")
    ways = F.array(F.struct(F.lit("v2a").alias("direction"), P.cosine(F.col("f0"), F.col("s1")).alias("s")), F.struct(F.lit("a2v").alias("direction"), P.cosine(F.col("f1"), F.col("s0")).alias("s")))
    rows = c.select("query", "pos", kind.alias("kind"), "speaker", "session", F.inline(ways)).withColumn("s", F.round("s", 1) + 0.0)
    out = M.nway_report(rows, [2, 4, 6], ["speaker", "session"])
    return out.select("direction", "n_way", "group", "value", "n", "n_skipped", F.round("acc", 6).alias("acc"), F.round("all_other", 6).alias("all_other"))


@query("a16_leakage", f"""WITH {SCORES}, l AS (SELECT cs.*, level, CASE WHEN is_true THEN s - level / 20e0 ELSE s END AS ls FROM cs, (SELECT unnest([0, 5, 10]) AS level)), q AS (SELECT level, query, max(ls) FILTER (is_true) AS t, max(ls) FILTER (NOT is_true) AS best FROM l GROUP BY 1, 2)
 SELECT level, count(*) AS n, sum((t > best)::INT)::BIGINT AS n_strict FROM q GROUP BY 1""")
def leakage(spark, sf_dir):
    rows = candidate_scores(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, (0, 5, 10))))).withColumn("s", F.when(F.col("is_true"), F.col("s") - F.col("level") / 20).otherwise(F.col("s")))
    return M.selection_credit(rows, ["level", "query"]).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("credit") == 1).alias("n_strict"))


OFFSETS = "off AS (SELECT user_id AS query, CAST(event_id % 31 AS INT) - 15 AS o, max(round(value, 0)) AS s FROM events GROUP BY 1, 2), best AS (SELECT query, CAST(arg_max(o, s * 1000 - o) AS INT) AS o FROM off GROUP BY 1)"


def predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query"), (F.col("event_id") % 31 - 15).cast("int").alias("offset")).agg(F.max(F.round("value", 0)).alias("s"))
    return M.offset_predictions(rows, ["query"])


@query("a17_offsets", f"WITH {OFFSETS}, size AS (SELECT user_id AS query, count(*) AS n FROM events GROUP BY 1), tried AS (SELECT size.query, CASE WHEN n >= 62 THEN o END AS o FROM size JOIN best USING (query)) SELECT count(*) FILTER (o IS NULL) AS n_skipped_short, count(o) AS n, round(avg((abs(o) <= 1)::INT), 6) AS acc_pm1, round(avg((o = 0)::INT), 6) AS acc_exact, round(quantile_cont(abs(o), 0.5) * 40, 4) AS median_abs_ms, round(avg(abs(o)) * 40, 4) AS mean_abs_ms FROM tried")
def offsets(spark, sf_dir):
    # windows of 31 frames from the 16th on: a user needs 15 more on either side
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query")).agg(F.count("*").alias("n")).withColumn("start", F.lit(15)).withColumn("fits", M.long_enough(None, 15, 32))
    tried = predictions(spark, sf_dir).join(sizes, "query").select("query", F.when(F.col("fits"), F.col("offset")).alias("offset"))
    out = M.offset_report(tried)
    return out.select("n_skipped_short", "n", F.round("acc_pm1", 6).alias("acc_pm1"), F.round("acc_exact", 6).alias("acc_exact"), F.round("median_abs_ms", 4).alias("median_abs_ms"), F.round("mean_abs_ms", 4).alias("mean_abs_ms"))


@query("a17_offset_histogram", f"WITH {OFFSETS} SELECT CAST(b AS INT) AS \"offset\", (SELECT count(*) FROM best WHERE o = b) AS n FROM range(-15, 16) r(b)")
def offset_bins(spark, sf_dir):
    return M.offset_histogram(predictions(spark, sf_dir), 15)


def scene_scores(spark, sf_dir):
    e = faces(spark, sf_dir).withColumn("scene", F.floor(F.col("id") / 3).cast("int")).withColumn("n", (F.col("id") % 3).cast("int"))
    a, b = e.select("scene", F.col("n").alias("face"), F.col("face").alias("v")), e.select("scene", F.col("n").alias("stream"), F.col("stream").alias("a"))
    return a.join(b, "scene").select("scene", "face", "stream", P.cosine(F.col("v"), F.col("a")).alias("s"))


@query("a18_scenes", f"""WITH {EMB}, e AS (SELECT *, id // 3 AS scene, id % 3 AS k FROM emb), s AS (SELECT a.scene, a.k AS f, b.k AS t, {COS} AS s FROM e a JOIN e b ON a.scene = b.scene), full_ AS (SELECT scene FROM e GROUP BY 1 HAVING count(*) = 3),
  m AS (SELECT scene, max(s) FILTER (f=0 AND t=0) AS a00, max(s) FILTER (f=0 AND t=1) AS a01, max(s) FILTER (f=0 AND t=2) AS a02, max(s) FILTER (f=1 AND t=0) AS a10, max(s) FILTER (f=1 AND t=1) AS a11, max(s) FILTER (f=1 AND t=2) AS a12, max(s) FILTER (f=2 AND t=0) AS a20, max(s) FILTER (f=2 AND t=1) AS a21, max(s) FILTER (f=2 AND t=2) AS a22 FROM s JOIN full_ USING (scene) GROUP BY 1),
  b AS (SELECT a00+a11+a22 AS own, greatest(a00+a12+a21, a01+a10+a22, a01+a12+a20, a02+a10+a21, a02+a11+a20) AS other FROM m) SELECT count(*) AS n, sum((own > other)::INT)::BIGINT AS n_right FROM b""")
def scenes(spark, sf_dir):
    s = scene_scores(spark, sf_dir)
    full = s.groupBy("scene").count().filter("count = 9").select("scene")
    return M.scene_assignments(s.join(full, "scene"), ["scene"]).agg(F.count("*").alias("n"), F.count_if("scene_right").alias("n_right"))


# scenes of two, in windows of 16 components and whole, clean and with leakage
SCENE_SQL = f"""{EMB}, e AS (SELECT id // 2 AS scene, id % 2 AS k, CAST(face AS DOUBLE[]) AS face, stream FROM emb), o AS (SELECT a.scene, a.k, a.face, a.stream, b.stream AS rest FROM e a JOIN e b ON a.scene = b.scene AND a.k <> b.k),
 v AS (SELECT scene, k, face, unnest(['clean', 'leak']) AS variant, unnest([stream, list_transform(range(1, 65), lambda i: stream[i] + 0.8e0 * rest[i])]) AS stream FROM o),
 s AS (SELECT a.variant, a.scene, win, a.k AS f, b.k AS t, list_cosine_similarity(a.face[win * 16 + 1:win * 16 + 16], b.stream[win * 16 + 1:win * 16 + 16]) AS s FROM v a JOIN v b ON a.scene = b.scene AND a.variant = b.variant, (SELECT unnest(range(0, 4)) AS win)),
 m AS (SELECT variant, scene, win, sum(s) FILTER (f = t) AS own, sum(s) FILTER (f <> t) AS crossed FROM s GROUP BY 1, 2, 3)"""


def scene_windows(spark, sf_dir):
    e = faces(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("scene"), (F.col("id") % 2).cast("int").alias("n"), "face", "stream")
    both = e.join(e.select("scene", (1 - F.col("n")).alias("n"), F.col("stream").alias("rest")), ["scene", "n"])
    leak = F.zip_with("stream", "rest", lambda a, b: a + 0.8 * b)
    v = both.select("scene", "n", "face", F.inline(F.array(F.struct(F.lit("clean").alias("variant"), F.col("stream").alias("a")), F.struct(F.lit("leak").alias("variant"), leak.alias("a")))))
    pairs = v.select("variant", "scene", F.col("n").alias("face"), F.col("face").alias("v")).join(v.select("variant", "scene", F.col("n").alias("stream"), "a"), ["variant", "scene"])
    pairs = pairs.withColumn("win", F.explode(F.array(*map(F.lit, range(4)))))
    part = lambda c: F.slice(c, F.col("win") * 16 + 1, F.lit(16))
    return pairs.select("variant", "scene", "win", "face", "stream", P.cosine(part("v"), part("a")).alias("s"))


@query("a18_scene_variants", f"WITH {SCENE_SQL} SELECT variant, count(*) AS n, round(avg((own >= crossed)::INT), 6) AS scene_acc, round(avg((own >= crossed)::INT), 6) AS stream_acc FROM m GROUP BY 1")
def scene_variants(spark, sf_dir):
    return M.scene_report(scene_windows(spark, sf_dir), ["variant"], ["scene", "win"]).select("variant", "n", F.round("scene_acc", 6).alias("scene_acc"), F.round("stream_acc", 6).alias("stream_acc"))


@query("v8_assignments", f"WITH {SCENE_SQL} SELECT variant, scene, win::INT AS win, own >= crossed AS scene_right FROM m")
def assignments(spark, sf_dir):
    return M.scene_assignments(scene_windows(spark, sf_dir), ["variant", "scene", "win"]).select("variant", "scene", "win", "scene_right")


@query("a35_offscreen", f"""WITH {EMB}, e AS (SELECT *, id // 3 AS scene, id % 3 AS k FROM emb), s AS (SELECT a.scene, a.k AS f, b.k AS t, round({COS}, 3) AS s FROM e a JOIN e b ON a.scene = b.scene), r AS (SELECT scene, t, f, s, row_number() OVER (PARTITION BY scene, t ORDER BY s DESC, f) AS n FROM s)
 SELECT scene::INT AS scene, t::INT AS stream, CASE WHEN s >= 0.8e0 THEN f END::INT AS face, s FROM r WHERE n = 1""")
def offscreen(spark, sf_dir):
    return M.offscreen(scene_scores(spark, sf_dir).withColumn("s", F.round("s", 3)), ["scene", "stream"], 0.8)


@query("s9_report_rows", f"WITH {BIN}, r AS (SELECT speaker, sum(score)::DOUBLE / nullif(sum(CASE WHEN positive = 0 THEN 1 ELSE 0 END), 0) AS ratio FROM bin GROUP BY 1) SELECT speaker, CASE WHEN isnan(ratio) OR isinf(ratio) THEN NULL ELSE round(ratio, 6) END AS ratio FROM r")
def report_rows(spark, sf_dir):
    from ..sources.writers import finite

    rows = binary_scores(spark, sf_dir).groupBy("speaker").agg(F.sum("score").cast("double").alias("a"), F.count_if(F.col("positive") == 0).alias("b"))
    return rows.select("speaker", finite(F.round(F.try_divide("a", F.col("b")), 6)).alias("ratio"))


@query("t6_example_queries", f"""WITH {SCORES}, n AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT query FROM cs)), p AS (SELECT query FROM n WHERE k IN (SELECT CAST(floor(j * (m / 5e0)) AS BIGINT) FROM range(0, 5) r(j)))
 SELECT query, max(s) FILTER (is_true) AS true_score, array_to_string(list_sort(list(s) FILTER (NOT is_true)), ',') AS others, max(s) FILTER (is_true) > max(s) FILTER (NOT is_true) AS correct FROM cs JOIN p USING (query) GROUP BY 1""")
def examples(spark, sf_dir):
    from ..operators.manifest import even_subset

    rows = candidate_scores(spark, sf_dir)
    picked = even_subset(rows.select("query").distinct(), 5, "query")
    out = rows.join(F.broadcast(picked), "query").groupBy("query").agg(F.max(F.when(F.col("is_true"), F.col("s"))).alias("true_score"), F.array_sort(F.collect_list(F.when(~F.col("is_true"), F.col("s")))).alias("o"))
    return out.select("query", "true_score", F.array_join(F.col("o").cast("array<string>"), ",").alias("others"), (F.col("true_score") > F.array_max("o")).alias("correct"))
