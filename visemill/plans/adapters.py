"""The model's tables built from the driver's: DataFrames, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows: one for each order line number, the first by price, part, supplier and date."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rows.selectExpr(
        "l_orderkey AS video_stem", "l_linenumber AS sentence_id", "concat(l_orderkey, '__', l_linenumber) AS utt_id", "concat('S', l_suppkey) AS speaker",
        "l_returnflag AS angle", "l_linestatus AS split_dir", "l_partkey % 12 AS session", "l_suppkey % 2 + 1 AS noise_env", "l_linenumber * 20e0 AS start_s",
        "l_linenumber * 20e0 + l_quantity / 3 AS end_s", "l_quantity / 3 AS duration", "CAST(l_quantity * 10 AS BIGINT) AS n_frames", "1 - l_discount AS lm_valid_ratio",
        "l_tax AS time_shift", "l_tax > 0.065e0 AS has_unk",
    )


UTT = """utt AS (SELECT video_stem, sentence_id, concat(video_stem, '__', sentence_id) AS utt_id, speaker, angle, split_dir,
       session, noise_env, start_s, start_s + duration AS end_s, duration, n_frames, lm_valid_ratio, time_shift, has_unk
FROM (SELECT l_orderkey AS video_stem, l_linenumber AS sentence_id, concat('S', l_suppkey) AS speaker,
             l_returnflag AS angle, l_linestatus AS split_dir, l_partkey % 12 AS session, l_suppkey % 2 + 1 AS noise_env,
             l_linenumber * 20e0 AS start_s, l_quantity / 3 AS duration, CAST(l_quantity * 10 AS BIGINT) AS n_frames,
             1 - l_discount AS lm_valid_ratio, l_tax AS time_shift, l_tax > 0.065e0 AS has_unk,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                ORDER BY l_extendedprice, l_partkey, l_suppkey, l_shipdate) AS rn
      FROM lineitem) q
WHERE rn = 1)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").withColumn("end_s", F.sum(F.expr("length(text) / 15e0 + (turn % 5) * 0.15e0")).over(w))
    return rows.selectExpr("conv_id AS video_stem", "turn AS sentence_id", "role AS topic", "text", "end_s - length(text) / 15e0 AS start_s", "end_s")


SENT = """sent AS (SELECT conv_id AS video_stem, turn AS sentence_id, role AS topic, text,
       s_end - length(text) / 15e0 AS start_s, s_end AS end_s
FROM (SELECT conv_id, turn, role, text,
             sum(length(text) / 15e0 + (turn % 5) * 0.15e0) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_end
      FROM conversations) q)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("utt_key"), (F.row_number().over(w) - 1).alias("k"), "ts", F.col("value").alias("x"), (F.col("event_type") != "error").alias("valid"), "event_type"
    )


FRAMES = """frames AS (SELECT user_id AS utt_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS k, ts,
       value AS x, event_type <> 'error' AS valid, event_type
FROM events)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: successive pieces of up to 100 characters of each whole text, and what was heard."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS utt_id", "source AS speaker", "lang AS angle", "posexplode(regexp_extract_all(text, '(?s).{1,100}', 0)) AS (piece, ref)")
    return rows.withColumn("hyp", F.expr("replace(replace(ref, 'th', 't'), 'on', 'onn')"))


def single_bytes(text: str) -> str:
    """SQL: ``text`` with every character beyond printable ASCII as a control character of its own, for DuckDB compares bytes."""
    return f"translate({text}, (SELECT chars FROM odd), '{''.join(map(chr, [*range(1, 32), 127]))}')"


REFS = """odd AS (SELECT string_agg(c, '' ORDER BY c) AS chars FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) q WHERE unicode(c) > 126 OR unicode(c) BETWEEN 1 AND 31),
 refs AS (SELECT doc_id AS utt_id, source AS speaker, lang AS angle, (piece - 1)::INT AS piece, ref, replace(replace(ref, 'th', 't'), 'on', 'onn') AS hyp
FROM (SELECT doc_id, source, lang, unnest(p) AS ref, generate_subscripts(p, 1) AS piece FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '(?s).{1,100}') AS p FROM documents) t) q)"""


# letters and digits of a text spoken as syllables: the k-th sign below as the syllable 373 k places after the first; X stays, as do signs
# that the normal form knows or drops, and letters beyond ASCII, which have no token
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWYZ0123456789:;+=%&#@$^|`\\"
SYLLABLES = "".join(chr(0xAC00 + 373 * k % 11172) for k in range(len(SIGNS)))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): every whole text in Hangul; empty for a null text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), SIGNS, SYLLABLES).alias("raw"))


def spoken_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, raw): the same as successive utterances of up to 60 characters."""
    pieces = spoken(spark, sf_dir).select("doc_id", F.posexplode(F.expr("regexp_extract_all(raw, '(?s).{1,60}', 0)")).alias("piece", "raw"))
    return pieces.select(F.concat_ws("_", "doc_id", "piece").alias("utt_id"), "raw").repartition(spark.sparkContext.defaultParallelism * 2)  # a long text is many pieces


RAW = f"translate(coalesce(text, ''), '{SIGNS}', '{SYLLABLES}')"
SPOKEN = f"spoken AS (SELECT doc_id, {RAW} AS raw FROM documents)"
SPOKEN_PIECES = f"spoken AS (SELECT concat(doc_id, '_', piece - 1) AS doc_id, raw FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS piece FROM (SELECT doc_id, regexp_extract_all({RAW}, '(?s).{{1,60}}') AS l FROM documents)))"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = "transform(sequence(1, size(embedding)), i -> 0.8D * element_at(embedding, i) + 0.2D * element_at(embedding, size(embedding) + 1 - i))"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "concat('S', label) AS speaker", "vec_id % 7 AS session", "embedding AS face", f"{stream} AS stream")


EMB = """emb AS (SELECT vec_id AS id, concat('S', label) AS speaker, vec_id % 7 AS session, embedding AS face,
       list_transform(range(1, 65), lambda i: 0.8e0 * embedding[i] + 0.2e0 * embedding[65 - i]) AS stream
FROM embeddings)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url AS rel_path", "CAST(CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS size")


FILES = "files AS (SELECT page_id, url AS rel_path, CAST(CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS size FROM pages)"


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("doc_id", "quality AS positive", "n_chars % 50 AS score", "source AS speaker")


BIN = "bin AS (SELECT d.doc_id, l.quality AS positive, d.n_chars % 50 AS score, d.source AS speaker FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS video_stem", "o_orderstatus = 'F' AS done", "o_custkey % 40 AS part")


VIDEOS = "videos AS (SELECT o_orderkey AS video_stem, o_orderstatus = 'F' AS done, o_custkey % 40 AS part FROM orders)"
