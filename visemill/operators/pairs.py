"""Pairs of faces and streams: blockwise scores, verification, masks, distractors, noise clips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_row_number, hash_order


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def mean_frame_cosine(video: Column, audio: Column, frames: Column) -> Column:
    """Mean over frames of the dot product of flattened vectors, already of norm one in each frame."""
    return F.aggregate(F.zip_with(video, audio, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v) / frames


def negative_columns(rows: DataFrame) -> str:
    """What tells negatives apart: the speaker, or with a single speaker the session."""
    return "speaker" if rows.select("speaker").distinct().limit(2).count() == 2 else "session"


def score_histogram(rows: DataFrame, negative: str | None = None, *, bins: int = 2000, block_rows: int = 4096) -> DataFrame:
    """Counts of binned cosines (positive, bin, n) over all (face, stream) pairs of ``rows(id, face, stream, speaker,
    session)``, for verification: positives are a row's own pair, negatives those whose ``negative`` columns (comma
    separated; by default those of ``negative_columns``) differ. Scores lie in [-1, 1]; bin b covers [-1 + 2b / bins, -1 + 2(b + 1) / bins).

    Both sides are dealt to blocks of about ``block_rows``, of a large table up to four times as many; a task multiplies one block of faces by one of streams and
    sends counts only. Every pair is scored, as verification asks, so the work grows with the square of the rows.
    """
    n = rows.count()
    # a row is sent to every block of the other side, so blocks of a large table are larger
    blocks = max(1, -(-n // min(max(block_rows, n // 16), 4 * block_rows)))
    keys = [c.strip() for c in (negative or negative_columns(rows)).split(",")]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("id", "face", *keys, block.alias("a")).withColumn("b", other)
    right = rows.select("id", "stream", *keys, block.alias("b")).withColumn("a", other)

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.array(vectors.tolist(), dtype=np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]

    def count(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((2, bins), dtype=np.int64)
        if len(f) and len(s):
            # rows whose keys are all the same have the same number, in the order of which streams lie
            both = pd.concat([f[keys], s[keys]], ignore_index=True)
            group = both.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            mine, order = group[: len(f)], np.argsort(group[len(f) :], kind="stable")
            theirs, v = group[len(f) :][order], np.ascontiguousarray(unit(s["stream"])[order].T)
            first, last = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, side="right")
            faces, ids = unit(f["face"]), f["id"].to_numpy()
            places = pd.Series(np.arange(len(s))).groupby(s["id"].to_numpy()[order]).indices  # of a row's own stream
            for a in range(0, len(f), 64):  # a part's scores stay in the cache
                score = faces[a : a + 64] @ v
                score += 1
                score *= bins / 2
                at = score.astype(np.int32)
                np.clip(at, 0, bins - 1, out=at)
                # all pairs, less those of equal keys
                out[0] += np.bincount(at.ravel(), minlength=bins)
                out[0] -= np.bincount(np.concatenate([x[i:j] for x, i, j in zip(at, first[a : a + 64], last[a : a + 64])]), minlength=bins)
                own = [x[places[i]] for x, i in zip(at, ids[a : a + 64]) if i in places]
                if own:
                    out[1] += np.bincount(np.concatenate(own), minlength=bins)
        p, b = np.nonzero(out)
        return pd.DataFrame({"positive": p.astype("int32"), "bin": b.astype("int32"), "n": out[p, b]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(count, "positive int, bin int, n long").groupBy("positive", "bin").agg(F.sum("n").alias("n"))


def batch_statistics(rows: DataFrame, batch: str) -> DataFrame:
    """By batch of ``rows(id, key, face, stream, <batch>)``: mean cosine of own pairs and of negatives (pairs of other
    ``key``; equal keys share sound and count as neither), share of faces whose best allowed stream is their own, and
    of streams likewise. With a column ``shifted`` (the own stream at another time, or null) also shift_cos and acc_shift,
    the mean cosine with it and how often the stream in time scores higher. Batches are small by construction."""
    a = rows.select(batch, F.col("id").alias("i"), F.col("key").alias("ki"), "face")
    b = rows.select(batch, F.col("id").alias("j"), F.col("key").alias("kj"), "stream")
    pairs = a.join(b, batch).filter("i = j or ki <> kj").withColumn("s", cosine(F.col("face"), F.col("stream"))).select(batch, "i", "j", "s")
    means = pairs.groupBy(batch).agg(F.avg(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("pos_cos"), F.avg(F.when(F.col("i") != F.col("j"), F.col("s"))).alias("neg_cos"))
    va = pairs.groupBy(batch, "i").agg(F.max_by("j", "s").alias("best")).groupBy(batch).agg(F.avg((F.col("best") == F.col("i")).cast("double")).alias("acc_va"))
    av = pairs.groupBy(batch, "j").agg(F.max_by("i", "s").alias("best")).groupBy(batch).agg(F.avg((F.col("best") == F.col("j")).cast("double")).alias("acc_av"))
    out = means.join(va, batch).join(av, batch)
    if "shifted" not in rows.columns:
        return out
    both = rows.filter("shifted is not null").select(batch, cosine(F.col("face"), F.col("stream")).alias("_own"), cosine(F.col("face"), F.col("shifted")).alias("_s"))
    return out.join(both.groupBy(batch).agg(F.avg("_s").alias("shift_cos"), F.avg((F.col("_own") > F.col("_s")).cast("double")).alias("acc_shift")), batch, "left")


def draw_distractors(pool: DataFrame, queries: DataFrame, k: int, seed: int) -> DataFrame:
    """(query, pos, candidate, kind): up to ``k`` distractors of each row of ``queries(id, speaker, session)`` from
    ``pool(id, speaker, session)``, in a hash order of the seed.

    First one row of each other speaker; then, if speakers run out, rows of (speaker, session) groups not used yet, of
    other speakers or of the query's own. Speakers are numbered and each query looks at the few that come first in its
    own rotation, so nothing grows with queries times rows.
    """
    members = global_row_number(pool.select("id", "speaker", "session"), [F.col("speaker"), F.col("id")], "_n")
    first = members.groupBy("speaker").agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    speakers = global_row_number(first, [F.col("speaker")], "_s")
    total = speakers.count()
    pick = lambda of, n: F.pmod(F.conv(F.substring(hash_order(F.lit(seed), *of), 1, 15), 16, 10).cast("long"), n)
    q = queries.select(F.col("id").alias("query"), F.col("speaker").alias("_qs"), F.col("session").alias("_qe"))
    steps = q.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(min(k, max(total - 1, 0)))))).withColumn("_s", F.pmod(pick((F.col("query"), F.lit("speaker")), F.lit(max(total, 1))) + F.col("_step"), F.lit(max(total, 1))))
    others = steps.join(speakers, "_s").filter("speaker <> _qs")
    others = others.withColumn("_n", F.col("_first") + pick((F.col("query"), F.col("speaker")), F.col("_count"))).drop("speaker")
    chosen = others.join(members, "_n").withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("_step"))).filter(F.col("pos") <= k)
    chosen = chosen.select("query", "_qs", "_qe", "pos", F.col("id").alias("candidate"), "speaker", "session", F.lit("other_speaker").alias("kind"))
    if total - 1 >= k:
        return chosen.select("query", "pos", "candidate", "kind")
    # speakers are fewer than distractors: go on with unused recordings. At most k + 1 are used, so that of the next
    # 2k + 2 in the query's own rotation k are free, or all that there are have been looked at
    groups = pool.groupBy("speaker", "session").agg(F.min_by("id", hash_order(F.lit(seed), F.col("id"))).alias("candidate"))
    groups = global_row_number(groups, [F.col("speaker"), F.col("session")], "_g")
    n = max(groups.count(), 1)
    around = q.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(min(2 * k + 1, n - 1))))).withColumn("_g", F.pmod(pick((F.col("query"), F.lit("group")), F.lit(n)) + F.col("_step"), F.lit(n)))
    used = chosen.select("query", "speaker", "session").union(q.select("query", "_qs", "_qe"))
    free = around.join(groups, "_g").join(used, ["query", "speaker", "session"], "left_anti")
    have = chosen.groupBy("query").agg(F.max("pos").alias("_have"))
    free = free.join(have, "query", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    kind = F.when(F.col("speaker") == F.col("_qs"), "same_speaker_other_session").otherwise("other_speaker_other_session")
    more = free.withColumn("pos", F.col("_have") + F.row_number().over(Window.partitionBy("query").orderBy("_step"))).filter(F.col("pos") <= k).select("query", "pos", "candidate", kind.alias("kind"))
    return chosen.select("query", "pos", "candidate", "kind").union(more)


def noise_clips(rows: DataFrame, n: int | Column, seed: int, pool_size: int = 64, others_only: bool = False) -> DataFrame:
    """(id, pos, clip): ``n`` clips (a number, or a column of ``rows``) for each row of ``rows(id, key, text, speaker)`` from
    a hashed pool of bounded size, of other sound and other text, those of other speakers first, or with ``others_only``
    none but those (a voice that leaks into a recording).

    The pool is an array of ``pool_size`` entries in the plan, so each row chooses for itself and nothing is shuffled.
    """
    pool = rows.select("id", "key", "text", "speaker").orderBy(hash_order(F.lit(seed), F.col("id")), "id").limit(pool_size).collect()
    kinds = {c: rows.schema[c].dataType for c in ("id", "key", "text", "speaker")}
    entries = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items()]) for r in pool])
    fits = F.filter(entries, lambda p: (p["key"] != F.col("key")) & (p["text"] != F.col("text")) & (p["speaker"] != F.col("speaker") if others_only else F.lit(True)))
    ranked = F.array_sort(F.transform(fits, lambda p: F.struct((p["speaker"] == F.col("speaker")).cast("int").alias("own"), hash_order(F.lit(seed), F.col("id"), p["id"]).alias("h"), p["id"].alias("clip"))))
    out = rows.withColumn("_n", n if isinstance(n, Column) else F.lit(n)).select("id", F.posexplode(F.slice(ranked, F.lit(1), F.col("_n"))).alias("pos", "p")) if pool else rows.limit(0).select("id", F.lit(0).alias("pos"), F.struct(F.col("id").alias("clip")).alias("p"))
    return out.select("id", (F.col("pos") + 1).alias("pos"), "p.clip")


def noise_pool(rows: DataFrame, size: int, seed: int, longest: int = 1 << 20) -> list[tuple]:
    """``size`` rows (id, wave) of ``rows(id, wave)`` of a hash order, as a list: the clips that babble is made of. The first
    ``longest`` samples of a clip serve, so the list is bounded whatever the rows hold."""
    picked = rows.orderBy(hash_order(F.lit(seed), F.col("id")), "id").limit(size)
    return [(r.id, bytes(r.wave[:longest]) if isinstance(r.wave, (bytes, bytearray)) else r.wave[:longest]) for r in picked.collect()]


def across_runs(runs: DataFrame, key: list[str], run: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key, a column for each run."""
    return runs.groupBy(*key).pivot(run, names).agg(F.first(value))
