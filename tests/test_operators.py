import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visemill.operators import alignment as A
from visemill.operators import intervals as I
from visemill.operators import manifest as M
from visemill.operators import metrics as X
from visemill.operators import ordering as O
from visemill.operators import pairs as P
from visemill.operators import segments as G
from visemill.operators import signal as S


def test_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.v == r.n for r in O.global_row_number(df, [F.col("v")], "n").collect())
    sums = O.global_cumsum(df, [F.col("v").desc()], {"v": "s"}).collect()
    assert all(r.s == sum(range(r.v, 1000)) for r in sums)


def test_even_subset_and_shards(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(10)], "utt_id string")
    assert sorted(r.utt_id for r in M.even_subset(df, 3).collect()) == ["00", "03", "06"]
    assert M.even_subset(df, 20).count() == 10
    stems = spark.range(26).select(F.col("id").alias("video_stem"))
    parts = [[r.video_stem for r in M.shard(stems, k, 4).collect()] for k in (1, 2, 3, 4)]
    assert sorted(map(len, parts)) == [6, 6, 7, 7] and sorted(sum(parts, [])) == list(range(26))


def greedy(lengths, budget):
    out, size = [], 0
    for v in sorted(lengths):
        if out and (size + 1) * v <= budget:
            out[-1].append(v)
            size += 1
        else:
            out.append([v])
            size = 1
    return out


def test_length_batches_are_the_greedy_ones(spark):
    r = np.random.default_rng(2)
    lengths = [int(x) for x in r.integers(1, 60, 400)] + [500, 500, 900]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    rows = M.length_batches(df, "n", 400, "id", epoch=1).collect()
    assert sorted(x.id for x in rows) == list(range(len(lengths)))
    got = pd.DataFrame([(x.batch, x.n) for x in rows]).groupby(0)[1].apply(sorted).tolist()
    assert got == greedy(lengths, 400)
    order = {x.batch: x.batch_order for x in rows}
    assert sorted(order.values()) == list(range(len(order)))
    other = {x.batch: x.batch_order for x in M.length_batches(df, "n", 400, "id", epoch=2).collect()}
    assert other != order


def test_copy_plan_puts_the_marker_last(spark):
    src = spark.createDataFrame([("v", "v.npz", 5), ("v", "v.done", 1), ("w", "w.npz", 5), ("w", "w.done", 1), ("x", "x.npz", 1), ("x", "x.done", 1)], "video_stem string, rel_path string, size long")
    dst = spark.createDataFrame([("v.npz", 4), ("v.done", 1), ("w.npz", 5), ("w.done", 1), ("x.npz", 1)], "rel_path string, size long")
    assert sorted(map(tuple, M.copy_plan(src, dst).collect())) == [("v", "v.done", 1, 2), ("v", "v.npz", 5, 1), ("x", "x.done", 1, 1)]


def test_error_rates(spark):
    df = spark.createDataFrame([("ab cd", "abcd"), ("a b c", "a x c")], "ref string, hyp string")
    assert df.agg(X.cer(F.col("ref"), F.col("hyp"))).first()[0] == pytest.approx(1 / 7)
    assert df.agg(X.wer(F.col("ref"), F.col("hyp"))).first()[0] == pytest.approx(3 / 5)
    empty = spark.createDataFrame([(" ", "x")], "ref string, hyp string")
    assert empty.agg(X.cer(F.col("ref"), F.col("hyp")), X.wer(F.col("ref"), F.col("hyp"))).first() == (None, None)


def test_thresholds(spark):
    av = spark.createDataFrame([(20.0, 0.1), (10.0, 0.2), (5.0, 0.6), (0.0, 0.9)], "snr double, cer double")
    assert tuple(X.suggest_threshold(av, 0.5).first()) == (5.0, "ok")
    assert tuple(X.suggest_threshold(av, 0.95).first()) == (None, "video_never_better")
    assert tuple(X.suggest_threshold(av, 0.05).first()) == (20.0, "video_always_better")
    assert tuple(X.suggest_threshold(av.limit(0), 0.5).first()) == (None, "no_data")


def roc(pos, neg):
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    pts, d0, f0, t0 = sorted({*pos, *neg}, reverse=True), 1.0, 0.0, None
    for t in pts:
        f = np.mean([n >= t for n in neg])
        d = np.mean([p < t for p in pos]) - f
        if d <= 0:
            a = d0 / (d0 - d)
            return auc, f0 + a * (f - f0), t if t0 is None else t0 + a * (t - t0)
        d0, f0, t0 = d, f, t


@pytest.mark.parametrize("pos,neg", [([0.9, 0.8, 0.4], [0.5, 0.3, 0.1]), ([1.0], [1.0]), ([1, 2, 2, 3], [0, 1, 2, 2, 5]), ([5.0], [1.0, 2.0])])
def test_roc(spark, pos, neg):
    df = spark.createDataFrame([(float(p), 1) for p in pos] + [(float(n), 0) for n in neg], "score double, positive int")
    got = X.auc_and_eer(df).first()
    assert (got.auc, got.eer, got.threshold) == pytest.approx(roc(pos, neg))
    none = X.auc_and_eer(df.filter("positive = 1")).first()
    assert none.auc is None and none.eer is None


def test_credit_and_assignment(spark):
    rows = [("a", 1.0, True), ("a", 0.5, False), ("b", 1.0, True), ("b", 1.0, False), ("c", 1.0, True), ("c", 1.0, False), ("c", 1.0, False), ("d", 0.1, True), ("d", 1.0, False), ("e", 0.1, True)]
    got = {r.q: r.credit for r in X.selection_credit(spark.createDataFrame(rows, "q string, s double, is_true boolean"), ["q"]).collect()}
    assert got == pytest.approx({"a": 1, "b": 0.5, "c": 1 / 3, "d": 0, "e": 1})
    assert X.best_assignment(np.array([[0.1, 0.9, 0.2], [0.8, 0.7, 0.1], [0.3, 0.6, 0.5]])).tolist() == [1, 0, 2]


def one_alignment(a, b):
    """The preferred alignment by recursion over prefixes: pairs of ids."""
    cost = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)

    def back(i, j):
        if not i and not j:
            return []
        ways = [((i - 1, j - 1), (a[i - 1], b[j - 1]), a[i - 1] != b[j - 1])] if i and j else []
        ways += [((i - 1, j), (a[i - 1], None), 1)] if i else []
        ways += [((i, j - 1), (None, b[j - 1]), 1)] if j else []
        at, pair, _ = next(w for w in ways if cost[i, j] == cost[w[0]] + w[2])
        return [*back(*at), pair]

    return back(len(a), len(b))


def test_edit_alignment(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [([1, 2, 3], [1, 3, 4]), ([], [5]), ([6], []), ([], []), (None, [1]), (None, None)]
    rows += [tuple(r.integers(0, 4, r.integers(0, 25)).tolist() for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, r array<int>, h array<int>")
    want = [one_alignment(a or [], b or []) for a, b in rows]
    assert [[tuple(p) for p in g[1]] for g in df.select("k", X.align_ids("r", "h")).orderBy("k").collect()] == want
    monkeypatch.setattr(X, "CELLS", 12)  # halves of halves
    for a, b in rows[6:]:
        steps = X._way(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        i, j, got = 0, 0, []
        for s in steps.tolist():
            got.append((a[i] if s != X.HYP else None, b[j] if s != X.REF else None))
            i, j = i + (s != X.HYP), j + (s != X.REF)
        assert got == one_alignment(a, b)


def test_alignment_of_a_long_text():
    """12,000 tokens against as many: a table of all steps would have 144 million cells."""
    r = np.random.default_rng(5)
    a = r.integers(0, 60, 12_000)
    b = np.delete(np.where(r.random(12_000) < 0.1, r.integers(0, 60, 12_000), a), r.integers(0, 12_000, 300))
    steps = X._way(a, b)
    i, j = np.cumsum(steps != X.HYP) - 1, np.cumsum(steps != X.REF) - 1
    wrong = (steps != X.BOTH) | (a[np.maximum(i, 0)] != b[np.maximum(j, 0)])
    assert wrong.sum() == X.char_distance("".join(chr(33 + x) for x in a), "".join(chr(33 + x) for x in b))


def test_edits_without_python_for_short_texts(spark):
    r = np.random.default_rng(6)
    rows = [tuple("".join(r.choice(list("abé "), r.integers(0, 30))) for _ in range(2)) for _ in range(300)] + [("", ""), (None, "a"), ("a", None), ("same", "same")]
    df = spark.createDataFrame(rows, "r string, h string")
    both = df.select("r", "h", X.edits(F.col("r"), F.col("h"), 40).alias("short"), X.edits(F.col("r"), F.col("h")).alias("any"))
    assert all(x.short == x.any == (None if x.r is None or x.h is None else X.char_distance(x.r, x.h)) for x in both.collect())
    assert "Python" not in df.select(X.edits(F.col("r"), F.col("h"), 40))._jdf.queryExecution().toString()


def test_distractors_follow_the_rules(spark):
    pool = spark.createDataFrame([(i, f"S{i % 3}", i // 3 % 4) for i in range(60)], "id long, speaker string, session int")
    of = {r.id: r for r in pool.collect()}
    small = {(r.query, r.pos): r.candidate for r in P.draw_distractors(pool, pool, 2, 7).collect()}
    rows = P.draw_distractors(pool, pool, 6, 7).collect()
    assert {(r.query, r.pos): r.candidate for r in rows if r.pos <= 2} == small
    by = {}
    for r in rows:
        by.setdefault(r.query, []).append(r)
    for q, picks in by.items():
        picks.sort(key=lambda r: r.pos)
        assert [r.pos for r in picks] == [1, 2, 3, 4, 5, 6]
        groups = {(of[q].speaker, of[q].session)} | {(of[r.candidate].speaker, of[r.candidate].session) for r in picks}
        assert len(groups) == 7
        assert len({of[r.candidate].speaker for r in picks[:2]} - {of[q].speaker}) == 2
        assert all((r.kind == "same_speaker_other_session") == (of[r.candidate].speaker == of[q].speaker) for r in picks[2:])


def test_score_histogram_counts_every_pair(spark):
    r = np.random.default_rng(0)
    rows = [(i, f"S{i % 4}", [float(x) for x in r.normal(size=8)], [float(x) for x in r.normal(size=8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, speaker string, face array<double>, stream array<double>")
    got = P.score_histogram(df, "speaker", bins=50).collect()
    assert sum(x.n for x in got if x.positive) == 50
    assert sum(x.n for x in got if not x.positive) == sum(a[1] != b[1] for a in rows for b in rows)


def test_running_median_holds_over_nulls(spark):
    rows = [(1, k, v) for k, v in enumerate([None, 100.0, 102.0, 500.0, 101.0, 99.0, None])]
    got = I.running_median(spark.createDataFrame(rows, "u int, k int, v double"), ["u"], "k", "v", 5).orderBy("k").collect()
    assert [r["median"] for r in got] == [None, 100.0, 101.0, 102.0, 101.5, 101.0, 101.0]


def test_moving_stats_and_runs_match_the_array_helpers(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=40)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "u int, k int, x double")
    for width in (1, 4, 7):
        got = I.moving_stats(df, "u", "k", "x", width).orderBy("k").collect()
        near = [[x[min(max(k + d, 0), 39)] for d in range(-(width // 2), width - width // 2)] for k in range(40)]
        assert np.allclose([g.moving_mean for g in got], np.mean(near, axis=1)) and np.allclose([g.moving_std for g in got], np.std(near, axis=1), atol=1e-6)
    active = x > 0
    df = spark.createDataFrame([(1, k, bool(v)) for k, v in enumerate(active)], "u int, k int, a boolean")
    got = sorted((r.start, r.stop) for r in I.active_runs(df, "u", "k", "a", least=2, hangover=1, gap=2).collect())
    # a frame counts if its run has two or more, or if the frame before does; one frame between two such is closed
    keep = [bool(active[k] and (active[max(k - 1, 0)] and k or active[min(k + 1, 39)] and k < 39)) for k in range(40)]
    hung = [keep[k] or (k > 0 and keep[k - 1]) for k in range(40)]
    whole = [hung[k] or (0 < k < 39 and hung[k - 1] and hung[k + 1]) for k in range(40)]
    assert [any(a <= k < b for a, b in got) for k in range(40)] == whole


def test_packing_bridges_the_shortest_pauses_first():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 9))
        edge = np.cumsum(r.choice([0.2, 0.5, 1.0], 2 * n))
        start, end = edge[::2], edge[1::2]
        groups = [[k] for k in range(n)]
        while True:  # by the definition: again and again the shortest pause that can be bridged
            ways = [(start[b[0]] - end[a[-1]], i) for i, (a, b) in enumerate(zip(groups, groups[1:])) if end[b[-1]] - start[a[0]] <= 3.0]
            if not ways:
                break
            i = min(ways)[1]
            groups[i] += groups.pop(i + 1)
        assert G.pack_over_pauses(start, end, 3.0).tolist() == [g for g, members in enumerate(groups) for _ in members]


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, low = int(r.integers(5, 14)), int(r.integers(1, 4))
        high = low + int(r.integers(0, 4))
        price = r.random(n + 1)

        def cost(cuts):
            return sum(price[c] for c in cuts[1:-1]) + sum(0.5 + 0.05 * ((b - a) / 4.0) ** 2 for a, b in zip(cuts, cuts[1:]))

        def ways(cuts):
            if cuts[-1] == n:
                yield cuts
            for size in range(low, high + 1):
                if cuts[-1] + size <= n:
                    yield from ways([*cuts, cuts[-1] + size])

        best = min((cost(c) for c in ways([0])), default=None)
        got = G.cheapest_cuts(price, low, high, 4.0)
        assert (got is None) == (best is None) and (got is None or cost(got.tolist()) == pytest.approx(best))
    assert G.cut_span(0.0, 9.0, np.zeros(91), 10.0, 5.0, 8.0).tolist() == [0.0, 4.5, 9.0]  # no pieces of 5 to 8 seconds


def test_short_spans_grow_and_pads_meet_in_the_middle(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for u in range(20):
        edge = np.cumsum(r.choice([0.1, 0.3, 0.9, 1.4], 14))
        spans, total = list(zip(edge[::2].tolist(), edge[1::2].tolist())), float(edge[-1]) + 0.3
        rows += [(u, a, b, total) for a, b in spans]
        grown = []
        for k, (a, b) in enumerate(spans):
            left_room, right_room = a - (grown[-1][1] if grown else 0.0), (spans[k + 1][0] if k < 6 else total) - b
            need = max(0.0, 1.0 - (b - a))
            right = min(need - min(need / 2, left_room), right_room)
            grown.append((a - min(need - right, left_room), b + right))
        want[u] = grown
    df = spark.createDataFrame(rows, "u int, start double, end double, total double")
    got = {}
    for x in G.grow_short(df, "u", 1.0).orderBy("u", "start").collect():
        got.setdefault(x.u, []).append((x.start, x.end))
    assert all(np.allclose(got[u], want[u]) for u in want)
    padded = G.pad_to_middle(df, "u", 0.2).orderBy("u", "start").collect()
    for (u, a, b, total), x in zip(sorted(rows), padded):
        assert x.start <= a and x.end >= b and 0 <= x.start and x.end <= total and a - x.start <= 0.2 + 1e-9 and x.end - b <= 0.2 + 1e-9
    assert all(x.u != y.u or x.end <= y.start + 1e-9 for x, y in zip(padded, padded[1:]))


RATE = 16000


def heard(spark, wave, **limits):
    db = S.frame_energy_db(wave, RATE)
    levels = spark.createDataFrame([("w", k, float(v)) for k, v in enumerate(db)], "u string, k int, db double")
    totals = spark.createDataFrame([("w", len(wave) / RATE)], "u string, total double")
    return [(x.start, x.end) for x in G.energy_segments(levels, "u", totals, **limits).orderBy("n").collect()]


def test_energy_segments(spark):
    r = np.random.default_rng(0)

    def noise(s):
        return r.normal(size=int(s * RATE)) * 1e-3

    def tone(s):
        return 0.3 * np.sin(2 * np.pi * 200 * np.arange(int(s * RATE)) / RATE)

    (a, b), = heard(spark, np.concatenate([noise(2), tone(3) + noise(3), noise(2)]))
    assert a == pytest.approx(1.8, abs=0.1) and b == pytest.approx(5.5, abs=0.1)  # onset less padding; offset, hangover, padding
    pieces = heard(spark, np.concatenate([noise(1), tone(20) + noise(20), noise(1)]))
    assert len(pieces) == 3 and min(b - a for a, b in pieces) > 6 and max(b - a for a, b in pieces) <= 8 + 1e-6
    assert heard(spark, np.zeros(3 * RATE)) == [(0.0, 3.0)]
    long = heard(spark, np.zeros(20 * RATE))
    assert long[0][0] == 0 and long[-1][1] == pytest.approx(20) and min(b - a for a, b in long) > 4
    short, = heard(spark, tone(0.3))
    assert short == (0.0, pytest.approx(0.3))
    click = np.concatenate([noise(2), tone(3) + noise(3), noise(3)])
    click[int(6.5 * RATE) : int(6.55 * RATE)] += 0.5
    assert len(heard(spark, click)) == 1
    two = np.concatenate([noise(1), tone(6) + noise(6), noise(0.15), tone(2) + noise(2), noise(0.15), tone(4) + noise(4), noise(1)])
    _, (cut, _) = heard(spark, two)
    assert 7.0 <= cut <= 7.2 or 9.15 <= cut <= 9.35  # in one of the two pauses


def test_visual_segments(spark):
    r = np.random.default_rng(1)
    t = np.arange(300) / 30
    x = 0.02 + 0.002 * r.standard_normal(300)
    said = (t >= 3) & (t < 7)
    x[said] = 0.12 + 0.1 * np.sin(2 * np.pi * 4 * t[said])
    lost = (np.arange(300) >= 140) & (np.arange(300) < 160)
    rows = [(name, k, float(v), bool(ok)) for name, xs, oks in (("all", x, t >= 0), ("gap", np.where(lost, 0, x), ~lost), ("flat", np.full(90, 0.05), np.ones(90)), ("none", np.zeros(90), np.zeros(90))) for k, (v, ok) in enumerate(zip(xs, oks))]
    got = {}
    for s in G.visual_segments(spark.createDataFrame(rows, "u string, k int, x double, valid boolean"), "u").orderBy("u", "n").collect():
        got.setdefault(s.u, []).append((s.start, s.end))
    (a, b), = got["all"]
    assert 2.3 <= a <= 3.0 and 7.2 <= b <= 8.0
    assert len(got["gap"]) == 1 and got["flat"] == got["none"] == [(0.0, 3.0)]


def test_percentiles_by_range_sort(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(v)) for g in "abc" for v in r.normal(size=int(r.integers(1, 60)))] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: (x.p, x.q, x.n) for x in O.grouped_percentiles(df, ["g"], "x", {"p": 0.1, "q": 1.0}).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (pytest.approx(np.percentile(own, 10)), max(own), len(own))
    assert "d" not in got


def test_best_paths():
    r = np.random.default_rng(6)
    from itertools import product

    def collapse(p):
        return [x for i, x in enumerate(p) if x and (i == 0 or p[i - 1] != x)]

    targets = [[1, 2], [1, 1], [2], []]
    logp = [np.log(r.dirichlet(np.ones(3), n)) for n in (5, 5, 3, 4)]
    for t, x, (token, lp, total) in zip(targets, logp, G.best_paths(logp, [np.array(t, dtype=int) for t in targets])):
        best = max(sum(x[k, c] for k, c in enumerate(p)) for p in product(range(3), repeat=len(x)) if collapse(p) == t)
        assert total == pytest.approx(best) == pytest.approx(lp.sum())
        assert sorted(set(token.tolist()) - {-1}) == list(range(len(t)))
    assert G.best_paths([np.zeros((2, 3))], [np.array([1, 1])])[0][2] == -math.inf


def test_long_paths_equal_the_full_table():
    """Utterances of hundreds of frames, of different lengths, against a table of all scores."""
    r = np.random.default_rng(8)
    targets = [r.integers(1, 6, n) for n in (0, 1, 40, 90, 91)]
    logp = [np.log(r.dirichlet(np.ones(6), n)) for n in (7, 300, 257, 400, 91)]
    for t, x, (token, lp, total) in zip(targets, logp, G.best_paths(logp, targets)):
        label = [0]
        for c in t.tolist():
            label += [c, 0]
        score = {0: x[0][label[0]]} | ({1: x[0][label[1]]} if len(t) else {})
        for row in x[1:]:
            score = {s: max([score[q] for q in (s, s - 1) if q in score] + [score[s - 2] for _ in [0] if s - 2 in score and s % 2 and label[s] != label[s - 2]]) + row[label[s]] for s in range(len(label)) if any(q in score for q in (s, s - 1)) or (s - 2 in score and s % 2 and label[s] != label[s - 2])}
        want = max([score[s] for s in (len(label) - 1, len(label) - 2) if s in score], default=-math.inf)
        if want == -math.inf:
            assert total == want and np.isnan(lp).all()
            continue
        assert total == pytest.approx(want) == pytest.approx(lp.sum())
        heard = token[token >= 0]
        assert heard[np.flatnonzero(np.diff(heard, prepend=-1))].tolist() == list(range(len(t))) and (np.diff(heard) >= 0).all()


def test_lag_profile_and_reports(spark):
    r = np.random.default_rng(9)

    def expected(v, a, reach):
        v, a = np.array(v), np.maximum(np.array(a), np.percentile(a, 20))
        smooth = lambda x: [(sum(x[max(0, i - 1) : i + 2])) / 3 for i in range(len(x))]
        steps = []
        for x in (v, a):
            s = smooth(x.tolist())
            d = np.array([s[0] - x[0], *(q - p for p, q in zip(s, s[1:]))])
            steps.append((d - d.mean()) / (d.std() + 1e-6))
        v, a = steps
        n = len(v)
        return [sum(a[k + j] * v[k] for k in range(n) if 0 <= k + j < n) for j in range(-reach, reach + 1)]

    rows = []
    for k in range(12):
        n = int(r.integers(20, 70))
        a = r.normal(size=n + 6)
        rows.append((k % 3, k % 2, a[3 : n + 3].tolist(), a[3 - k % 3 : n + 3 - k % 3].tolist(), 1.0))
    odd = [(7, 1, None, [1.0], 1.0), (7, 1, [1.0] * 30, [1.0] * 29, 1.0), (7, 1, [1.0, None] * 20, [1.0] * 40, 1.0), (7, 1, [1.0] * 8, [1.0] * 8, 1.0), (0, 0, [0.0] * 30, [0.0] * 30, 0.1)]
    df = spark.createDataFrame(rows + odd, "video int, speaker int, v array<double>, a array<double>, valid_ratio double")
    got = df.select("v", "a", A.lag_profile(F.col("v"), F.col("a"), 4).alias("p")).collect()
    for g, (_, _, v, a, _) in zip(got, rows):
        assert [x.s for x in g.p] == pytest.approx(expected(v, a, 4), abs=1e-9) and [x.lag for x in g.p] == list(range(-4, 5)) and [x.n for x in g.p] == [len(v) - abs(j) for j in range(-4, 5)]
    assert [g.p for g in got[12:16]] == [None] * 4
    videos = A.lag_by_video(df, ["video"], 4)
    assert {r.video: r.lag for r in videos.collect()} == {0: 0, 1: 1, 2: 2} and all(r.sharpness > 0.3 and r.n_utts == 4 for r in videos.collect())
    one = A.lag_by_speaker(videos.withColumn("speaker", F.lit("s")), ["speaker"]).first()
    assert (one.n, one.median_lag, one.least_lag, one.most_lag) == (3, 1.0, 0, 2)


def test_values_at_shifts(spark):
    r = np.random.default_rng(10)
    series = {u: {k: None if r.random() < 0.2 else float(r.integers(0, 50)) for k in range(40) if r.random() < 0.9} for u in range(3)}
    frames = spark.createDataFrame([(u, k, z) for u, s in series.items() for k, z in s.items()], "u int, k int, z double")
    events = [(u, 100 * u + e, int(r.integers(-5, 45)), *sorted(r.integers(-5, 20, 2).tolist())) for u in range(4) for e in range(25)]
    got = A.values_at_shifts(spark.createDataFrame(events, "u int, event int, k0 int, first int, last int"), frames, "u", [-6, 0, 3], longest=26).collect()
    want = {}
    for u, e, k0, a, z in events:
        s = series.get(u, {})
        for shift in (-6, 0, 3):
            inside = [s[k] for k in range(a + shift, max(a, z) + shift + 1) if s.get(k) is not None]
            want[u, e, shift] = (s.get(k0 + shift), min(inside, default=None))
    assert {(r.u, r.event, r["shift"]): (r.at, r.low) for r in got} == want


def test_syllable_records(spark):
    # three syllables, a space after the second: tokens 0-1, 2-4, space 5, 6-7
    first = [0, 2, 10, 11, 12, 20, 50, 52]
    tokens = [(10 + k, a, a, -0.1 * k) for k, a in enumerate(first)]
    groups = [("A", "syl", 0, 2), ("B", "syl", 2, 5), (" ", "space", 5, 6), ("C", "syl", 6, 8)]
    df = spark.createDataFrame([("u", 80, groups, tokens)], "utt_id string, n_frames int, groups array<struct<char:string,kind:string,first:int,last:int>>, tokens array<struct<id:int,first:int,last:int,logprob:double>>")
    a, b, c = G.syllable_records(df, 50.0).orderBy("pos").collect()
    assert (a.char, a.word, a.start_s, a.end_s, a.ext_end_s, a.ext_capped) == ("A", 0, 0.0, 0.06, 0.2, False)
    assert (b.word, b.start_s, b.end_s, b.ext_end_s, b.ext_capped, b.logprob) == (0, 0.2, 0.26, 0.66, True, -0.3)
    assert (c.word, c.end_s, c.ext_end_s, c.ext_capped) == (1, 1.06, 1.46, True)
    assert [t.ext_end_s for t in b.tokens] == [0.22, 0.24, 0.66]
    b = G.syllable_records(df, 50.0, stop_at_any=True).orderBy("pos").collect()[1]
    assert (b.ext_end_s, b.ext_capped) == (0.4, False)


def test_forced_alignment_job(spark):
    logp = np.log(np.full((6, 3), 0.1))
    for t, x in enumerate([0, 1, 1, 0, 2, 2]):
        logp[t, x] = np.log(0.8)
    rows = [("a", 6, 3, [float(x) for x in logp.ravel()], [1, 2]), ("b", 1, 3, [0.0, 0.0, 0.0], [1, 2])]
    got = {r.utt_id: r for r in G.align_posteriors(spark.createDataFrame(rows, "utt_id string, n_frames int, vocab int, logp array<double>, targets array<int>")).collect()}
    assert [(t.id, t.first, t["last"]) for t in got["a"].tokens] == [(1, 1, 2), (2, 4, 5)] and got["a"].ok
    assert not got["b"].ok and got["b"].tokens == []


def test_signals():
    r = np.random.default_rng(3)
    t = np.arange(16000) / 16000
    wave = 0.3 * np.sin(2 * np.pi * 220 * t)
    for kind in ("white", "pink", "babble"):
        noise = S.make_noise(kind, 16000, r, [r.normal(size=3000), r.normal(size=5000)])
        assert S.rms(noise) == pytest.approx(1, abs=1e-6)
        for snr in (-5, 0, 10):
            mixed = S.mix_at_snr(wave, noise, snr)
            assert 20 * np.log10(S.rms(wave) / S.rms(mixed - wave)) == pytest.approx(snr, abs=0.01)
    with pytest.raises(ValueError):
        S.make_noise("babble", 100, r, [np.zeros(50)])
    power = np.abs(np.fft.rfft(S.make_noise("pink", 1 << 16, r))) ** 2
    f = np.arange(1, len(power))
    bands = [(power[1:][(f >= a) & (f < 2 * a)].mean(), a) for a in (64, 256, 1024, 4096)]
    slope = np.polyfit(np.log([b for _, b in bands]), np.log([p for p, _ in bands]), 1)[0]
    assert slope == pytest.approx(-1, abs=0.15)
    assert S.snr_estimate(np.zeros(0)) == -10
    assert S.snr_estimate(np.concatenate([r.normal(size=8000) * 0.001, r.normal(size=8000)])) > 30
    a, b = S.mix_leakage([wave, np.roll(wave, 50)], 10)
    assert 20 * np.log10(S.rms(wave) / S.rms(a - wave)) == pytest.approx(10)
    mel = S.log_mel(r.normal(size=16000) * 0.1)
    assert mel.shape == (98, 80) and np.allclose(mel.mean(axis=0), 0, atol=1e-6) and np.allclose(mel.std(axis=0), 1, atol=1e-2)
    assert S.stacked(mel).shape == (24, 320)
    noisy = r.normal(size=16000) * 0.1
    whole = S.log_mel(noisy, normalised=False)
    for start, frames in ((0, 5), (3, 10), (20, 4)):
        own = whole[4 * start : 4 * (start + frames)]
        want = S.stacked((own - own.mean(axis=0)) / np.sqrt(own.var(axis=0) + 1e-5))
        assert np.allclose(S.window_features(noisy, start, frames), want, atol=1e-6)
    assert S.window_features(noisy, -3, 6).shape == S.window_features(noisy, 23, 6).shape == S.window_features(np.zeros(0), 0, 6).shape == (6, 320)


def test_mel_values_by_the_direct_transform():
    """One frame by definition: sums of cosines and sines, and triangles over mel frequencies."""
    r = np.random.default_rng(1)
    x = r.normal(size=400) * 0.2
    frame = x * 32768.0 - (x * 32768.0).mean()
    frame = np.array([frame[k] - 0.97 * frame[max(k - 1, 0)] for k in range(400)])
    frame *= np.array([(0.5 - 0.5 * math.cos(2 * math.pi * k / 399)) ** 0.85 for k in range(400)])
    power = [sum(v * math.cos(2 * math.pi * f * k / 512) for k, v in enumerate(frame)) ** 2 + sum(v * math.sin(2 * math.pi * f * k / 512) for k, v in enumerate(frame)) ** 2 for f in range(257)]
    mel = lambda f: 1127 * math.log(1 + f / 700)
    points = [mel(20) + (mel(8000) - mel(20)) * k / 81 for k in range(82)]
    want = []
    for a, b, c in zip(points, points[1:], points[2:]):
        weight = [max(0.0, min((mel(f * 16000 / 512) - a) / (b - a), (c - mel(f * 16000 / 512)) / (c - b))) for f in range(257)]
        want.append(math.log(max(sum(w * p for w, p in zip(weight, power)), np.finfo(np.float32).eps)))
    assert np.allclose(S.log_mel(x, normalised=False)[0], want, atol=1e-6)


def test_scorer_is_loaded_once_a_worker_and_fills_its_batches(spark):
    def load():
        import os
        import uuid

        loaded = f"{os.getpid()} {uuid.uuid4().hex}"
        return lambda part: pd.DataFrame({"size": [len(part)] * len(part), "loaded": loaded, "twice": part["id"] * 2})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = X.score_batches(spark.range(0, 1000, 1, 20), load, "size int, loaded string, twice long", ["id"], batch=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.id for r in rows) == list(range(1000)) and all(r.twice == 2 * r.id for r in rows)
    assert {r.size for r in rows} == {16, 50 % 16}
    processes = {r.loaded.split()[0] for r in rows}
    assert len({r.loaded for r in rows}) == len(processes) < 20


def test_regions_of_videos(spark):
    rows = [("a", 100.0, 50.0, 300.0, 250.0), ("a", 110.0, 60.0, 330.0, 260.0), ("a", 5.0, 5.0, 5.0, 9.0), ("b", 9.0, 9.0, 8.0, 8.0)]
    got = {r.v: tuple(r)[1:] for r in S.decode_regions(spark.createDataFrame(rows, "v string, x0 double, y0 double, x1 double, y1 double"), "v", F.lit(1920), F.lit(1080), side=105.0).collect()}
    assert got["a"] == (72, 24, 358, 286, 144, 132)  # 230 x 210 and 12 %, a median face of 210 halved
    assert got["b"] == (0, 0, 1920, 1080, 480, 270)


def test_lips_do_not_change_when_the_head_turns():
    p = np.random.default_rng(0).random((478, 2)) * 10
    p[33], p[263] = (100, 100), (200, 100)
    p[61], p[291], p[13], p[14] = (120, 200), (180, 200), (150, 194), (150, 206)
    lips = S.lip_skeleton(p)
    assert lips.shape == (40, 2) and np.allclose(lips.mean(axis=0), 0) and np.allclose(lips[0], (p[61] - p[list(S.OUTER + S.INNER)].mean(axis=0)) / 100)
    turn = np.array([[math.cos(1.1), math.sin(1.1)], [-math.sin(1.1), math.cos(1.1)]])
    assert np.allclose(S.lip_skeleton(p @ turn * 0.3 - 7), lips)
    g = S.lip_geometry(p)
    assert g[0] == pytest.approx(0.6) and g[1] == pytest.approx(0.12)
    c, s = math.cos(0.4), math.sin(0.4)
    assert np.allclose(S.lip_geometry(p @ np.array([[c, s], [-s, c]]) * 1.7 + 5), g)


def test_best_shift_is_refined(spark):
    d = [0.0, 0.2, 0.8, 1.0, 0.9, 0.3, 0.0]
    curve = spark.createDataFrame([("x", (k - 3) * 20, v) for k, v in enumerate(d)], "c string, shift int, d double")
    got = A.best_shift(curve, ["c"]).first()
    assert got.best_shift == pytest.approx(0.5 * (0.8 - 0.9) / (0.8 - 2 + 0.9) * 20)
    assert got.left_ms == pytest.approx(-40 + 20 * (0.5 - 0.2) / 0.6) and got.right_ms == pytest.approx(20 + 20 * (0.9 - 0.5) / 0.6)


def test_bootstrap_brackets_the_truth(spark):
    r = np.random.default_rng(0)
    rows = [("c", u, s, bool(k % 2), float(r.normal() + (k % 2) * (2 - abs(s) / 20))) for u in range(30) for k in range(6) for s in (-40, -20, 0, 20, 40)]
    got = A.bootstrap_shift(spark.createDataFrame(rows, "c string, utt int, shift int, positive boolean, x double"), ["c"], replicas=100).first()
    assert got.shift_low <= 0 <= got.shift_high and got.d_low < 2 < got.d_high


def test_windows_shifts_and_bands(spark):
    df = spark.range(300).select("id", (F.col("id") % 60).alias("n"))
    rows = df.select("n", S.window_start(F.col("n"), 20, F.col("id")).alias("start"), "id").select("*", S.signed_shift(F.col("start"), F.col("n"), 20, 3, 5, F.col("id")).alias("shift"), S.mask_bands(F.col("n"), 2, 7, F.col("id")).alias("bands")).collect()
    for r in rows:
        assert (r.start is None) == (r.n < 20)
        assert all(b.start is None and r.n < b.length or 0 <= b.start and b.start + b.length <= r.n and b.length <= 7 for b in r.bands)
        if r.start is None:
            assert r["shift"] == 0
        else:
            fits = [s for m in (3, 4, 5) for s in (-m, m) if 0 <= r.start + s <= r.n - 20]
            assert r["shift"] in (fits or [0])
    assert {r["shift"] for r in rows} == {-5, -4, -3, 0, 3, 4, 5}


def test_leakage_and_leaking_clips(spark):
    r = np.random.default_rng(8)
    streams = [[r.normal(size=400).tolist(), r.normal(size=300).tolist(), r.normal(size=350).tolist()]]
    got = spark.createDataFrame([(streams[0], 6.0)], "s array<array<double>>, level double").select(S.leakage_column("s", "level")).first()[0]
    own = np.array(streams[0][0])
    assert [len(g) for g in got] == [400] * 3
    assert 20 * np.log10(S.rms(own) / S.rms(np.array(got[0]) - own)) == pytest.approx(6, abs=1e-3)
    rows = [(i, f"k{i // 2}", f"t{i % 5}", f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, key string, text string, speaker string").withColumn("want", (F.col("id") % 3 + 2).cast("int"))
    of = {x[0]: x for x in rows}
    clips = P.noise_clips(df, F.col("want"), 1, pool_size=20).collect()
    for i in of:
        mine = [c for c in clips if c.id == i]
        assert len(mine) == i % 3 + 2 and all(of[c.clip][1] != of[i][1] and of[c.clip][2] != of[i][2] for c in mine)
    leaks = P.noise_clips(df, 1, 1, pool_size=20, others_only=True).collect()
    assert len(leaks) == 40 and all(of[c.clip][3] != of[c.id][3] for c in leaks)
    assert P.noise_clips(df.limit(0), 2, 1).collect() == []


def test_negatives_fall_back_to_sessions(spark):
    two = spark.createDataFrame([("a", 1), ("b", 1)], "speaker string, session int")
    assert P.negative_columns(two) == "speaker" and P.negative_columns(two.filter("speaker = 'a'")) == "session"


def test_batches_of_pairs_are_compared_and_aligned_together():
    import random

    import pyarrow as pa

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc가") for _ in range(r.randrange(n)))
    texts = [(a, word(150) if r.random() < 0.3 else a.replace("ab", "b").replace("c", "cc")) for a in (word(150) for _ in range(150))] + [("", "ab"), ("ab", ""), (None, "a"), ("x" * 2500, "x" * 2400 + "y")]
    got = X.char_edits.func(*(pa.array(c) for c in zip(*texts))).to_pylist()
    assert got == [None if a is None or b is None else X.char_distance(a, b) for a, b in texts]
    pairs = [tuple(np.array([ord(c) for c in t], dtype=np.int64) for t in p) for p in texts[:150]]
    for (a, b), steps in zip(pairs, X._all_ways([p[0] for p in pairs], [p[1] for p in pairs])):
        i, j, cost = 0, 0, 0
        for s in steps:
            cost += s != X.BOTH or a[i] != b[j]
            i, j = i + (s != X.HYP), j + (s != X.REF)
        assert (i, j, cost) == (len(a), len(b), X.char_distance("".join(map(chr, a)), "".join(map(chr, b))))


def test_lip_events_and_label_shifts_broadcast_nothing(spark):
    from visemill.operators import alignment as A
    from visemill.operators import segments as G

    events = spark.createDataFrame([(1, 7, 62), (1, 8, 0)], "u long, event long, k0 long")
    frames = spark.createDataFrame([(1, k, float((k * 7) % 11)) for k in range(55, 70)], "u long, k long, z double")
    out = A.lip_events(events, frames, "u", 4, 2, 3)
    v = {k - 62: float((k * 7) % 11) for k in range(55, 70)}
    low = min(range(-4, 3), key=lambda o: (v[o], o))
    rise = min(range(low + 1, low + 4), key=lambda o: (v[o - 1] - v[o], o)) - 0.5
    assert [tuple(r) for r in out.collect()] == [(1, 7, low, low in (-4, 2), rise)]
    sentences = spark.createDataFrame([(1, 1.0, 2.0)], "video_stem long, start_s double, end_s double")
    shift = G.label_shift(sentences, frames.selectExpr("u AS video_stem", "k", "z AS db"))
    assert all("Broadcast" not in df._jdf.queryExecution().toString() for df in (out, shift))


def test_syllables_of_a_text_are_found_without_a_shuffle(spark):
    rows = spark.sql("SELECT 'u' AS utt_id, 70 AS n_frames, array(named_struct('char', '가', 'kind', 'syl', 'first', 0, 'last', 2), named_struct('char', ' ', 'kind', 'space', 'first', 2, 'last', 3), named_struct('char', '나', 'kind', 'syl', 'first', 3, 'last', 5)) AS groups, transform(sequence(0, 4), i -> struct(i AS id, i * 10 AS first, i * 10 + 4 AS last, -0.1D AS logprob)) AS tokens")
    out = G.syllable_records(rows, 50.0)
    assert [(r.pos, r.char, r.word, r.start_s, r.end_s, r.ext_end_s, r.ext_capped) for r in out.collect()] == [(0, "가", 0, 0.0, 0.3, 0.6, False), (2, "나", 1, 0.6, 0.9, 1.3, True)]
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_syllables_of_many_texts_at_once(spark):
    """Texts of a batch together; text functions are worked out once for each text."""
    from visemill.operators import segments as G
    from visemill.plans.score_queries import records

    group = lambda kinds: [("c%d" % k, x, 2 * k, 2 * k + 2) for k, x in enumerate(kinds)]
    token = lambda n, d: [(k, d + 7 * k, d + 7 * k + 2, -0.0125 * k) for k in range(n)]
    rows = [("a", 90, group(["syl", "syl", "space", "syl"]), token(8, 1)), ("b", 40, group(["punct"]), token(2, 0)), ("c", 60, None, None), ("d", 70, group(["space", "syl", "punct"]), token(6, 3))]
    schema = "utt_id string, n_frames int, groups array<struct<char:string,kind:string,first:int,last:int>>, tokens array<struct<id:int,first:int,last:int,logprob:double>>"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    for any_ in (False, True):
        got = {r.utt_id: r.syllables for r in G.syllable_arrays(df, 50.0, stop_at_any=any_).collect()}
        assert got["b"] == [] and got["c"] is None and [(s.pos, s.word) for s in got["a"]] == [(0, 0), (1, 0), (3, 1)] and [(s.pos, s.word) for s in got["d"]] == [(1, 1)]
        assert [s.start_s for s in got["a"]] == [0.02, 0.3, 0.86] and [s.ext_end_s for s in got["a"]] == [0.3, 0.58 if any_ else 0.86, 1.46] and [s.logprob for s in got["a"]] == [-0.007, -0.032, -0.082]
        assert [s.ext_end_s for s in got["d"]] == [0.62 if any_ else 0.94] and [t.ext_end_s for t in got["d"][0].tokens] == [0.48, 0.62 if any_ else 0.94]
    with pytest.raises(Exception, match="without tokens"):
        G.syllable_arrays(spark.createDataFrame([("u", 9, group(["syl"]), [])], schema), 50.0).collect()
    plan = records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text_groups(") == plan.count("nfc(") == 1


def test_texts_are_aligned_from_ids_worked_out_once(spark):
    from visemill.plans.score_queries import edit_alignment

    plan = edit_alignment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jamo_ids(") == plan.count("nfc(") == 1


def test_label_shift_takes_sums_for_equal_that_differ_in_the_last_digit(spark):
    levels = spark.createDataFrame([(1, k, 0.1 * (k % 7)) for k in range(2000)], "video_stem long, k long, db double")
    sentences = spark.createDataFrame([(1, 3.0 + 0.7 * n, 3.35 + 0.7 * n) for n in range(20)], "video_stem long, start_s double, end_s double")
    # levels come again every 7 frames and a step is two, so shifts that are seven steps apart score alike: the earliest counts
    row, = G.label_shift(sentences, levels, gain=0.0).collect()
    assert -0.8 <= row["shift"] < -0.8 + 7 * 0.02 - 1e-9
