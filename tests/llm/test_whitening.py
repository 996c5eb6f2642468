import numpy as np
import pytest

from visemill.llm.queries import op13_whitening
from visemill.llm.whitening import bidiagonalise, blocks_of, deviations, fit_whitening, whiten

FLAWED = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]


def expected(x, k):
    """Exact deviations, whitened columns up to their sign, shares of the trace; plain arrays."""
    n, dims = x.shape
    s = x.astype(object).sum(axis=0)
    gap = n * x.astype(object) - s
    c = (gap / n).astype(np.float64)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [int(d) for d in (gap * gap).sum(axis=1)], c @ vectors / np.sqrt(values), values / (c * c).sum() * n


def agree(rows, ids, x, k, places=1e-8):
    deviation, white, explained = expected(x, k)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(ids) * k
    got = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * sign).max() < places
    assert [by[i][1].deviation for i in ids] == deviation
    assert np.allclose([by[ids[0]][c].explained for c in range(1, k + 1)], explained, rtol=1e-10)
    assert {(r.n, r.identity_error) for r in rows} == {(len(ids), rows[0].identity_error)} and rows[0].identity_error < 1e-9


def test_query_on_real_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    agree(op13_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], x, 32)


@pytest.fixture(scope="module")
def small():
    r = np.random.default_rng(3)
    return (r.normal(size=(300, 4)) * [3, 1, 0.5, 0.1] + [5, 0, -7, 1]).astype(np.float32)


def test_flawed_rows(spark, small):
    rows = [(i, [float(v) for v in x], "c") for i, x in enumerate(small)] + [(*r, "c") for r in FLAWED]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    x = np.floor(64 * small.astype(np.float64)).astype(np.int64) + 1_000_000
    agree(whiten(df).collect(), list(range(len(x))), x, 4)
    assert {r.component for r in whiten(df, components=2).collect()} == {1, 2}
    assert whiten(df.limit(0)).collect() == []
    assert whiten(spark.createDataFrame(FLAWED[:2], "vec_id long, embedding array<double>")).collect() == []


def test_repeats_null_ids_and_no_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])] * 5, "vec_id long, embedding array<double>")
    assert whiten(one).collect() == []  # nothing varies
    rows = [(1, [1.0, 2.0, 0.0])] * 2 + [(None, [2.0, 4.0, 0.0]), (2, [-1.0, -2.0, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "2", "None"]  # on a line: one component
    assert all(r.component == 1 and abs(r.explained - 1) < 1e-12 and r.n == 4 for r in got)
    assert abs(sum(r.whitened for r in got)) < 1e-9 and abs(sum(r.whitened**2 for r in got) - 4) < 1e-9


def test_equal_eigenvalues(spark):
    """Opposite unit vectors: every direction is as good, so a Krylov space is used up at once."""
    rows = [(2 * k + s, [(1.0 - 2 * s) * (3 if k < 2 else 1) * (i == k) for i in range(6)]) for k in range(6) for s in range(2)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 * 6 and max(r.identity_error for r in got) < 1e-9
    shares = sorted({r.component: r.explained for r in got}.items())
    assert np.allclose([e for _, e in shares], np.array([9, 9, 1, 1, 1, 1]) / 22, rtol=1e-10)


def test_orthogonal_vectors_and_steep_values(spark):
    r = np.random.default_rng(5)
    values = 2.0 ** -np.arange(20)
    x = r.normal(size=(500, 20)) * values @ np.linalg.qr(r.normal(size=(20, 20)))[0] * 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    blocks, n, dims, sums = blocks_of(df, 64, 0)
    whole = np.floor(64 * x).astype(np.int64)
    assert sums == whole.sum(axis=0).tolist()
    vectors, got = bidiagonalise(blocks, n, dims, sums, 8, 1)
    want = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)
    assert np.allclose(got[:8], want[:8], rtol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    model = fit_whitening(blocks, n, dims, sums, 8)
    assert np.allclose(model.eigenvalues * n, want[:8] ** 2, rtol=1e-10)


def test_more_tasks_than_are_added_at_once(spark, small, monkeypatch):
    import visemill.llm.whitening as m

    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(small)], "vec_id long, embedding array<float>").repartition(9)
    monkeypatch.setattr(m, "TASK_BYTES", 60)
    monkeypatch.setattr(m, "DIRECT", 2)
    monkeypatch.setattr(m, "BLOCK_ROWS", 7)
    x = np.floor(64 * small.astype(np.float64)).astype(np.int64) + 1_000_000
    agree(m.whiten(df).collect(), list(range(len(x))), x, 4)


def test_large_numbers(spark):
    x = np.array([[1 << 40, -(1 << 40)], [3, 5], [-(1 << 33), 1]])
    sums = x.sum(axis=0).tolist()
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want]
    rows = [(1, [1e30, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) in (3, 6) and all(np.isfinite(r.whitened) for r in got)
