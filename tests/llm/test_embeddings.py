import math

import numpy as np

from visemill.llm.embeddings import near_vectors, plan_tables
from visemill.llm.queries import op7_sign_hashing


def expected(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept), brute force."""
    unit = []
    for _, vec, label in rows:
        ok = vec is not None and label is not None and len(vec) and all(x is not None and math.isfinite(x) for x in vec) and any(vec)
        unit.append(np.array(vec, dtype=np.float64) / np.linalg.norm(np.array(vec, dtype=np.float64)) if ok else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows)], key=str)


def test_query_on_real_rows(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = expected(rows)
    assert sorted(map(tuple, op7_sign_hashing(spark, sf_dir).collect()), key=str) == want


def clusters(seed, n=300):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=16) * r.choice([0, 0.02, 0.1, 0.25])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(r.integers(2))))
    return rows


def test_odd_rows_and_crowded_buckets(spark, monkeypatch):
    import visemill.llm.embeddings as m

    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1), (905, [], 1), (906, [1.0] * 16, None), (None, [1.0] * 16, 0), (907, [1.0] * 16, 0), (907, [1.0] * 16, 0), (908, [2.0] * 16, 0), (909, [1.0, 1.0], 0), (None, None, None)]
    rows = clusters(1) + odd
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    want = expected(rows)
    got = sorted(map(tuple, near_vectors(df).collect()), key=str)
    differ = sum(a != b for a, b in zip(got, want))
    assert len(got) == len(want) and differ <= 2
    monkeypatch.setattr(m, "BLOCK", 16)
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == got
    assert near_vectors(df.limit(0)).collect() == []


def test_recall_of_links(spark):
    rows = clusters(2, 600)
    got = sum(r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    want = sum(r[1] for r in expected(rows))
    assert 0.99 * want <= got <= want


def test_planned_recall():
    for n in (10, 10_000, 10_000_000):
        bits, tables = plan_tables(n, 0.98)
        p = 1 - math.acos(0.98) / math.pi
        assert (1 - p**bits) ** tables <= 1e-4
