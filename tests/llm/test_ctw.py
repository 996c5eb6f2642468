import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from visemill.llm.ctw import log_kt, score_documents
from visemill.llm.queries import op2_context_tree


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_scores(rows):
    count = Counter()
    for doc, text in rows:
        if not held(doc):
            count.update([*words_of(text), None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        tokens = [*words_of(text), None]
        out.append((doc, held(doc), len(tokens), sum(count[t] > 0 for t in tokens), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out


class Tree:
    """A context tree weighted recursively, a dictionary a node: the plain definition."""

    def __init__(self, depth):
        self.depth, self.count = depth, {}

    def paths(self, data):
        line = b"\xff" * self.depth + data + b"\xff"
        for i in range(self.depth, len(line)):
            for j in range(8):
                node, bit = (1 << j) | (line[i] >> (8 - j)), line[i] >> (7 - j) & 1
                yield [(node, line[i - d : i]) for d in range(self.depth + 1)], bit

    def learn(self, data):
        for path, bit in self.paths(data):
            for key in path:
                self.count.setdefault(key, [0, 0])[bit] += 1

    def weigh(self):
        self.weighted, below = {}, {}
        for key in sorted(self.count, key=lambda k: -len(k[1])):
            own = float(log_kt(*(np.array([x]) for x in self.count[key]))[0])
            deep = len(key[1]) == self.depth
            w = own if deep else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below[key])
            self.weighted[key] = (own, w, deep)
            if key[1]:
                up = (key[0], key[1][1:])
                below[up] = below.get(up, 0.0) + w

    def score(self, data):
        total = 0.0
        for path, bit in self.paths(data):
            p = None
            for key in reversed(path):
                if key in self.count:
                    a = self.count[key]
                    own, w, deep = self.weighted[key]
                    kt = (a[bit] + 0.5) / (sum(a) + 1)
                    share = 1.0 if deep else math.exp(math.log(0.5) + own - w)
                    p = kt if p is None else share * kt + (1 - share) * p
            total += math.log10(0.5 if p is None else p)
        return total


def check(rows, got, depth):
    tree = Tree(depth)
    for doc, text in rows:
        if not held(doc):
            tree.learn(" ".join(words_of(text)).encode())
    tree.weigh()
    want = sorted([(*r, tree.score(" ".join(words_of(text)).encode())) for r, (_, text) in zip(base_scores(rows), rows)], key=str)
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()], key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-5)


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_against_the_plain_definition(spark, odd_docs, depth):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(k, f"number {k} writes some words and {k % 3} more") for k in range(20, 40)]
    rows = [(d, t and t[:3000]) for d, t in rows]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    check(rows, score_documents(df, depth), depth)
    assert score_documents(df.limit(0), depth).collect() == []


def test_query_on_real_rows(spark, sf_dir):
    got = op2_context_tree(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {r[0]: r for r in base_scores(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:5]
        assert r.base_score == pytest.approx(want[r.doc_id][5])
        assert r.score < 0


def test_predictions_of_a_context_sum_to_one(spark):
    texts = ["abab", "abba", "cab"]
    ends = [f"ab{c}" for c in "abcdefgh"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree = Tree(3)
    for doc, t in rows:
        if not held(doc):
            tree.learn(t.encode())
    tree.weigh()
    total = 0.0
    for byte in range(256):
        p = 0.0
        for path, bit in list(tree.paths(b"ab" + bytes([byte])))[16:24]:
            q = None
            for key in reversed(path):
                if key in tree.count:
                    a = tree.count[key]
                    own, w, deep = tree.weighted[key]
                    share = 1.0 if deep else math.exp(math.log(0.5) + own - w)
                    kt = (a[bit] + 0.5) / (sum(a) + 1)
                    q = kt if q is None else share * kt + (1 - share) * q
            p += math.log(0.5 if q is None else q)
        total += math.exp(p)
    assert total == pytest.approx(1.0)
    assert len(ends) == 8 and score_documents(df, 3).count() == 3


def test_grams_packed_by_group():
    import visemill.llm.ctw as m

    rng = np.random.default_rng(0)
    gram = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)]))
    group, value = rng.integers(0, 7, len(gram)), rng.random((len(gram), 8)).astype("<f4")
    rows = m._packed("part", gram, group, value, "p").to_pylist()
    assert [r["part"] for r in rows] == sorted(set(group.tolist()))
    for r in rows:
        assert (m._unpack_grams(r["grams"]) == gram[group == r["part"]]).all()
        assert (np.frombuffer(m.unpack_bytes(r["p"]), "<f4").reshape(8, -1).T == value[group == r["part"]]).all()
    assert (m._from_planes(m._planes(value[:, 0].copy()), "<f4") == value[:, 0]).all() and len(m._unpack_grams(b"")) == 0
    found = [(gram[a : a + 3], value[a : a + 3]) for a in range(0, 30, 3)]
    assert (np.concatenate([k for k, _ in m._few(found, 7)]) == gram[:30]).all()


def test_closed_forms_of_counts():
    a, b = np.array([0, 1, 5, 5000, 100_000]), np.array([0, 0, 3, 7, 90_000])
    want = [math.lgamma(p + 0.5) + math.lgamma(q + 0.5) - math.log(math.pi) - math.lgamma(p + q + 1) for p, q in zip(a, b)]
    assert np.allclose(log_kt(a, b), want, rtol=1e-9)


@pytest.mark.parametrize("at_once", [7, 1000])
def test_grams_in_blocks_give_the_same_scores(spark, odd_docs, at_once, monkeypatch):
    import visemill.llm.ctw as m

    texts = [b"ab", b"", b"abcab" * 50, b"\xc3\xa9"]
    text, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole, before = m.grams_of(text, off, 5)
    whole = np.concatenate(list(whole))
    want = []
    for t in texts:
        line = b"\xff" * 5 + t + b"\xff"
        want += [int.from_bytes(bytes([0, 0, *line[i - 1 : i - 6 if i > 5 else None : -1], line[i]]), "big") for i in range(5, len(line))]
    assert whole.tolist() == want and before.tolist() == [0, 3, 4, 255, 258]
    monkeypatch.setattr(m, "GRAMS_AT_ONCE", at_once)
    assert np.concatenate(list(m.grams_of(text, off, 5)[0])).tolist() == want


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_texts_are_cheaper_than_by_the_base(spark, size):
    """Whole texts of the table that no count has seen take fewer bits than by counts of words."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    rows = score_documents(docs).filter("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base", "count(*) AS n").first()
    assert rows.n > 150 and rows.score > rows.base
