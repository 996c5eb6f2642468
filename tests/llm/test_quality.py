import math
import re
import zlib
from collections import Counter

import numpy as np

from visemill.llm.bytetext import Slice
from visemill.llm.quality import CLASSES, FEATURES, classify, statistics, train
from visemill.llm.queries import op10_quality_trees


def test_held_out_accuracy_on_real_rows(spark):
    at = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10_quality_trees(spark, at).collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    marks = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{at}/labels.parquet").collect()]
    held = [(r.predicted, q) for r, q in marks if r.held_out]
    assert len(held) > 50
    assert np.mean([p == q for p, q in held]) >= 0.95


def test_held_out_labels_are_not_used(spark):
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (5, 0), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = classify(odd_docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert classify(odd_docs.limit(0), labels).collect() == []
    assert len({r.score for r in classify(odd_docs, labels.limit(0)).collect()}) == 1


def test_trees_learn_a_rule_and_walk_as_they_were_grown():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = train(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def one(row):
        total = forest.base
        for node in forest.root:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([one(v) for v in x[:50]], forest.score(x[:50]))


def test_statistics_have_a_column_each():
    s = Slice(np.frombuffer(b"a b!! cC", np.uint8), np.array([0, 0, 8]), np.array([True, False]), None)
    x = statistics(s)
    assert x.shape == (2, len(FEATURES)) and not x[0].any() and x[1].any()


def plain_statistics(text):
    """The features of one text by their definitions."""
    data = text.encode()
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return [0.0] * len(FEATURES)
    n, w, size = len(data), len(words), [len(x.encode()) for x in words]
    mean = sum(size) / w
    lines = [x for x in text.split("\n") if x]
    count = Counter(words)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    share = Counter(data)
    return [
        math.log1p(n), math.log1p(w), *(sum(bool(m[b]) for b in data) / n for m in CLASSES.values()), mean, math.sqrt(max(sum(x * x for x in size) / w - mean**2, 0)),
        sum(x > 12 for x in size) / w, sum(x <= 2 for x in size) / w, sum("A" <= x[0] <= "Z" for x in words) / w, len(count) / w, max(count.values()) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, len(lines) / w, len(set(lines)) / max(len(lines), 1),
        sum(sum(map(letter, x.encode())) < 0.5 * len(x.encode()) for x in words) / w, -sum(c / n * math.log2(c / n) for c in share.values()),
    ]


def test_statistics_by_their_definitions(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts += ["", " \n ", "one", "a a a A", "Ünï (cöde) 你好 | #1!!\n\nline\nline\r\n***", "x" * 3000 + " y\n" + "z " * 50]
    data = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    got = statistics(Slice(np.frombuffer(b"".join(data), np.uint8), off, np.zeros(len(data), bool), None))
    assert np.allclose(got, [plain_statistics(t or "") for t in texts], rtol=1e-4, atol=1e-5)
