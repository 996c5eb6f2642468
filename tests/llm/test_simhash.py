import re

import numpy as np
import xxhash

from visemill.llm.components import connected_components
from visemill.llm.queries import op3_simhash
from visemill.llm.simhash import ball_links, link_fingerprints, near_duplicates


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(rows, prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = sorted(set(prints))
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc, p in zip(rows, prints):
        if doc is not None:
            least[find(p)] = min(least.get(find(p), doc), doc)
    return [least.get(find(p)) for p in prints]


def check(docs, got):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, components([r.doc_id for r in rows], prints))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(odd_docs):
    check(odd_docs, near_duplicates(odd_docs))
    assert near_duplicates(odd_docs.limit(0)).collect() == []


def test_query_on_real_rows(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), op3_simhash(spark, sf_dir))


def test_links_connect_exactly_the_near_pairs(spark, monkeypatch):
    import visemill.llm.simhash as m

    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    word = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 40)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 6)]))
    near = {(int(a), int(b)) for a in word for b in word if a < b and (int(a) ^ int(b)).bit_count() <= 4}
    for limit in (4_000_000, 3_000):
        monkeypatch.setattr(m, "WORDS_AT_ONCE", limit)
        a, b = ball_links(word, np.full(len(word), 2), list(range(64)))
        got = {(int(word[i]), int(word[j])) for i, j in zip(a, b)}
        assert got <= near
        edges = link_fingerprints(spark.createDataFrame([(int(x),) for x in word.view(np.int64)], "print long"))
        pairs = [(x, y) for x, y in near]
        assert groups(got) == groups(pairs) == groups([(s % 2**64, d % 2**64) for s, d in edges.collect()])


def groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, k) for k in range(1000, 1300)]
    pairs = chain + star + star + [(7, 7), (9, 8)]
    got = {}
    for node, root in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect():
        got.setdefault(root, set()).add(node)
    assert {frozenset(v) for v in got.values()} == groups(p for p in pairs if p[0] != p[1])
    assert all(root == min(v) for root, v in got.items())
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
