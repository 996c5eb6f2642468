import hashlib
import re
from collections import Counter

import pytest

from visemill.llm.postings import build_index, decontaminate, search
from visemill.llm.queries import op8_positional_index


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(len(w) - width + 1) if len(w) >= width else [0] if w else []:
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    found |= names
                    hit.update(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def near(docs, items, width=13, within=26):
    """Items of each document with a window all of whose words are near its rarest one, by brute force."""
    texts = [(doc, words_of(t)) for doc, t in docs]
    count = Counter(w for _, words in texts for w in words)
    out = []
    for doc, words in texts:
        at = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        hit = set()
        for item, text in items:
            w = words_of(text)
            for i in range(len(w) - width + 1) if len(w) >= width else [0] if w else []:
                window = w[i : i + width]
                rare = min(window, key=lambda x: count[x])
                if any(all(any(abs(k - j) <= within for j in at.get(x, [])) for x in window) for k in at.get(rare, [])):
                    hit.add("" if item is None else str(item))
        out.append((doc, len(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_query_on_real_rows(spark, sf_dir):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
    want = expected(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert any(r[-1] for r in want)
    result = op8_positional_index(spark, sf_dir)
    assert got(result) == want
    assert sorted(map(tuple, result.select("doc_id", "n_near").collect()), key=str) == near(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize("at_once", [5000, 2])
def test_odd_rows(spark, odd_docs, at_once, monkeypatch):
    import visemill.llm.postings as m

    monkeypatch.setattr(m, "ITEMS_AT_ONCE", at_once)
    items = [(1, "Quick BROWN fox"), (2, None), (3, ""), (4, "same words here now and then same words here now and then same words here now"), (4, "one"), (None, "with five or more words"), (5, "你好 x"), (6, "no such words anywhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    result = decontaminate(odd_docs, bench)
    assert got(result) == expected(docs, items)
    assert sorted(map(tuple, result.select("doc_id", "n_near").collect()), key=str) == near(docs, items)
    assert {"lang", "length"} <= set(result.columns)
    assert decontaminate(odd_docs.limit(0), bench).collect() == []
    assert got(decontaminate(odd_docs, bench.limit(0))) == expected(docs, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha beta x x x x x x gamma"), (4, "alpha beta"), (5, "gamma")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    index = build_index(docs)
    assert sorted({r.doc for r in search(index, bench, within=5).filter("near").collect()}) == [0, 1]
    assert search(index, bench).collect() == []


def test_words_of_regular_build_are_told_apart(spark):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))  # Thue and Morse's word and its complement
    b = a.translate(str.maketrans("ab", "ba"))
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = [(1, f"x {a}"), (2, f"x {b}")]
    assert got(decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench)) == expected(docs, [(1, a)])


def test_equal_hashes_are_no_match(spark, odd_docs, monkeypatch):
    """All words of one length hash alike: the letters decide."""
    import visemill.llm.postings as m

    monkeypatch.setattr(m.Words, "hashes", lambda self: (self.end - self.start).astype("uint64"))
    docs = m.words_of(*_bytes("the cat sat on a mat the cow sat on the mat"))
    p = m.phrases_of(["cow sat", "cat sat on a rug"], 2)
    p.order = m.np.tile(m.np.arange(2), (len(p.size), 1))
    h = docs.hashes()
    by = m.np.argsort(h, kind="stable")
    terms, count = m.np.unique(h, return_counts=True)
    shard = m.Shard(docs.bounds, terms, count, m.np.cumsum(count) - count, by)
    phrase, word = m.exact_matches(shard, p)
    row = {"text": m.pack_bytes(docs.buf.tobytes()), "ends": m.pack_bytes(m.np.array([0, len(docs.buf)], "<i8").tobytes())}
    found = m.verified(row, p, phrase, word)
    assert len(word) > len(found[1]) and sorted(zip(*(x.tolist() for x in found))) == [(0, 7), (1, 1), (2, 2), (2, 8), (3, 3)]


def _bytes(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)], dtype=np.int64)
