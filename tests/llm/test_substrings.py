import hashlib
import random
import re

import numpy as np
import pytest

import visemill.llm.bytetext as b
from visemill.llm.queries import op5_suffix_array, op9_rabin_karp
from visemill.llm.suffix import Suffixes, remove_covered_bytes
from visemill.llm.windows import remove_repeated_windows

BIG = 1 << 63


def covered(rows, depth=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each row by brute force."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - depth + 1):
            w = data[i : i + depth]
            least[w] = min(least.get(w, BIG), BIG - 1 if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            if least[data[i : i + depth]] < (BIG - 1 if doc is None else doc):
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated(rows, width=35):
    texts = [(doc, re.findall("[^\x20\x09-\x0d]+", text or "")) for doc, text in rows]
    count = {}
    for _, words in texts:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            count[w] = count.get(w, 0) + 1
    out = []
    for doc, words in texts:
        gone = bytearray(len(words))
        for i in range(len(words) - width + 1):
            if count[tuple(words[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((doc, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def bytes_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def words_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_queries_on_real_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert bytes_of(op5_suffix_array(spark, sf_dir)) == covered(rows)
    assert words_of(op9_rabin_karp(spark, sf_dir)) == repeated(rows)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = remove_covered_bytes(odd_docs)
    assert bytes_of(got) == covered(rows)
    assert {"lang", "length"} <= set(got.columns)
    assert words_of(remove_repeated_windows(odd_docs)) == repeated(rows)
    assert remove_covered_bytes(odd_docs.limit(0)).collect() == [] == remove_repeated_windows(odd_docs.limit(0)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_texts_that_repeat_themselves(spark, seed, monkeypatch):
    import visemill.llm.suffix as m

    r = random.Random(seed)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(20, 200))) for _ in range(6)] + ["a" * 90, "ab" * 60, "é" * 60]
    rows = [(r.randint(0, 25), "".join(r.choice(pool)[r.randint(0, 9) :] + r.choice(["", " ", "b"]) for _ in range(r.randint(0, 8)))) for _ in range(40)]
    monkeypatch.setattr(m, "SUFFIXES_AT_ONCE", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bytes_of(remove_covered_bytes(df)) == covered(rows)
    words = [(d, " ".join(t)) for d, t in rows]
    assert words_of(remove_repeated_windows(spark.createDataFrame(words, "doc_id long, text string").repartition(3))) == repeated(words)


@pytest.mark.parametrize("bits", [1, 4])
def test_collisions_of_candidates_are_found_and_mended(spark, bits):
    r = random.Random(bits)
    line = "".join(r.choice("abcd ") for _ in range(400))
    rows = [(k, line[r.randint(0, 200) : r.randint(220, 400)] + r.choice(["", "tail " * 9, line[:90]])) for k in range(30)]
    rows += [(40 + k, ("a", "b", "c")[k % 3] * 60 + "x" * (k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bytes_of(remove_covered_bytes(df, hash_bits=bits)) == covered(rows)


def test_false_claims_are_told_from_true_ones():
    import visemill.llm.suffix as m

    a = np.frombuffer(b"0123456789" * 300, np.uint8)
    c = a.copy()
    c[1450] ^= 1
    first, size = np.array([5, 40, 200, 1400]), np.array([60, 50, 1300, 90])
    to = np.full(4, 7)
    evidence = [(7, m.pack_claims(a, first, size, to)), (8, m.pack_claims(c, first, size, to))]
    (start, end, ok), (_, _, not_ok), (_, _, elsewhere) = m.verified([m.pack_claims(x, first, size, h) for x, h in ((a, to), (c, to), (c, to + 1))], evidence, 0)
    assert ok and not not_ok and elsewhere and start.tolist() == first.tolist() and end.tolist() == (first + size).tolist()
    assert [ok for _, _, ok in m.verified([m.pack_claims(a, first, size, to)], [], 0)] == [False]
    assert m.same_texts(a, first, c, first, size).tolist() == [True, True, False, False]


@pytest.mark.parametrize("seed", range(10))
def test_suffix_sort(seed):
    r = np.random.default_rng(seed)
    buf = r.integers(97, 99, 300).astype(np.uint8)
    buf[100:180] = buf[0:80]
    depth = 12
    start = r.permutation(300 - depth)[:200]
    bucket = r.integers(0, 1 + seed, 200).astype(np.uint64)
    s = Suffixes(buf, depth)
    key = [(int(bucket[i]), buf[start[i] : start[i] + depth].tobytes()) for i in range(200)]
    order = s.sort(start, bucket)
    assert [key[i] for i in order] == sorted(key)
    kinds = s.classes(start, bucket)
    assert all((kinds[i] == kinds[j]) == (key[i] == key[j]) for i in range(200) for j in range(200))


def test_anchors_fill_all_parts_of_the_key_space():
    import visemill.llm.suffix as m

    buf = np.random.default_rng(5).integers(97, 123, 400_000).astype(np.uint8)
    key, *_ = m.anchors(b.Slice(buf, np.array([0, len(buf)]), np.array([False]), None), 50)
    count = np.bincount((np.unique(key) >> np.uint64(60)).astype(np.int64), minlength=16)
    assert count.max() < 1.2 * count.mean()


def test_suffixes_of_a_common_anchor_are_sorted_in_passes():
    """A hundred thousand surroundings of one anchor; a comparison of any two at a time would take far longer."""
    import time

    n, depth = 100_000, 50
    buf = np.random.default_rng(6).integers(97, 99, (n, depth)).astype(np.uint8)
    buf[:, 20:36] = 120
    buf[::3] = buf[0]
    buf, start = buf.ravel(), np.arange(n) * depth
    began = time.process_time()
    kinds = Suffixes(buf, depth).classes(start, np.zeros(n, dtype=np.uint64))
    assert time.process_time() - began < 0.5
    _, want = np.unique(buf.reshape(n, depth).view(f"S{depth}").ravel(), return_inverse=True)
    assert np.array_equal(kinds, want)


def test_words_of_regular_build_are_told_apart(spark):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))  # Thue and Morse's word and its complement
    c = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, "w " * 34 + a), (2, "w " * 34 + c), (3, " ".join([a, c] * 30)), (4, " ".join([c, a] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert words_of(remove_repeated_windows(df)) == repeated(rows)
    assert bytes_of(remove_covered_bytes(df)) == covered(rows)


def test_string_hashes():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 6000).astype(np.uint8)
    start = np.concatenate([r.integers(0, 5980, 3000), [0, 3000, 10]])
    end = np.minimum(start + np.concatenate([r.integers(0, 20, 3000), [2900, 2900, 2900]]), 6000)
    data[3000:5900] = data[:2900]
    h = b.string_hashes(b.lanes_of(data), start, end)
    seen = {}
    for i, x in enumerate(h.tolist()):
        seen.setdefault(data[start[i] : end[i]].tobytes(), set()).add(x)
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("width", [1, 2, 5, 35, 64])
def test_window_sums_are_the_polynomials(width):
    values = np.random.default_rng(width).integers(0, 1 << 63, 150).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    p = (1 << 61) - 1
    want = [sum(int(v) % p * pow(b.RADIX, width - 1 - k, p) for k, v in enumerate(values[i : i + width])) % p for i in range(150 - width + 1)]
    assert b.window_sums(values, width).tolist() == want and b.window_sums(values[: width - 1], width).tolist() == []


def test_anchors_of_pieces_are_those_of_the_whole(monkeypatch):
    import visemill.llm.suffix as m

    r = np.random.default_rng(2)
    buf = r.integers(97, 99, 3000).astype(np.uint8)
    off = np.array([0, 10, 700, 700, 1500, 2990, 3000])
    s = b.Slice(buf, off, np.zeros(6, bool), None)
    whole = [x.tolist() for x in m.anchors(s, 50)]
    for at_once in (1, 7, 64, 1000):
        monkeypatch.setattr(m, "ANCHORS_AT_ONCE", at_once)
        assert [x.tolist() for x in m.anchors(s, 50)] == whole


def test_windows_whose_first_hashes_agree_by_chance():
    """All windows suspected: those that are equal, and no others, agree in the second hash."""
    import pyarrow as pa

    from visemill.llm.windows import suspects, window_hashes

    r = random.Random(8)
    words = [r.choice("abcd") for _ in range(300)]
    text = " ".join(words[:200] + words[50:120]).encode()
    s = b.Slice(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), np.array([False]), pa.RecordBatch.from_pydict({"doc_id": [1]}))
    _, first, h, second = window_hashes(s, 35)
    every = np.arange(len(h))
    assert suspects(np.zeros_like(h), None, 3).tolist() == every.tolist()
    found = suspects(second(every), None, 3)
    assert found.tolist() == suspects(h, None, 3).tolist() and len(found) == 2 * 36
    assert not set(second(every).tolist()) & set(h.tolist())


def test_columns_named_like_results_give_way(spark):
    rows = [(1, "a b " * 40, 7, "x", 1), (2, "c d", 8, "y", 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept_text string, mine int")
    got = remove_repeated_windows(docs)
    assert sorted(got.columns) == ["doc_id", "kept_sha256", "kept_text", "mine", "n_removed", "n_words"]
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text, r.mine) for r in got.collect()} == {(1, 80, 80, "", 1), (2, 2, 0, "c d", 2), (None, 0, 0, "", None)}
