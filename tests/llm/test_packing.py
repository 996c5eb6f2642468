import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import visemill.llm.packing as m
from visemill.llm.packing import cut_into_pieces, dominating_sets, pack, pack_counts
from visemill.llm.queries import op1_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected_pieces(rows, capacity):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    out = []
    for doc, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc, k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=str)


BITS = ["a", "Z", "the", "ing", "é", "É", "ß", "÷", "×", "ÿ", "'", "'s", "'re", "1", "42", ".", ",", "$", "&&&", "=", "<", "\u0338", "\u0301", "e\u0301", "Σ", "İ", "你", "好", "ｶﾞ", "½", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x00", "\x7f", "\u00a0", "\u3000", "\u2028", "<|endoftext|>", "😀", "👩\u200d🔬", "न\u093f", "\u1100\u1161", "_", "-"]


@pytest.mark.parametrize("remembered", [30, 300_000])
def test_ids_of_odd_texts_are_the_tokenizers(remembered, monkeypatch):
    """Random strings of letters, marks, signs and spaces; with a small memory words are forgotten and learnt again."""
    monkeypatch.setattr(m, "REMEMBERED", remembered)
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    r = random.Random(11)
    encoder = m.WordEncoder(PATH)
    for _ in range(40):
        texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 60))]
        data = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        ids, bounds = encoder.encode(np.frombuffer(b"".join(data), dtype=np.uint8), off)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) <= remembered + 3000


def check_places(rows, capacity):
    lie = defaultdict(list)
    for r in rows:
        lie[r.sequence_id].append((r.offset, r.length))
    for places in lie.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(lie)


def test_pieces_are_those_of_the_whole_texts(spark, odd_docs):
    for capacity in (2048, 7):
        got = cut_into_pieces(odd_docs, PATH, capacity).collect()
        rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
        assert sorted(map(tuple, got), key=str) == expected_pieces(rows, capacity)
        packed = pack(cut_into_pieces(odd_docs, PATH, capacity), capacity).collect()
        assert sorted((tuple(r)[:5] for r in packed), key=str) == expected_pieces(rows, capacity)
        check_places(packed, capacity)


def test_query_on_real_rows(spark, sf_dir):
    got = op1_best_fit_packing(spark, sf_dir).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_pieces(rows, 2048)
    n = check_places(got, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_no_rows(spark, odd_docs):
    assert pack(cut_into_pieces(odd_docs.limit(0), PATH)).collect() == []


def unfold(plan, counts):
    lie = defaultdict(list)
    seen = defaultdict(int)
    for i in np.lexsort((plan.rank, plan.length)):
        k = plan.length[i]
        stop = min([plan.rank[j] for j in range(len(plan.rank)) if plan.length[j] == k and plan.rank[j] > plan.rank[i]], default=counts[k])
        assert plan.rank[i] == seen[k]
        for x in range(stop - plan.rank[i]):
            lie[plan.sequence[i] + x // plan.per[i]].append((plan.offset[i] + x % plan.per[i] * k, k))
            seen[k] += 1
    assert dict(seen) == {k: v for k, v in counts.items() if v}
    return lie


def least_bins(items, capacity):
    """Brute force: fewest bins for a few items."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: n for n, b in enumerate(bins)}.values():
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_valid_and_near_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30])
    items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
    counts = {k: items.count(k) for k in set(items)}
    plan = pack_counts(dict(counts), capacity)
    lie = unfold(plan, counts)
    for places in lie.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(lie) == set(range(plan.n_sequences))
    best = least_bins(items, capacity)
    assert best <= plan.n_sequences <= best + 1
    if plan.fixed == plan.n_sequences:  # only dominating sets: the optimum
        assert plan.n_sequences == best


def test_reduction_fixes_perfect_pairs_at_once():
    plan = pack_counts({1500: 10**12, 548: 10**12, 2048: 5}, 2048)
    assert plan.n_sequences == plan.fixed == 10**12 + 5


@pytest.mark.parametrize("seed", range(200))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30])
    items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
    rest = {k: items.count(k) for k in set(items)}
    fixed = sum(n for _, _, n in dominating_sets(rest, capacity))
    assert least_bins(items, capacity) == fixed + least_bins([k for k, n in sorted(rest.items(), reverse=True) for _ in range(n)], capacity)


def test_reduction_goes_on_past_a_length_without_a_dominating_set():
    # beside 1700 three short pieces fit, so nothing is fixed there; 1048 and 1000 fill a sequence
    rest = {1700: 5, 1048: 3, 1000: 3, 100: 50}
    assert list(dominating_sets(rest, 2048)) == [(1048, 1000, 3)]
    assert rest == {1700: 5, 100: 50}
