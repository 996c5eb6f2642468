import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from visemill.llm.fim import PLAIN, PSM, SPM, exchange, fill_in_middle, plan, restore, restore_text, rotate, token_ends
from visemill.llm.queries import op12_fill_in_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
texts = st.lists(st.sampled_from(["a", "é", "\u2003", "你", " ", "\t", "\x0b", "\x1c", "<", "S>", "P", "<M", "\x00"])).map("".join)


def expected(doc_id, text):
    """Text, form and counts from the regular expression and plain slices."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or h[2] % 100 >= 50 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if out[1] == "S" else "psm", len(p), len(m), out


@given(texts)
def test_tokens(text):
    ends, at = [], 0
    for t in TOKEN.findall(text):
        at += len(t.encode())
        ends.append(at)
    assert token_ends(text.encode()).tolist() == ends
    assert at == len(text.encode())


@given(st.binary(max_size=40), st.data())
def test_rotation(data, draw):
    a, m, b = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buffer = bytearray(data)
    rotate(buffer, a, m, b)
    assert bytes(buffer) == data[:a] + data[m:b] + data[a:m] + data[b:]
    rotate(buffer, a, a + b - m, b)
    assert bytes(buffer) == data


@given(texts, st.integers(0, 10**6))
def test_round_trip(text, doc_id):
    data = text.encode()
    ends = [0, *token_ends(data).tolist()]
    form, a, b = plan(doc_id, len(ends) - 1, data, 42, 50, 80)
    assert (len(ends) - 1, form) == expected(doc_id, text)[:2]
    for f in (PLAIN, PSM, SPM) if form != PLAIN else (PLAIN,):
        assert bytes(restore(exchange(data, f, ends[a], ends[b]), f)) == data
    assert exchange(data, form, ends[a], ends[b]).decode() == expected(doc_id, text)[4]


def test_operator_on_odd_rows(spark, odd_docs):
    more = [(10 + i, t, "en", 1) for i, t in enumerate(["<P> seen", "a <S>", "<M>", "  lead and trail \n", "x" * 300_000 + " é" * 200_000, "<", "one two <"] * 4)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).withColumnsRenamed({"length": "N", "lang": "form"})
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r.doc_id, *expected(r.doc_id, r.text)) for r in rows), key=repr)
    back = restore_text(got)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in rows), key=repr)
    assert fill_in_middle(docs.limit(0)).collect() == [] and restore_text(got.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(docs, percent=100, percent_spm=0).collect()} == {"plain", "psm"}


def test_query_on_real_rows(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = []
    for r in rows:
        n, form, p, m, out = expected(r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or "")))
    got = op12_fill_in_middle(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({w[2] for w in want}) == 3


def test_a_text_of_50_mb(spark):
    docs = spark.range(1).selectExpr("7L AS doc_id", "repeat('word stream, number 12345. ', 2000000) AS text")
    row = fill_in_middle(docs, percent=100).selectExpr("n", "form", "length(output) AS size").first()
    assert row.n == 8_000_001 and row.form != "plain" and row.size == 54_000_009
    assert restore_text(fill_in_middle(docs, percent=100)).join(docs, ["doc_id", "text"]).count() == 1

