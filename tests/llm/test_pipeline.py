

import corpus_pipeline
from tests.llm.test_postings import expected as contaminated
from tests.llm.test_simhash import components, fingerprint
from visemill.llm.stages import cut_repeats, keep_good, keep_one_of_near_copies, keep_uncontaminated


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def without_covered(rows, depth=50):
    """Brute force of the suffix-array stage on (doc_id, text)."""
    least = {}
    for doc, text in rows:
        data = text.encode()
        for i in range(len(data) - depth + 1):
            w = data[i : i + depth]
            least[w] = min(least.get(w, doc), doc)
    out = {}
    for doc, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            if least[data[i : i + depth]] < doc:
                gone[i : i + depth] = b"\1" * depth
        out[doc] = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    return out


def test_every_stage_on_the_rows_before_it(spark, sf_dir):
    from tests.llm.test_packing import PATH, check_places, expected_pieces  # noqa: F401

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    read = lambda df: {r.doc_id: r for r in df.collect()}
    before = read(docs)
    good = stages[0](spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = read(good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(before[k] == r for k, r in kept.items())
    right = [(k in kept) == (q == 1) for k, q in labels.items()]
    assert sum(right) / len(right) > 0.95

    one = stages[1](spark, good, sf_dir)
    ids = sorted(kept)
    root = components(ids, [fingerprint(kept[k].text) for k in ids])
    assert sorted(read(one)) == sorted(k for k, c in zip(ids, root) if k == c)

    left = read(one)
    cut = stages[2](spark, one, sf_dir)
    assert cut.columns == docs.columns
    want = without_covered([(k, r.text) for k, r in left.items()])
    assert {k: r.text for k, r in read(cut).items()} == want
    assert all(r.n_chars == len(r.text) for r in read(cut).values())

    clean = stages[3](spark, cut, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated(list(want.items()), items) if r[-1]}
    assert {k: r.text for k, r in read(clean).items()} == {k: t for k, t in want.items() if k not in bad}

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == expected_pieces([(k, r.text) for k, r in read(clean).items()], 2048)
    check_places(packed, 2048)


def test_stages_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (7, 1), (3, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "word stream number 12345"), (2, None)], "item_id long, text string")
    for f in (lambda d: keep_good(d, labels, 0.0), keep_one_of_near_copies, cut_repeats, lambda d: keep_uncontaminated(d, bench)):
        out = f(odd_docs)
        assert out.columns == odd_docs.columns
        assert 0 < out.count() <= odd_docs.count()
        assert f(odd_docs.limit(0)).collect() == []
    assert rows_of(keep_good(odd_docs, labels, 0.0)) == rows_of(odd_docs)
    ids = [r.doc_id for r in keep_one_of_near_copies(odd_docs).collect()]
    assert ids.count(None) == 2 and 8 not in ids and ids.count(7) == 1
    assert 9 not in [r.doc_id for r in keep_uncontaminated(odd_docs, bench).collect()]


def test_of_a_repeated_id_one_row_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "something else entirely here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one_of_near_copies(df).collect()) == [1, 2]


def test_columns_of_any_name_are_kept(spark, odd_docs):
    from pyspark.sql import functions as F

    names = ["n_removed", "n_words", "n_bytes", "n_spans", "kept_text", "kept_sha256", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "row", "score", "stats", "component_id", "fingerprint"]
    docs = odd_docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    for f in (lambda d: keep_good(d, labels, 0.0), keep_one_of_near_copies, cut_repeats, lambda d: keep_uncontaminated(d, bench)):
        out = f(docs)
        assert out.columns == docs.columns
        assert all(r[n] == (None if r.doc_id is None else f"{n} of {r.doc_id}") for r in out.collect() for n in names)


def test_clean_rows_come_back_as_they_were(spark, odd_docs):
    bench = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    assert rows_of(keep_uncontaminated(odd_docs, bench)) == rows_of(odd_docs)
