"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class, compared once and weighted by their number. Within a bucket all pairs of classes are
compared by blocks of a matrix product; what leaves the task is a sum of links for each class and a spanning forest,
never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, forest
from .scratch import cut

#: Classes of a bucket that a task compares with as many others at once.
BLOCK = 2048
SEED = 7


def plan_tables(n: int, cosine: float, miss: float = 1e-4) -> tuple[int, int]:
    """Bits of a table and number of tables, so that a pair at ``cosine`` escapes all with probability ``miss`` at most."""
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    bits = int(min(24, max(4, round(math.log2(max(1, n) / 512)))))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree**bits)))


def codes_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    sign = (x @ planes > 0).reshape(len(x), tables, bits)
    return (sign * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal, non-null label and equal length link at ``cosine`` or more in double precision. Vectors that are
    null, zero, empty or hold null or non-finite components, and those of null label, link with nothing. Repeated rows
    are vectors of their own that link with each other. component_id is the smallest vec_id reachable (null ids are
    passed over); kept tells whether it is the row's own.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    arrow = pa.float32() if kind == "<f4" else pa.float64()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, label = batch.column(1), batch.column(2)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().fill_null(float("nan")).cast(arrow).to_numpy(zero_copy_only=False).astype(kind)
            x = x + x.dtype.type(0)  # no negative zeros
            off = np.concatenate([[0], np.cumsum(size)])
            within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
            good = (within(~np.isfinite(x)) == 0) & (within(x != 0) > 0) & label.is_valid().to_numpy(zero_copy_only=False)
            raw, marks, at = x.tobytes(), label.cast(pa.string()).to_pylist(), (off * x.itemsize).tolist()
            data = [raw[at[i] : at[i + 1]] if ok else None for i, ok in enumerate(good.tolist())]
            keys = [None if d is None else hashlib.blake2b(d + m.encode(), digest_size=16).digest() for d, m in zip(data, marks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(marks, pa.string()), pa.array(data, pa.binary())], ["vec_id", "key", "label", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label").mapInArrow(read, "vec_id long, key binary, label string, vec binary")
    rows = cut(rows)
    grouped = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, cosine)

    def hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec").to_pylist()
            size = np.array([len(v) for v in vec])
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                x = np.frombuffer(b"".join(vec[i] for i in at), dtype=kind).reshape(len(at), -1).astype(np.float64)
                code = codes_of(x, bits, tables)
                part = batch.take(pa.array(at))
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t), pa.int32()), pa.array(code[:, t]), part.column("label"), pa.array(np.full(len(at), length), pa.int32()), part.column("cid"), part.column("n"), part.column("vec"), packed],
                        ["table", "code", "label", "size", "cid", "n", "vec", "codes"],
                    )

    hashed = classes.select("label", "cid", "n", "vec").mapInArrow(hash_rows, "table int, code int, label string, size int, cid long, n long, vec binary, codes binary")
    bucket = ["table", "code", "label", "size"]
    # a crowded bucket is dealt to a task for each pair of its blocks, every class to all pairs of its own block
    crowded = hashed.groupBy(*bucket).count().filter(F.col("count") > 2 * BLOCK).select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = hashed.join(crowded, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        table = group.column("table")[0].as_py()
        across = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), dtype=kind).reshape(group.num_rows, -1).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        cid, n, side = (group.column(c).to_numpy() for c in ("cid", "n", "own"))
        code = np.frombuffer(b"".join(group.column("codes").to_pylist()), dtype=np.int32).reshape(group.num_rows, -1)[:, :table]
        links = np.zeros(len(x), dtype=np.int64)
        src, dst = [], []
        for a in range(0, len(x), BLOCK):
            for b in range(a, len(x), BLOCK):
                i, j = np.nonzero(x[a : a + BLOCK] @ x[b : b + BLOCK].T >= cosine)
                i, j = i + a, j + b
                take = i < j
                if across:
                    take &= side[i] != side[j]
                i, j = i[take], j[take]
                for k in range(0, len(i), 500_000):  # pairs that an earlier table has seen count there
                    p, q = i[k : k + 500_000], j[k : k + 500_000]
                    new = ~(code[p] == code[q]).any(axis=1) if table else np.ones(len(p), dtype=bool)
                    np.add.at(links, p[new], n[q[new]])
                    np.add.at(links, q[new], n[p[new]])
                if len(i):
                    s, d = forest(cid[i], cid[j])
                    src.append(s)
                    dst.append(d)
        some = np.flatnonzero(links)
        src, dst = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (src, dst))
        return pa.table({
            "src": pa.array(np.concatenate([cid[some], src]), pa.int64()),
            "dst": pa.array(np.concatenate([cid[some], dst]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(src), np.int64)]), pa.int64()),
        })

    found = cut(dealt.groupBy(*bucket, "low", "high").applyInArrow(compare, "src long, dst long, links long"))
    links = found.filter("links > 0").groupBy(F.col("src").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("links = 0").select("src", "dst")).select(F.col("node").alias("cid"), "root")
    known = classes.select("key", "cid", "least", "n").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
