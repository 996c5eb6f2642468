"""Global order without a single-task window: row numbers, running sums, hash order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low bits


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder; elsewhere it is an error, as executors could not read each other's."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="visemill-checkpoint-"))
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))


def _before(parts: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over all earlier partitions: one row a partition, so one task may order them."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.withColumn("_offset", F.coalesce(F.sum(value).over(w), F.lit(0))).select("_part", "_offset"))


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """0-based position of each row in the order given: a range sort, counts by partition, local positions.

    ``order`` must be total for a reproducible result.
    """
    ranged = _ranged(df, order)
    offsets = _before(ranged.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    return ranged.join(offsets, "_part").withColumn(name, F.col("_at") + F.col("_offset")).select(*df.columns, name)


def global_cumsum(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Running sums, current row included, over the order given: ``values`` maps a column to the name of its sum."""
    ranged = _ranged(df, order)
    local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged
    for k, (column, name) in enumerate(values.items()):
        offsets = _before(ranged.groupBy("_part").agg(F.sum(column).alias("_n")), "_n").withColumnRenamed("_offset", f"_offset{k}")
        out = out.join(offsets, "_part")
        out = out.withColumn(name, F.sum(column).over(local) + F.col(f"_offset{k}"))
    return out.select(*df.columns, *values.values())


def grouped_row_number(df: DataFrame, by: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """0-based position of each row within its group, and the group's ``size``: a group is a stretch of one global order,
    so no task has to hold it."""
    numbered = global_row_number(df, [*map(F.col, by), *order], "_global")
    groups = numbered.groupBy(*by).agg(F.min("_global").alias("_first"), F.count("*").alias(size))
    return numbered.join(groups, by).withColumn(name, F.col("_global") - F.col("_first")).select(*df.columns, name, size)


def grouped_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, the named percentiles, n) of ``value``, nulls left out, interpolated between neighbours.

    A range sort by group and value numbers the rows, and the few rows at the places asked for are looked up by number,
    so no task holds all values of a group. Groups without a value are left out.
    """
    numbered = global_row_number(rows.filter(F.col(value).isNotNull()).select(*by, value), [*map(F.col, by), F.col(value)], "_at")
    groups = numbered.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col("_first") + f(place(q))).cast("long").alias("_at"), weight(place(q)).alias("w")) for name, q in shares.items() for f, weight in ((F.floor, lambda p: 1 - (p - F.floor(p))), (lambda p: F.floor(p) + 1, lambda p: p - F.floor(p)))]))
    spots = groups.select(*by, "n", wanted.alias("s")).select(*by, "n", "s.*").filter("w > 0")
    found = spots.join(numbered.select("_at", F.col(value).alias("_v")), "_at")
    return found.groupBy(*by, "n").agg(*[F.sum(F.when(F.col("name") == name, F.col("w") * F.col("_v"))).alias(name) for name in shares]).select(*by, *shares, "n")


def hash_order(*parts) -> Column:
    """A reproducible pseudo-random ordering key from the given columns and literals."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))
