"""Filters and rewrites of ``documents`` built on the operators; each keeps the columns of its input, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import slices
from .postings import decontaminate
from .quality import fit_documents, statistics
from .scratch import cut
from .simhash import near_duplicates
from .suffix import remove_covered_bytes


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows whose text the quality trees score at ``threshold`` or more. Nulls and empty texts are scored like others."""
    forest = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for s in slices([batch]):
                part = batch.slice(first, len(s))
                first += len(s)
                yield part.filter(pa.array(forest.value.score(statistics(s)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text, and the rest of the row in one column, so that no name clashes with an operator's columns."""
    rest = [_column(c).alias(c) for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("text")).alias("row"))


def keep_one_of_near_copies(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies. Rows of null doc_id stay; of rows that repeat a
    doc_id one stays."""
    near = cut(near_duplicates(docs, distance))
    gone = near.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = near.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(again.filter("_n = 1").select(docs.columns))


def cut_repeats(docs: DataFrame, depth: int = 50) -> DataFrame:
    """Texts without what a document of smaller doc_id has too, in runs of ``depth`` bytes or more; n_chars follows
    the text, and a null text becomes empty."""
    out = remove_covered_bytes(_apart(docs), depth)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that hold no benchmark passage to speak of: those not ``contaminated``."""
    found = decontaminate(_apart(docs), benchmark, within=None, with_text=True)
    text = F.when(~F.col("row").getField("text"), F.col("text")).alias("text")
    return found.filter("not contaminated").select([text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])

