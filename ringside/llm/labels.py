"""Labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import fold

PARTS = 1_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int | None, held_out: int | None, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled documents at most, outside the held-out fold.

    y is 0 or 1; documents with no label, a null or both labels, or without a text are left out.  If there are more labelled
    ids than ``most``, those with the lowest hashes of id are taken.  As ``most`` bounds them, the ids are broadcast.  Of rows with one
    id that with the smallest hash of its text is taken, so ``most`` bounds rows too.
    """
    ids = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).alias("y"))
    if folds is not None:
        ids = ids.filter(fold("doc_id", folds) != held_out)
    ids = ids.groupBy("doc_id").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    n = ids.count()
    if n > most:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < int(PARTS * most / n))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    mine = texts.join(F.broadcast(ids), "doc_id")
    one = F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "text"))
    return mine.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.text", "r.y")
