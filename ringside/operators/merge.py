"""Deduplication, lookups and merges by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.sources.files import ORDINAL
from ringside.sources.scratch import cut


def first_by_key(rows: DataFrame, keys: list[str], ordinal: str = ORDINAL) -> DataFrame:
    """The first row of each key in file order; null keys are a key like any other."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def last_by_key(rows: DataFrame, keys: list[str], ordinal: str = ORDINAL) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(ordinal).desc())
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def unique_only(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with one row; others are ambiguous and left out."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value)).filter("__n = 1").drop("__n")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not among the old ones; nulls equal nulls."""
    known = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return new.join(known, same, "left_anti")


def with_ids(new: DataFrame, old: DataFrame, order: list, key: str = "id", last: int | None = None) -> DataFrame:
    """New rows with ids after the largest old one, in the given order.  ``last`` is that id, where it is known.

    The order over all new rows is found without gathering them: they are range-partitioned, each partition is numbered, and what
    stands before it is added.  One number per partition goes to the driver.
    """
    start = last if last is not None else old.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
    sorted_rows = new.drop(key).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sorted_rows = cut(sorted_rows.withColumn("__i", F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))))
    before, sizes = start, {}
    for r in sorted(sorted_rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()):
        sizes[r["__p"]], before = before, before + r["n"]
    if not sizes:
        return new.withColumn(key, F.lit(None).cast("long"))
    base = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return sorted_rows.withColumn(key, F.element_at(base, F.col("__p")) + F.col("__i") + 1).drop("__p", "__i")


def fresh(old: DataFrame, new: DataFrame, keys: list[str], key: str = "id", last: int | None = None) -> DataFrame:
    """The new rows whose key is not among the old ones, with ids after the old ones in the order of their keys.

    Of new rows with the same key the first by ORDINAL is taken, where there is one.
    """
    new = first_by_key(new, keys).drop(ORDINAL) if ORDINAL in new.columns else new.dropDuplicates(keys)
    return with_ids(absent(new, old, keys), old, [F.col(k).asc_nulls_first() for k in keys], key, last)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Get-or-create: the old rows and the fresh ones."""
    return old.unionByName(fresh(old, new, keys, key), allowMissingColumns=True)


def update_only(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The old rows with ``columns`` replaced where a new row has their key, by nulls too; nothing is inserted."""
    mine = new.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*columns).alias("__new"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    hit = F.col("__new").isNotNull()
    joined = old.join(mine, same, "left")
    return joined.select(*[F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
