"""Mixing sources to target weights.

The tokens (words) of each source are added up.  The sources share the whole by weight; none gets more than ``cap`` times what
it has, and what such a source can't take is shared again among the others by weight, until no source is above its cap.  A
source's rate is its target over its size: each of its documents is taken floor(rate) times, and once more if a number in
[0, 1) made from a hash of the seed and the document's id is below the rest of the rate.  Reruns therefore agree, and a
document's copies depend on nothing but its id and its source's rate.

A null text has size 0; a null source is a source of its own, last in order; documents with a null id are told apart by
their texts.  Rows with equal ids are taken equally often.  Only the table of sources, one row each after pre-aggregation, is
put in order in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import WORD, free_name, materialize

#: Up to so many sources their table is broadcast (about 50 bytes a source); beyond, it is a shuffle join.
BROADCAST_SOURCES = 50_000
PLAN = ["size", "source_size", "target", "rate", "copies"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chance(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the first 13 hexadecimal digits of md5(seed:id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    In order of cap over weight, a source is capped as long as its cap is no more than its share of what all before it leave.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(kinds, (order - 1) % len(weights) + 1).cast("long")).withColumn("most", F.col("source_size") * cap)
    by_cap = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("others", F.sum("w").over(after))
    s = s.withColumn("capped", F.col("most") * F.col("others") <= F.col("w") * F.col("left"))
    rest = F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(all_rows)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(all_rows)
    share = F.try_divide((rest * F.col("w")).cast("double"), free.cast("double"))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` with size, source_size, target and rate of its source, and copies; ``prefix`` goes before these names.

    All rows and columns stay; older columns of these names are replaced.
    """
    size, source_size, target, rate, copies = names = [prefix + n for n in PLAN]
    docs = docs.drop(*[c for c in names if c not in (id_col, text_col, source_col)])
    own = free_name("__source", docs)
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    table = materialize(targets(sizes, weights, cap), "sources")
    table = table.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias(rate))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    sized = docs.withColumn(size, word_count(F.col(text_col)))
    joined = sized.join(table, sized[source_col].eqNullSafe(table[own])).drop(own)
    whole = F.floor(rate)
    more = F.when(chance(F.col(id_col), F.col(text_col), seed) < F.col(rate) - whole, 1).otherwise(0)
    return joined.withColumn(copies, (whole + more).cast("int"))


def emit(planned: DataFrame, prefix: str = "") -> DataFrame:
    """Each row of a plan as often as its copies say; the plan's columns are left out."""
    names, copy = [prefix + n for n in PLAN], free_name("__copy", planned)
    rest = [F.col(f"`{c}`") for c in planned.columns if c not in names]
    copies = F.col(f"{prefix}copies")
    return planned.filter(copies > 0).select(*rest, F.explode(F.sequence(F.lit(1), copies)).alias(copy)).drop(copy)


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix: ``docs``, all columns and no others, each row as often as its copies in plan() say."""
    prefix = "__"
    while {prefix + n for n in PLAN} & {c.lower() for c in docs.columns}:
        prefix += "_"
    return emit(plan(docs, prefix=prefix, **parameters), prefix)


#: DuckDB SQL for the query op7: the plan over ``documents`` with the parameters above.
SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS w, source_size * 3 AS most FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    coalesce(CAST(sum(most) OVER (ORDER BY most / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS used,
    CAST(sum(w) OVER (ORDER BY most / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS others
  FROM w
), f AS (
  SELECT *, most * others <= w * (total - used) AS capped FROM c
), g AS (
  SELECT *, total - CAST(sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS BIGINT) AS rest,
    CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS free
  FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(nullif(free, 0) AS DOUBLE) END AS target FROM g
), r AS (
  SELECT *, coalesce(target / CAST(nullif(source_size, 0) AS DOUBLE), 0.0) AS rate FROM t
), p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM p
"""
