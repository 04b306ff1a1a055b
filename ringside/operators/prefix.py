"""Running sums over an order of all rows, without a task that orders them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.sources.scratch import stored


def running_sums(rows: DataFrame, order: list[str | Column], values: list[str], suffix: str = "_before") -> DataFrame:
    """``rows`` with the sum of each value (integers or doubles, null counting as 0) over all rows before, in the given order.

    Rows go to ranges between sampled quantiles of the order, so tasks are even however values crowd; each range is sorted and added up
    as it streams by, a batch at a time.  What comes before a range is the sum of the others, one row each.  Rows with equal keys are in one
    range and in any order within it; add what tells them apart to the order where that matters.
    """
    kinds = {v: T.LongType() if isinstance(rows.schema[v].dataType, T.IntegralType) else T.DoubleType() for v in values}
    names = [f"{v}{suffix}" for v in values]
    schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType()), *[T.StructField(n, kinds[v]) for n, v in zip(names, values)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(values, 0)
        for b in batches:
            columns = list(b.columns)
            for v in values:
                kind = np.int64 if isinstance(kinds[v], T.LongType) else np.float64
                own = b.column(v).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                up_to = np.cumsum(own, dtype=kind)
                columns.append(pa.array(up_to - own + before[v]))
                if len(up_to):
                    before[v] += up_to[-1]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    inside = stored(placed.mapInArrow(run, schema), "running")
    totals = inside.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values]).collect()  # a row for each range
    offset, base = dict.fromkeys(values, 0), {}
    for r in sorted(totals, key=lambda r: r["__range"]):
        base[r["__range"]] = dict(offset)
        for v in values:
            offset[v] += r[v] or 0
    if not base:
        return inside.drop("__range")
    add = lambda v, n: F.element_at(F.create_map(*[F.lit(x) for k, o in base.items() for x in (k, float(o[v]) if isinstance(kinds[v], T.DoubleType) else int(o[v]))]), F.col("__range")) + F.col(n)
    return inside.withColumns({n: add(v, n) for v, n in zip(values, names)}).drop("__range")
