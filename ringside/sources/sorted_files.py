"""Files of rows sorted by a key, and which of them may hold given keys."""

from __future__ import annotations

import bisect
import datetime as dt
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables with up to so many rows have all their keys listed.
FEW_ROWS = 2000
#: Rows of a file at most.
FILE_ROWS = 500_000


def _plain(value):
    return value.isoformat() if isinstance(value, dt.date) else value


def _hash(value) -> int:
    return zlib.crc32(str(value).encode())


def write(rows: DataFrame, path: str, key: str, ranged: bool, order: list[str | Column] | None = None, file_rows: int | None = None) -> list[dict]:
    """Write the rows sorted by ``order`` (by key, if none is given) in each file, or over all files; returns the parts, in that order of their names.

    A part has its name, rows, least and largest key, and hashes of all keys if all parts together have few rows.
    """
    order = order or [key]
    placed = rows.repartitionByRange(*order) if ranged else rows.repartition(key)
    placed.sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows or FILE_ROWS).mode("overwrite").parquet(path)
    written, name = rows.sparkSession.read.schema(rows.schema).parquet(path), F.col("_metadata.file_name").alias("name")
    found = written.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")).collect()  # a row for each file
    keys = {}
    if sum(r["rows"] for r in found) <= FEW_ROWS:
        keys = {r["name"]: sorted(r["keys"]) for r in written.groupBy(name).agg(F.collect_set(F.crc32(F.col(key).cast("string"))).alias("keys")).collect()}
    return [{"name": r["name"], "rows": r["rows"], "low": _plain(r["low"]), "high": _plain(r["high"]), "keys": keys.get(r["name"])} for r in sorted(found)]


def choose(parts: list[dict], values: list) -> list[dict]:
    """The parts that may have a row with one of the keys."""
    asked = sorted({_plain(v) for v in values if v is not None})
    hashes = {_hash(v) for v in asked}
    out = []
    for part in parts:
        if part["keys"] is not None:
            hit = not hashes.isdisjoint(part["keys"])
        else:
            at = bisect.bisect_left(asked, part["low"]) if part["low"] is not None else len(asked)
            hit = at < len(asked) and asked[at] <= part["high"]
        if hit:
            out.append(part)
    return out
