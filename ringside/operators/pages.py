"""Pages of an ordered table at any offset: ranges in order, with how many rows each has.

    folder/<write>/    the rows, sorted over all files
    folder/_log        the files in order, with their rows (commits.py)

The page at an offset is in the file where the running count of rows passes it, or in that and the next ones, and the total is the sum of the
counts, so neither depends on how many rows there are.  Only writing sorts, by ranges.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ringside.sources import sorted_files
from ringside.sources.commits import CommitLog

#: Rows of a range at most.
RANGE_ROWS = 10_000


class PagedTable:
    """key: a column of the order, for its range in the log."""

    def __init__(self, spark: SparkSession, folder: str, order: list[str | Column], key: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.order, self.key, self.log = order, key, CommitLog(spark, folder)

    def write(self, rows: DataFrame) -> int:
        """Make the table hold these rows instead of what it held; readers find one or the other.  Returns how many they are."""
        state, path = self.log.state(), f"{self.folder}/{uuid.uuid4().hex}"
        parts = sorted_files.write(rows, path, self.key, ranged=True, order=self.order, file_rows=RANGE_ROWS)
        self.log.put(state, [{"path": path, "parts": [{k: p[k] for k in ("name", "rows")} for p in parts], "schema": rows.schema.json()}], list(state.files))
        return sum(p["rows"] for p in parts)

    def _entry(self) -> dict:
        files = list(self.log.state().files.values())
        if not files:
            raise LookupError(f"nothing is written to {self.folder}")
        return files[0]

    def total(self) -> int:
        return sum(p["rows"] for p in self._entry()["parts"])

    def page(self, limit: int, offset: int) -> DataFrame:
        """The rows from ``offset`` on in the table's order; none past the end."""
        entry, before, chosen, skip = self._entry(), 0, [], 0
        schema = StructType.fromJson(json.loads(entry["schema"]))
        for p in entry["parts"]:
            if before + p["rows"] > offset and before < offset + limit:
                if not chosen:
                    skip = offset - before
                chosen.append(f"{entry['path']}/{p['name']}")
            before += p["rows"]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen).orderBy(*self.order).offset(skip).limit(limit)
