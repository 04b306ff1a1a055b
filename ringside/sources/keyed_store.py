"""Rows by key in buckets: an upsert writes its own rows only, and reading takes the latest row of each key.

    folder/<write>/bucket=<b>/    the rows that one upsert has for a bucket
    folder/_log/<number>          which of these count, in their order (commits.py)

Readers see the state of one commit: all of an upsert or nothing.  Of a bucket with one set of files the rows are read as they are; of
buckets with several, keys are counted, and only rows of those that stand there more than once are grouped by key.  Once a bucket has more than MOST sets it is rewritten, alone, as one.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.sources.commits import CommitLog, Conflict, State
from ringside.sources.scratch import stored

#: Sets of files that a bucket may have before it is rewritten.
MOST = 8
#: So many rows are grouped by key without asking which keys stand there more than once.
FEW = 100_000


class KeyedStore:
    """schema: its columns as DDL; key: the column, a long, of which every value has one row.

    buckets: how many there are is fixed by the first upsert; later ones take that number.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema, self.key = schema, key
        self.log, self._buckets = CommitLog(spark, folder), buckets

    def _bucket(self, number: int) -> Column:
        return F.pmod(F.hash(self.key), F.lit(number))

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """The buckets of the keys; what passes through the driver is the buckets."""
        number = self.buckets(self.log.state())
        return {r[0] for r in keys.select(F.col(self.key).cast("long").alias(self.key)).select(self._bucket(number)).distinct().collect()}

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys, of which only the buckets are opened."""
        asked = keys.select(F.col(self.key).cast("long").alias(self.key)).distinct()
        return self.read(only=self.buckets_of(asked)).join(asked, self.key, "left_semi")

    def buckets(self, state: State) -> int:
        return state.most.get("buckets", self._buckets)

    def _sets(self, state: State) -> dict[int, list[str]]:
        """The sets of files of each bucket, oldest first."""
        out: dict[int, list[str]] = {}
        for path, f in state.files.items():
            out.setdefault(f["bucket"], []).append(path)
        return out

    @staticmethod
    def rows_of(state: State, paths: list[str]) -> int:
        return sum(state.files[p]["rows"] for p in paths)

    def parts(self) -> int:
        """Into how many parts rows are moved by their key, a long, to lie by buckets."""
        return self.buckets(self.log.state())

    def read(self, state: State | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows, one of each key; of some buckets only, if these are given."""
        state = state or self.log.state()
        sets = {b: s for b, s in self._sets(state).items() if only is None or b in only}
        if not sets:
            return self.spark.createDataFrame([], self.schema)
        load = lambda paths: self.spark.read.schema(self.schema).parquet(*paths)
        parts = []
        if clean := [s[0] for s in sets.values() if len(s) == 1]:
            parts.append(load(clean))
        if several := [s for s in sets.values() if len(s) > 1]:
            deep = max(map(len, several))
            stacked = functools.reduce(DataFrame.union, [load([s[i] for s in several if len(s) > i]).withColumn("__n", F.lit(i)) for i in range(deep)])
            if sum(self.rows_of(state, s) for s in several) > FEW:
                again = stored(stacked.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(self.key), "again")  # keys alone move
                parts.append(stacked.join(again, self.key, "left_anti").select(*[c for c in stacked.columns if c != "__n"]))
                stacked = stacked.join(again, self.key, "left_semi").select(*stacked.columns)
            columns = [c for c in stacked.columns if c not in (self.key, "__n")]
            latest = stacked.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.col("__n")).alias("r"))
            parts.append(latest.select(*[F.col(self.key) if c == self.key else F.col(f"r.{c}").alias(c) for c in stacked.columns if c != "__n"]))
        return functools.reduce(DataFrame.union, parts)

    def upsert(self, rows: DataFrame, placed: bool = False) -> int:
        """Insert rows of new keys and replace those of known ones; returns how many rows there are.  One row a key is expected.

        placed: rows come as repartition(parts(), key) has left them, a bucket in each task, and needn't move again.
        """
        state = self.log.state()
        number = self.buckets(state)
        empty = self.spark.createDataFrame([], self.schema)
        rows = empty.unionByName(rows, allowMissingColumns=True).to(empty.schema).withColumn("bucket", self._bucket(number))
        path = self._new_folder()
        added = self._write(rows, path, placed)
        if not added:
            self.log.delete(path)
            return 0
        while True:
            try:
                self.log.put(state, added, most={"buckets": number})
                break
            except Conflict:  # upserts follow one another in the order of their commits
                state = self.log.state()
                if self.buckets(state) != number:
                    done = self.upsert(self.spark.read.schema(self.schema).parquet(path))
                    self.log.delete(path)
                    return done
        self.compact()
        return sum(f["rows"] for f in added)

    def _new_folder(self) -> str:
        return f"{self.folder}/{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, path: str, placed: bool = False) -> list[dict]:
        """Write the rows, once, and return the log's entries for them, counted from the files."""
        rows = rows if placed else rows.repartition("bucket")
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each bucket
        return [{"path": f"{path}/bucket={b}", "bucket": b, "rows": n} for b, n in sorted((r["bucket"], r["n"]) for r in found)]

    def compact(self, most: int = MOST) -> list[int]:
        """Rewrite each bucket that has more than ``most`` sets of files; returns these buckets.

        Sets that others add meanwhile stay after the rewritten one; if another writer has rewritten the same ones, its work counts.
        """
        state = self.log.state()
        full = {b: s for b, s in self._sets(state).items() if len(s) > most}
        if not full:
            return []
        rows = self.read(state, set(full))
        path = self._new_folder()
        added = self._write(rows.withColumn("bucket", self._bucket(self.buckets(state))), path)
        old = [p for s in full.values() for p in s]
        while True:
            try:
                if not set(old) <= set(state.files):
                    raise LookupError
                # In place of the old sets, which are the first ones of their buckets: what has come after them is added again.
                later = [f for p, f in state.files.items() if f["bucket"] in full and p not in old]
                self.log.put(state, [*added, *later], [*old, *(f["path"] for f in later)])
                return sorted(full)
            except Conflict:
                state = self.log.state()
            except LookupError:
                self.log.delete(path)
                return []

    def vacuum(self, seconds: float = 7 * 86400, keep: int = 1) -> list[str]:
        return self.log.vacuum(seconds, keep)
