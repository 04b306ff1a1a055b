"""Search of names by parts of them, over an inverted index of their grams.

    folder/<write>/    (gram, name, id) for each run of one to three characters of each name in lower case, sorted by gram, name and id
    folder/_log        the files with their grams' ranges (commits.py)

A pattern's literal parts are cut into grams of three characters; a part of one or two is a gram by itself.  A name that matches holds all of
them, so what the rarest ones have in common are the candidates, and each candidate is compared with the whole pattern.  Only files with
these grams are opened: what is read is in proportion to the shortest lists, not to the names.  A pattern of wildcards only has no gram and
reads the list of names itself.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.sources import sorted_files
from ringside.sources.commits import CommitLog

POSTINGS = "gram string, name string, id long"
#: Lists that are looked at: the shortest ones of a pattern.
LISTS = 3
#: Rows of a file of lists at most.
RANGE_ROWS = 100_000


def grams_of(pattern: str) -> list[str]:
    """The grams that every name matching a pattern holds; % and _ are wildcards, a backslash makes the next character literal."""
    parts, part, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            part, i = part + pattern[i + 1], i + 2
            continue
        if c in "%_":
            parts.append(part)
            part = ""
        else:
            part += c
        i += 1
    found = {g for p in [*parts, part] for g in ([p[k : k + 3] for k in range(len(p) - 2)] or ([p] if p else []))}
    return sorted(found)


class NameIndex:
    """The empty gram stands for every name, so its list is the list of names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)

    def write(self, names: DataFrame) -> None:
        """Index (id, name) rows in place of what is indexed; null names match nothing."""
        low = F.lower("name")
        at = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        grams = F.array_distinct(F.concat(F.array(F.lit("")), at(1), at(2), at(3)))
        rows = names.filter("name is not null").select(F.explode(grams).alias("gram"), "name", F.col("id").cast("long").alias("id"))
        state, path = self.log.state(), f"{self.folder}/{uuid.uuid4().hex}"
        parts = sorted_files.write(rows, path, "gram", ranged=True, order=["gram", "name", "id"], file_rows=RANGE_ROWS)
        self.log.put(state, [{"path": path, "parts": parts}], list(state.files))

    def _files(self, grams: list[str]) -> list[str]:
        return [f"{f['path']}/{p['name']}" for f in self.log.state().files.values() for p in sorted_files.choose(f["parts"], grams)]

    def _lists(self, grams: list[str]) -> DataFrame:
        paths = self._files(grams)
        rows = self.spark.read.schema(POSTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], POSTINGS)
        return rows.filter(F.col("gram").isin(grams))

    def _span(self, gram: str) -> int:
        """Rows of the files that may hold a gram: what its list costs to read, known from the log."""
        return sum(p["rows"] for f in self.log.state().files.values() for p in sorted_files.choose(f["parts"], [gram]))

    def search(self, text: str | None) -> DataFrame:
        """(id, name) of the names that contain ``text`` in any case, as reads.named(); none or an empty one matches all."""
        pattern = f"%{text or ''}%"
        grams = sorted(grams_of(self._lowered(pattern)), key=lambda g: (self._span(g), -len(g), g))[:LISTS] or [""]
        lists = self._lists(grams)
        if len(grams) > 1:
            lists = lists.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        return lists.filter(F.col("name").ilike(pattern)).select("id", "name")

    def _lowered(self, text: str) -> str:
        """In lower case as Spark has it; equal to Python's for ASCII, which needs no job."""
        return text.lower() if re.fullmatch(r"[\x00-\x7f]*", text) else self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
