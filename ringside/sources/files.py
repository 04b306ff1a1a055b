"""CSV and JSON sources."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.functions.expr import clock_text, parse_clock, parse_stat, stat_text
from ringside.schema import BOUT_STATS_DOCUMENT, EVENT_DOCUMENT, EVENT_STATS_DOCUMENT, FIGHTER_DOCUMENT

#: File names of the CSV data set.
FIGHTER_FILE, EVENT_FILE, FIGHT_FILE = "fighter_details.csv", "event_details.csv", "fight_details.csv"
ORDINAL = "__row"


def dataset_dir(given: str | None, env: str | None = None) -> str:
    """The folder of the data set: the one given, else the one in the environment variable ``env``."""
    found = given or (os.environ.get(env) if env else None)
    if not found:
        raise ValueError("no folder of the data set is given")
    return found


def read_csv(spark: SparkSession, path: str, line_ends_in_fields: bool = False) -> DataFrame:
    """All columns as text, an empty field as an empty text, and the row's ordinal in ORDINAL.

    First-wins and last-wins rules depend on the order of rows in a file: the ordinal is taken from the scan, which numbers rows by
    partition and place, and partitions of one file follow one another.  Files with line ends inside fields can't be divided: they
    are read by one task each, and only if the caller says so.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=line_ends_in_fields)
    return df.na.fill("").withColumn(ORDINAL, F.monotonically_increasing_id())


def fighter_details(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{FIGHTER_FILE}")


def event_details(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{EVENT_FILE}")


def fight_details(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{FIGHT_FILE}")


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def event_documents(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, event_name, event_date, bout) with a row for each bout."""
    return _json(spark, path, EVENT_DOCUMENT).select("event_id", F.col("name").alias("event_name"), F.col("date").alias("event_date"), F.explode("bouts").alias("bout"))


def fighter_documents(spark: SparkSession, path: str) -> DataFrame:
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("wins", "losses", "draws")}
    return _json(spark, path, FIGHTER_DOCUMENT).withColumns(counts)


def bout_stats_documents(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, BOUT_STATS_DOCUMENT).select("bout_id", F.explode("fighters").alias("f")).select("bout_id", "f.*")


_PAIRS = {"sigStrikes": "sig_strikes", "takedowns": "takedowns", "head": "head", "body": "body", "leg": "leg", "distance": "distance", "clinch": "clinch", "ground": "ground"}


def _line(c: str) -> list:
    own = [F.col(f"{c}.boutId").alias("bout_id"), F.col(f"{c}.corner").alias("corner"), F.col(f"{c}.fighterSlug").alias("fighter_slug")]
    own += [F.col(f"{c}.knockdowns").alias("knockdowns"), F.col(f"{c}.submissionAttempts").alias("submission_attempts"), F.col(f"{c}.reversals").alias("reversals"), parse_clock(F.col(f"{c}.controlTime")).alias("control_time_seconds")]
    for wire, name in _PAIRS.items():
        pair = parse_stat(F.col(f"{c}.{wire}"))
        own += [pair["landed"].alias(f"{name}_landed"), pair["attempted"].alias(f"{name}_attempted")]
    return own


def event_stats_documents(spark: SparkSession, path, rounds: bool = False, with_file: str | None = None) -> DataFrame:
    """Statistics lines by bout and corner, or by round as well.  A document without success raises.

    with_file: a column for the name of each line's file.
    """
    docs = _json(spark, path, EVENT_STATS_DOCUMENT)
    if with_file:
        docs = docs.withColumn(with_file, F.element_at(F.split(F.input_file_name(), "/"), -1))
    good = docs.filter(F.when(F.coalesce("success", F.lit(False)), True).otherwise(F.raise_error(F.lit("the document reports no success")).cast("boolean")))
    which = "data.roundStats" if rounds else "data.boutStats"
    own = [with_file] if with_file else []
    lines = good.select(*own, F.explode(which).alias("l"))
    return lines.select(*own, *_line("l"), *([F.col("l.round").alias("round")] if rounds else []))


def event_stats_checked(spark: SparkSession, paths: list[str], file_column: str, rounds: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, faults): as event_stats_documents(), with the name of each line's file, and (file, fault) of the documents that can't be read or report no success."""
    docs = spark.read.schema(EVENT_STATS_DOCUMENT + ", __faulty string").json(paths, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__faulty")
    docs = docs.withColumn(file_column, F.element_at(F.split(F.input_file_name(), "/"), -1))
    fault = F.when(F.col("__faulty").isNotNull(), "the document can't be read").when(~F.coalesce("success", F.lit(False)), "the document reports no success")
    docs = docs.select(file_column, "data", fault.alias("fault"))
    lines = docs.filter("fault is null").select(file_column, F.explode("data.roundStats" if rounds else "data.boutStats").alias("l"))
    return lines.select(file_column, *_line("l"), *([F.col("l.round").alias("round")] if rounds else [])), docs.filter("fault is not null").select(file_column, "fault")


def to_wire(lines: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Statistics lines in the text forms of the documents.  kept: columns that stay as they are."""
    pairs = [stat_text(F.col(f"{n}_landed"), F.col(f"{n}_attempted")).alias(w) for w, n in _PAIRS.items()]
    rest = [F.col("bout_id").alias("boutId"), "corner", F.col("fighter_slug").alias("fighterSlug"), "knockdowns", F.col("submission_attempts").alias("submissionAttempts"), "reversals", clock_text(F.col("control_time_seconds")).alias("controlTime")]
    return lines.select(*(kept or []), *rest, *pairs, *(["round"] if "round" in lines.columns else []))


class BudgetSpent(RuntimeError):
    """No calls are left."""


@dataclass
class CallBudget:
    """A hard cap on calls, charged before each."""

    most: int = 500
    used: int = 0

    def charge(self) -> None:
        if self.used >= self.most:
            raise BudgetSpent(f"the budget of {self.most} calls is used up")
        self.used += 1


def call_budget(given: int | None = None, env: str | None = None) -> CallBudget:
    """The cap given, else that of the environment variable ``env``, else the usual one."""
    raw = os.environ.get(env) if env else None
    if given is None and raw:
        try:
            given = int(raw)
        except ValueError:
            raise ValueError(f"{env}={raw!r} is no number of calls") from None
    return CallBudget() if given is None else CallBudget(given)


class LandingZone:
    """Documents kept by key in a folder: fetched once, read from there afterwards."""

    def __init__(self, spark: SparkSession, folder: str, budget: CallBudget | None = None):
        self.spark, self.folder, self.budget = spark, folder.rstrip("/"), budget

    def _at(self, key: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def holds(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.exists(path)

    def get_or_fetch(self, key: str, fetch) -> str:
        """The path of the document; ``fetch`` returns its JSON text.  A fetch that fails leaves nothing behind."""
        fs, path = self._at(key)
        if not fs.exists(path):
            if self.budget is not None:
                self.budget.charge()
            text = fetch(key)
            part = path.suffix(".part")
            out = fs.create(part, True)
            out.write(bytearray(text.encode()))
            out.close()
            fs.rename(part, path)
        return str(path)


class SourceError(RuntimeError):
    """A source can't give a document."""


class OverLimit(SourceError):
    """A source refuses further calls for now."""


def checked_response(status: int, body: str) -> str:
    """The body of a source's answer, by its HTTP status; another one than 200 raises."""
    if status == 429:
        raise OverLimit("too many calls")
    if status != 200:
        raise SourceError(f"the source answers with status {status}")
    return body
