"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.sources.scratch import shared_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch between the JVM and Python, unless the session sets its own number; texts may be long.
BATCH_ROWS = 1000

#: Rows of a few numbers that a task should have at least.
TASK_ROWS = 20_000

#: Texts are handled in slices of about so many characters, which bounds what a Python worker holds at once.
SLICE_CHARS = 1_000_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it again.

    This cuts the lineage: what comes after reads files that survive the loss of any executor.  Where it is known that there are
    no more than about ``rows``, a table of few rows is made and written by few tasks; such a ``df`` has no Python function, which would
    hold memory for each partition that a task takes until the task ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)  # never more tasks than there would be
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows in an Arrow batch to BATCH_ROWS; a number set by the user stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % folds


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[list]:
    """Consecutive runs of ``texts`` of about ``limit`` characters each; one longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += 0 if t is None else len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


_kept: dict = {}


def kept(key: Hashable, build: Callable):
    """What ``build`` makes for ``key``, kept by the Python worker for its next tasks until a task asks for another key."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system: workers live on and share an executor's memory with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores in front of it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_struct(df: DataFrame, text_col: str, out: str, schema: str, make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """``df`` with the struct column ``out``, computed from ``text_col``.

    ``make`` runs once per task and returns a function from a list of texts (None for null) to the lists of the fields.
    All rows and other columns stay as they are; a column that already has the name ``out`` is replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = make()
        for batch in batches:
            texts = [None if isinstance(t, float) else t for t in batch.tolist()]
            cols: dict[str, list] = {n: [] for n in names}
            for part in slices(texts):
                for n, v in run(part).items():
                    cols[n].extend(v)
            yield pd.DataFrame({n: pd.Series(cols.pop(n), dtype=object) for n in names})
        del run
        give_back()

    # As if it weren't deterministic: otherwise a condition on a field, such as a join infers, would run the function once more.
    return df.withColumn(out, apply.asNondeterministic()(F.col(f"`{text_col}`")))


def with_fields(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """``df`` with the fields of with_struct() as columns; each replaces an older column of its name, all others stay."""
    struct = free_name("__fields", df)
    return spread(with_struct(df, text_col, struct, schema, make), struct)


def spread(df: DataFrame, struct: str) -> DataFrame:
    """Turn the fields of a struct column into columns; a field replaces an older column of its name."""
    fields = [f.name for f in df.schema[struct].dataType.fields]
    lower = {f.lower() for f in fields}  # Spark's names don't tell cases apart
    keep = [c for c in df.columns if c != struct and c.lower() not in lower]
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(struct)[f].alias(f) for f in fields])
