"""The matchup matrix: one row per decided bout, red against blue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.schema import BOUT_FEATURES, METHODS, NO_FEATURES, RESULTS, STANCES
from ringside.sources.keyed_store import KeyedStore

TARGET = "winner_corner"


@dataclass(frozen=True)
class Matrix:
    """frame: *_a of red, *_b of blue, *_diff, and TARGET; features: its feature columns."""

    frame: DataFrame
    features: list[str]


def pivot_corners(rows: DataFrame) -> DataFrame:
    """One row per bout with both corners: bout_id, then every other column but corner with suffix _a (red) and _b (blue).

    Corners meet in one aggregation by bout instead of a join of the frame with itself.  Columns are aggregated one by one, so those
    that nobody asks for are never moved, and numbers need no sorting.  A bout with two corners of a colour raises; one without either
    colour is left out.
    """
    texts = {f.name for f in rows.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))}
    columns = [c for c in rows.columns if c not in ("bout_id", "corner")]
    one = lambda c, side: f"{f'first(if(corner = {side!r}, `{c}`, null), true)' if c in texts else f'max(if(corner = {side!r}, `{c}`, null))'}"
    sides = [(s, side) for s, side in (("a", "red"), ("b", "blue"))]
    both = rows.groupBy("bout_id").agg(F.expr("count_if(corner = 'red')").alias("__reds"), F.expr("count_if(corner = 'blue')").alias("__blues"), *[F.expr(f"{one(c, side)} AS `{c}_{s}`") for s, side in sides for c in columns])
    single = F.expr("if(__reds > 1 OR __blues > 1, cast(raise_error(concat('two corners of one colour in bout ', cast(bout_id AS string))) AS boolean), __reds = 1 AND __blues = 1)")
    return both.filter(single).drop("__reds", "__blues")


#: Texts of few values, which are numbers while they move.
CODED = {"result": RESULTS, "method": METHODS, "stance": STANCES}


def _listed(values: list[str]) -> str:
    return f"array({', '.join(map(repr, values))})"


def coded(rows: DataFrame) -> DataFrame:
    """Columns of CODED as the places of their values; another value raises."""
    place = lambda c: f"CASE WHEN `{c}` IS NULL THEN NULL WHEN array_position({_listed(CODED[c])}, `{c}`) = 0 THEN cast(raise_error(concat('unknown {c} ', `{c}`)) AS int) ELSE cast(array_position({_listed(CODED[c])}, `{c}`) AS int) END AS `{c}`"
    return rows.selectExpr(*[place(c) if c in CODED else f"`{c}`" for c in rows.columns])


def decoded(pivoted: DataFrame) -> DataFrame:
    base = lambda c: c[:-2] if c.endswith(("_a", "_b")) else None
    text = lambda c: f"CASE `{c}` {' '.join(f'WHEN {i} THEN {v!r}' for i, v in enumerate(CODED[base(c)], 1))} END AS `{c}`"
    return pivoted.selectExpr(*[text(c) if base(c) in CODED else f"`{c}`" for c in pivoted.columns])


def feature_bases(schema: T.StructType) -> list[str]:
    """Bases with a number on both sides that are neither identity, context nor outcome, in column order."""
    kinds = {f.name: f.dataType for f in schema}
    number = lambda c: isinstance(kinds.get(c), (T.NumericType, T.BooleanType))
    return [c[:-2] for c in kinds if c.endswith("_a") and c[:-2] not in NO_FEATURES and number(c) and number(f"{c[:-2]}_b")]


def add_differentials(pivoted: DataFrame) -> DataFrame:
    return pivoted.selectExpr("*", *[f"`{b}_a` - `{b}_b` AS `{b}_diff`" for b in feature_bases(pivoted.schema)])


def target():
    """R or B by red's result; null for a draw or no contest."""
    return F.when(F.col("result_a") == "win", "R").when(F.col("result_a") == "loss", "B")


def feature_columns(columns: list[str]) -> list[str]:
    out = []
    for c in columns:
        base = next((c.removesuffix(s) for s in ("_diff", "_a", "_b") if c.endswith(s)), c)
        if c != TARGET and base not in NO_FEATURES:
            out.append(c)
    return out


def matrix(enriched: DataFrame, parts: int | None = None) -> Matrix:
    """Pivot, differences and target of an enriched long frame; bouts without a winner are left out.

    Rows, which lie by fighter, move by bout before corners meet: a bout's two are hardly ever in one task there, so that adding them up
    first would only move twice the columns.  parts: into how many parts they move; else as many as Spark makes.
    """
    moved = coded(enriched).repartition("bout_id") if parts is None else coded(enriched).repartition(parts, "bout_id")
    frame = add_differentials(decoded(pivot_corners(moved))).withColumn(TARGET, target())
    return Matrix(frame.filter(F.col(TARGET).isNotNull()), feature_columns(frame.columns))


def baseline(enriched: DataFrame) -> DataFrame:
    """(excluded_no_result, decided, red_corner_win_rate) of all paired bouts."""
    rows = pivot_corners(enriched.select("bout_id", "corner", "result")).select(target().alias("t"))
    return rows.agg(F.count_if(F.col("t").isNull()).alias("excluded_no_result"), F.count("t").alias("decided"), F.avg(F.when(F.col("t") == "R", 1.0).when(F.col("t") == "B", 0.0)).alias("red_corner_win_rate"))


def payloads(m: Matrix, source: str) -> DataFrame:
    """(bout_id, features, target_winner_corner, source): features as JSON with explicit nulls, NaN as null."""
    kinds = {f.name: f.dataType for f in m.frame.schema}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in m.features]
    corner = F.when(F.col(TARGET) == "R", "red").when(F.col(TARGET) == "B", "blue").otherwise(F.raise_error(F.lit("unknown corner")))
    return m.frame.select("bout_id", F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("features"), corner.alias("target_winner_corner"), F.lit(source).alias("source"))


def payload_schema(m: Matrix, names: list[str] | None = None) -> T.StructType:
    """The schema by which the features of payloads(), or those of the names, are read: doubles, truth values and texts."""
    kind = lambda t: T.DoubleType() if isinstance(t, T.NumericType) else t
    return T.StructType([T.StructField(c, kind(m.frame.schema[c].dataType)) for c in (m.features if names is None else names)])


def feature_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, path, BOUT_FEATURES, "bout_id", buckets)


def materialize(m: Matrix, path: str, source: str = "files") -> int:
    """Upsert the matrix into the feature store at ``path``; returns the number of rows upserted.

    Only the buckets of the matrix's bouts are written; readers find the state before or after, whole.
    """
    spark = m.frame.sparkSession
    return feature_store(spark, path).upsert(payloads(m, source).withColumn("generated_at", F.current_timestamp()))


def stored_features(spark: SparkSession, path: str) -> DataFrame:
    """The stored features: (bout_id, features, target_winner_corner, source, generated_at), one row a bout."""
    return feature_store(spark, path).read()
