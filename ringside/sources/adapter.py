"""The granular tables made of order tables, for benchmarks and checks.

Orders are bouts, suppliers are fighters, and the line items of a supplier in an order are what a fighter did in a bout.  The first
two suppliers of an order are the red and the blue corner; orders with one supplier are no bouts.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.schema import SPLIT_STATS, STATS, Tables
from ringside.sources.scratch import exists, shared_dir

EPOCH = "1990-01-01"


def _stat_columns() -> dict[str, Column]:
    q, flag, line = F.col("q"), F.col("l_returnflag"), F.col("ln")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    total = lambda c: F.sum(F.when(c, q).otherwise(0))
    out = {
        "knockdowns": count(flag == "R"),
        "sig_strikes_landed": total(F.col("l_linestatus") == "F"),
        "sig_strikes_attempted": F.sum(q),
        "takedowns_landed": count(flag == "A"),
        "takedowns_attempted": F.count(F.lit(1)) + count(q % 3 == 0),
        "submission_attempts": count(line == 1),
        "control_time_seconds": F.sum(line * q),
        "total_strikes_landed": total(q % 2 == 0),
        "total_strikes_attempted": F.sum(q) + F.count(F.lit(1)),
        "reversals": count(line == 7),
    }
    for i, kind in enumerate(("head", "body", "leg")):
        out |= {f"{kind}_landed": total(line % 3 == i), f"{kind}_attempted": total(line % 3 == i) + F.count(F.lit(1))}
    for kind, f in (("distance", "N"), ("clinch", "A"), ("ground", "R")):
        out |= {f"{kind}_landed": total(flag == f), f"{kind}_attempted": total(flag == f) + F.count(F.lit(1))}
    return out


def _measured(df: DataFrame) -> DataFrame:
    """Stats as integers; the splits of every seventh bout are unknown."""
    unknown = F.col("bout_id") % 7 == 0
    return df.withColumns({s: F.when(~unknown, F.col(s).cast("int")) if s in SPLIT_STATS else F.col(s).cast("int") for s in STATS})


#: Folders of tables that a session has written, by the files of the order tables.
_written: dict[tuple, str] = {}

INPUTS = ["lineitem", "orders", "supplier"]

#: Rows of the largest table that a shuffle's task should have at most before small ones are joined, and MB that joined ones should have.
#: A shuffled row of statistics takes some 20 bytes and ten times as much while it is grouped or sorted.
TASK_ROWS, TASK_MB = 250_000, 8
SIZE, NUMBER = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Numbers of partitions that small_tasks() has set, by session.
_numbers: dict[str, str] = {}


def small_tasks(spark: SparkSession, rows: int) -> None:
    """Let shuffles have tasks of a size that doesn't grow with the tables, of which the largest has ``rows``; what the user has set stays.

    Spark's defaults are a fixed number of partitions, and 64 MB of compressed rows for joined ones, which are gigabytes in memory here.
    """
    own = spark.sparkContext.applicationId
    if spark.conf.get(SIZE, None) is None:
        spark.conf.set(SIZE, f"{TASK_MB}m")
    if spark.conf.get(NUMBER, None) == _numbers.get(own):  # not set, or set here for other tables
        number = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)))
        spark.conf.set(NUMBER, number)
        _numbers[own] = number


def _files(spark: SparkSession, path: str) -> list[tuple]:
    """Name, size and time of each file of a table: other ones are another table."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(here))


def read(spark: SparkSession, sf_dir: str) -> Tables:
    """The five tables, which are made once for a session and the files of the order tables, and kept as Parquet files in the shared folder.

    Queries then read only the columns that they need of files whose sizes Spark knows, as of any stored tables.
    """
    small_tasks(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())  # of the files' footers
    key = (spark.sparkContext.applicationId, *(f for n in INPUTS for f in _files(spark, f"{sf_dir}/{n}.parquet")))
    if key not in _written or not exists(spark, f"{_written[key]}/rounds/_SUCCESS"):  # the shared folder may have been cleared
        folder = f"{shared_dir(spark)}/granular-{uuid.uuid4().hex}"
        made = derive(spark, sf_dir)
        # Bouts and rounds are made of the corners, so these are written first and read again.
        corners = _stored(made.bout_fighters, f"{folder}/bout_fighters")
        made = derive(spark, sf_dir, corners)
        for name in ("fighters", "events", "bouts", "rounds"):
            getattr(made, name).write.parquet(f"{folder}/{name}")
        _written[key] = folder
    folder = _written[key]
    return Tables(*[spark.read.parquet(f"{folder}/{f.name}") for f in dataclasses.fields(Tables)])


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derive(spark: SparkSession, sf_dir: str, stored: DataFrame | None = None) -> Tables:
    """The five tables.  Line items move once, by order; corners, stats and winners are computed where they then are.

    stored: the table bout_fighters, if it is there already.
    """
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    stats = _stat_columns()
    lines = table("lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_linestatus").repartition("bout_id")
    orders = table("orders")
    by_bout = Window.partitionBy("bout_id").orderBy("fighter_id")
    whole = Window.partitionBy("bout_id")
    corners = lines.groupBy("bout_id", "fighter_id").agg(*[c.alias(s) for s, c in stats.items()])
    corners = corners.withColumn("seat", F.row_number().over(by_bout)).withColumn("seats", F.count(F.lit(1)).over(whole)).filter("seat <= 2 and seats >= 2")
    corners = _measured(corners).withColumn("corner", F.when(F.col("seat") == 1, "red").otherwise("blue"))
    if stored is not None:
        corners = stored.withColumn("seat", F.when(F.col("corner") == "red", 1).otherwise(2))
    bout_fighters = corners.select((F.col("bout_id") * 2 + F.col("seat") - 1).alias("id"), "bout_id", "fighter_id", "corner", *STATS, F.lit("tables").alias("source"))
    # A bout's winner landed more.
    landed = lambda seat: F.max(F.when(F.col("seat") == seat, F.col("sig_strikes_landed")))
    who = lambda seat: F.max(F.when(F.col("seat") == seat, F.col("fighter_id")))
    ends = corners.groupBy("bout_id").agg(landed(1).alias("r"), landed(2).alias("b"), who(1).alias("red"), who(2).alias("blue"))
    priority = F.substring("o_orderpriority", 1, 1)
    method = F.when(priority == "1", "ko_tko").when(priority == "2", "submission").when(priority == "3", "decision").when(priority == "4", "dq").otherwise("no_contest")
    day = F.col("o_orderdate").cast("date")
    bouts = orders.select(F.col("o_orderkey").alias("bout_id"), day.alias("day"), method.alias("method"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("round"), (F.floor("o_totalprice") % 301).cast("int").alias("ending_time_seconds"), F.col("o_orderstatus").alias("status"), F.col("o_custkey"))
    bouts = bouts.join(ends, "bout_id").select(
        F.col("bout_id").alias("id"),
        F.datediff("day", F.lit(EPOCH).cast("date")).alias("event_id"),
        F.when(F.col("method") == "no_contest", None).when(F.col("r") > F.col("b"), F.col("red")).when(F.col("b") > F.col("r"), F.col("blue")).alias("winner_id"),
        "method",
        "round",
        "ending_time_seconds",
        F.concat(F.lit("class "), (F.col("o_custkey") % 8).cast("string")).alias("weight_class"),
        (F.col("status") == "F").alias("title_bout"),
        F.when(F.col("status") == "P", None).otherwise(F.lit(5)).alias("scheduled_rounds"),
        F.lit(None).cast("string").alias("referee"),
        F.lit("tables").alias("source"),
    )
    days = orders.select(day.alias("date")).distinct()
    events = days.select(F.datediff("date", F.lit(EPOCH).cast("date")).alias("id"), F.concat(F.lit("Event "), F.col("date").cast("string")).alias("name"), "date", F.lit(None).cast("string").alias("location"), F.lit("tables").alias("source"))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    fighters = table("supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("name_normalized"),
        F.lit(None).cast("string").alias("nickname"),
        F.date_add(F.lit("1970-01-01").cast("date"), (key * 37 % 9000).cast("int")).alias("date_of_birth"),
        (key % 50 + 150).cast("int").alias("height_cm"),
        F.when(key % 5 != 0, (key % 55 + 150).cast("int")).alias("reach_cm"),
        F.when(nation % 4 == 0, "orthodox").when(nation % 4 == 1, "southpaw").when(nation % 4 == 2, "switch").alias("stance"),
        F.lit(None).cast("double").alias("weight_kg"),
        (key % 20).cast("int").alias("wins"),
        (key % 7).cast("int").alias("losses"),
        (key % 3).cast("int").alias("draws"),
        F.lit("tables").alias("source"),
    )
    # A round's lines meet the two of their bout by the bout alone, as they lie, so statistics don't move once more.
    pairs = corners.groupBy("bout_id").agg(who(1).alias("red"), who(2).alias("blue"))
    own = lines.join(pairs, "bout_id").withColumn("seat", F.when(F.col("fighter_id") == F.col("red"), 1).when(F.col("fighter_id") == F.col("blue"), 2)).filter("seat is not null")
    per_round = _measured(own.groupBy("bout_id", "seat", "ln").agg(*[c.alias(s) for s, c in stats.items()]))
    rounds = per_round.select((F.col("bout_id") * 20 + F.col("seat") * 10 + F.col("ln")).alias("id"), (F.col("bout_id") * 2 + F.col("seat") - 1).alias("bout_fighter_id"), F.col("ln").alias("round"), *STATS, F.lit("tables").alias("source"))
    return Tables(fighters, events, bouts, bout_fighters, rounds)


def sql() -> str:
    """The same tables as DuckDB common table expressions (without WITH)."""
    count = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    total = lambda c: f"sum(CASE WHEN {c} THEN q ELSE 0 END)"
    s = {
        "knockdowns": count("rf = 'R'"), "sig_strikes_landed": total("ls = 'F'"), "sig_strikes_attempted": "sum(q)", "takedowns_landed": count("rf = 'A'"),
        "takedowns_attempted": f"count(*) + {count('q % 3 = 0')}", "submission_attempts": count("ln = 1"), "control_time_seconds": "sum(ln * q)",
        "total_strikes_landed": total("q % 2 = 0"), "total_strikes_attempted": "sum(q) + count(*)", "reversals": count("ln = 7"),
    }
    for i, kind in enumerate(("head", "body", "leg")):
        s |= {f"{kind}_landed": total(f"ln % 3 = {i}"), f"{kind}_attempted": total(f"ln % 3 = {i}") + " + count(*)"}
    for kind, f in (("distance", "N"), ("clinch", "A"), ("ground", "R")):
        s |= {f"{kind}_landed": total(f"rf = '{f}'"), f"{kind}_attempted": total(f"rf = '{f}'") + " + count(*)"}
    own = lambda: ", ".join(f"CASE WHEN bout_id % 7 = 0 THEN NULL ELSE CAST({e} AS INTEGER) END AS {n}" if n in SPLIT_STATS else f"CAST({e} AS INTEGER) AS {n}" for n, e in ((n, s[n]) for n in STATS))
    names = ", ".join(STATS)
    return f"""
li AS (SELECT l_orderkey AS bout_id, l_suppkey AS fighter_id, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
c0 AS (SELECT bout_id, fighter_id, {own()} FROM li GROUP BY bout_id, fighter_id),
c1 AS (SELECT *, row_number() OVER (PARTITION BY bout_id ORDER BY fighter_id) AS seat, count(*) OVER (PARTITION BY bout_id) AS seats FROM c0),
corners AS (SELECT * FROM c1 WHERE seat <= 2 AND seats >= 2),
bout_fighters AS (SELECT CAST(bout_id * 2 + seat - 1 AS BIGINT) AS id, bout_id, fighter_id, CASE WHEN seat = 1 THEN 'red' ELSE 'blue' END AS corner, {names}, 'tables' AS source FROM corners),
ends AS (SELECT bout_id, max(CASE WHEN seat = 1 THEN sig_strikes_landed END) AS r, max(CASE WHEN seat = 2 THEN sig_strikes_landed END) AS b, max(CASE WHEN seat = 1 THEN fighter_id END) AS red, max(CASE WHEN seat = 2 THEN fighter_id END) AS blue FROM corners GROUP BY bout_id),
o1 AS (SELECT o_orderkey AS bout_id, CAST(o_orderdate AS DATE) AS day, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ko_tko' WHEN '2' THEN 'submission' WHEN '3' THEN 'decision' WHEN '4' THEN 'dq' ELSE 'no_contest' END AS method, CAST(o_orderkey % 5 + 1 AS INTEGER) AS round, CAST(CAST(floor(o_totalprice) AS BIGINT) % 301 AS INTEGER) AS ending_time_seconds, o_orderstatus AS status, o_custkey FROM orders),
bouts AS (SELECT bout_id AS id, CAST(date_diff('day', DATE '{EPOCH}', day) AS INTEGER) AS event_id, CASE WHEN method = 'no_contest' THEN NULL WHEN r > b THEN red WHEN b > r THEN blue END AS winner_id, method, round, ending_time_seconds, 'class ' || CAST(o_custkey % 8 AS VARCHAR) AS weight_class, status = 'F' AS title_bout, CASE WHEN status = 'P' THEN NULL ELSE 5 END AS scheduled_rounds, CAST(NULL AS VARCHAR) AS referee, 'tables' AS source FROM o1 JOIN ends USING (bout_id)),
events_ AS (SELECT DISTINCT CAST(date_diff('day', DATE '{EPOCH}', day) AS INTEGER) AS id, 'Event ' || CAST(day AS VARCHAR) AS name, day AS date, CAST(NULL AS VARCHAR) AS location, 'tables' AS source FROM o1),
fighters AS (SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', ' ')) AS name_normalized, CAST(DATE '1970-01-01' + CAST(s_suppkey * 37 % 9000 AS INTEGER) AS DATE) AS date_of_birth, CAST(s_suppkey % 50 + 150 AS INTEGER) AS height_cm, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 55 + 150 AS INTEGER) END AS reach_cm, CASE s_nationkey % 4 WHEN 0 THEN 'orthodox' WHEN 1 THEN 'southpaw' WHEN 2 THEN 'switch' END AS stance, CAST(s_suppkey % 20 AS INTEGER) AS wins, CAST(s_suppkey % 7 AS INTEGER) AS losses, CAST(s_suppkey % 3 AS INTEGER) AS draws, 'tables' AS source FROM supplier),
r0 AS (SELECT bout_id, fighter_id, ln, {own()} FROM li GROUP BY bout_id, fighter_id, ln),
rounds AS (SELECT bout_id * 20 + seat * 10 + ln AS id, CAST(bout_id * 2 + seat - 1 AS BIGINT) AS bout_fighter_id, ln AS round, {', '.join('r0.' + n for n in STATS)}, 'tables' AS source FROM r0 JOIN (SELECT bout_id, fighter_id, seat FROM corners) USING (bout_id, fighter_id))
"""
