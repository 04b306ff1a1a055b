"""What is known of each fighter after his or her last bout, so that an event costs its own rows.

A state holds what the features of the next bout look back on: counts for means and the streak, the last three bouts, and where they
end.  Features of new bouts come from states and the new rows alone; no old corner is read.  Rows that are not after a fighter's last
known bout can't be taken up that way: their fighters are named, and recomputed from their own corners.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.plans import matchup
from ringside.plans.features import FEATURES, OPPONENT, ORDER, POSITIONS, TARGETS, Frames, prepared, with_bio, with_form
from ringside.sources.keyed_store import KeyedStore
from ringside.sources.scratch import cut

#: Columns of the last three bouts.
SEEN = ["__seconds", "sig_strikes_landed", *[f"opp_{c}" for c in OPPONENT], "takedowns_landed", "control_time_seconds", *[f"{k}_landed" for k in TARGETS + POSITIONS], "round1_share"]
RECENT = f"array<struct<event_date:date,bout_id:bigint,{','.join(f'{c}:double' for c in SEEN)}>>"
COUNTS = ["bouts", "decided", "wins", "finishes", "last_win", "last_loss"]
STATE = f"fighter_id long, {', '.join(f'{c} long' for c in COUNTS)}, recent {RECENT}"


def state_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, path, STATE, "fighter_id", buckets)


def _carried(new: DataFrame, people: DataFrame, states: DataFrame) -> DataFrame:
    """New prepared rows with the last bouts of their fighters, ``people``, as rows with __old, and the states' counts as __base_*."""
    base = states.select(F.col("fighter_id"), *[F.col(c).alias(f"__base_{c}") for c in COUNTS], F.size("recent").cast("long").alias("__base_kept"))
    known = states.join(people, "fighter_id", "left_semi").select("fighter_id", F.explode("recent").alias("r")).select("fighter_id", "r.*")
    rows = new.withColumn("__old", F.lit(False)).unionByName(known.withColumn("__old", F.lit(True)), allowMissingColumns=True)
    zero = {f"__base_{c}": F.coalesce(f"__base_{c}", F.lit(0)) for c in [*COUNTS, "kept"]}
    return rows.join(base, "fighter_id", "left").withColumns(zero)


def _summary(rows: DataFrame, carried: bool) -> DataFrame:
    """The states of all fighters of prepared rows."""
    new = (lambda c: F.when(~F.col("__old"), c)) if carried else (lambda c: c)
    plus = (lambda n, c: F.first(F.col(f"__base_{n}")) + c) if carried else (lambda n, c: c)
    win, loss = F.col("result") == "win", F.col("result") == "loss"
    decided = F.when(win | loss, 1)
    by_time = Window.partitionBy("fighter_id").orderBy(*ORDER)
    before = F.col("__base_decided") if carried else F.lit(0)
    rows = rows.withColumns({
        "__n": before + F.count(new(decided)).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__from_last": F.row_number().over(Window.partitionBy("fighter_id").orderBy(*[F.col(c).desc() for c in ORDER])),
    })
    last = lambda n, c: F.coalesce(F.greatest(F.max(new(F.when(c, F.col("__n")))), F.first(F.col(f"__base_{n}")) if carried else F.lit(0)), F.lit(0))
    pack = F.struct(F.col("event_date"), F.col("bout_id").cast("long").alias("bout_id"), *[F.col(c).cast("double").alias(c) for c in SEEN])
    out = rows.groupBy("fighter_id").agg(
        plus("bouts", F.count(new(F.lit(1)))).alias("bouts"), plus("decided", F.count(new(decided))).alias("decided"), plus("wins", F.count(new(F.when(win, 1)))).alias("wins"),
        plus("finishes", F.count(new(F.when(win & F.col("method").isin("ko_tko", "submission"), 1)))).alias("finishes"), last("last_win", win).alias("last_win"), last("last_loss", loss).alias("last_loss"),
        F.array_sort(F.collect_list(F.when(F.col("__from_last") <= 3, pack))).alias("recent"),  # three rows a fighter
    )
    return out.selectExpr("cast(fighter_id AS bigint) AS fighter_id", *[f"cast({c} AS bigint) AS {c}" for c in COUNTS], "recent")


def states_of(frame: DataFrame, shares: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The states of a long frame's fighters, from all of their bouts.  shares: as of add_features().  rows: as of advance()."""
    return _summary(prepared(frame, shares) if rows is None else rows, carried=False)


@dataclass(frozen=True)
class Advance:
    """features: the new rows with FEATURES, but those of late fighters; states: the new states of the fighters in them; late: (fighter_id) of fighters
    that have a new row not after their last known bout."""

    features: DataFrame
    states: DataFrame
    late: DataFrame


def advance(states: DataFrame, frame: DataFrame, fighters: DataFrame, shares: DataFrame, rows: DataFrame | None = None) -> Advance:
    """Features of a long frame's rows, all of them new, and the states after them.  Both corners of a bout come together.

    rows: prepared() of them, where it is a table already.
    """
    ids = (frame if rows is None else rows).select("fighter_id", F.struct("event_date", F.col("bout_id").cast("long")).alias("__at"))  # without their preparation
    rows = prepared(frame, shares) if rows is None else rows
    last = states.select("fighter_id", F.element_at("recent", -1).alias("__last"))
    people = ids.groupBy("fighter_id").agg(F.min("__at").alias("__at"))  # a fighter's first new row tells whether any is late
    behind = F.col("__at") <= F.struct(F.col("__last.event_date"), F.col("__last.bout_id"))
    late = cut(people.join(last, "fighter_id").filter(behind).select("fighter_id"))  # few, as a table of known size: no row moves to be told
    people = people.select("fighter_id").join(late, "fighter_id", "left_anti")
    good = _carried(rows.join(late, "fighter_id", "left_anti"), people, states)
    formed = with_form(good, Frames(), Frames(), carried=True).filter(~F.col("__old"))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in frame.schema]  # the states' numbers are doubles
    return Advance(with_bio(formed, fighters).select(*typed, *FEATURES), _summary(good, carried=True), late)


def recomputed(late: DataFrame, history: DataFrame, shares: DataFrame, fighters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with FEATURES of all bouts of the late fighters, both corners, and these fighters' states), from their own and their opponents' bouts."""
    mine = cut(history.join(late, "fighter_id", "left_semi").select("bout_id").distinct())
    people = cut(history.join(mine, "bout_id", "left_semi").select("fighter_id").distinct())
    bouts = history.join(people, "fighter_id", "left_semi").select("bout_id").distinct()
    rows = prepared(cut(history.join(bouts, "bout_id", "left_semi")), shares)
    again = with_form(with_bio(rows.join(people, "fighter_id", "left_semi"), fighters), Frames(), Frames())
    return again.join(mine, "bout_id", "left_semi").select(*history.columns, *FEATURES), _summary(rows.join(late, "fighter_id", "left_semi"), carried=False)


def take_up(states: KeyedStore, features: KeyedStore, frame: DataFrame, fighters: DataFrame, shares: DataFrame, history: tuple[DataFrame, DataFrame] | None = None, source: str = "files", rows: DataFrame | None = None) -> int:
    """Bring stored states and stored matchups up to an event whose rows are ``frame``; returns how many matchups were upserted.

    Only the states of its fighters are read.  history: the long frame and the shares of all bouts, the new ones too; it is read for late
    fighters only, whose later matchups are upserted again.  Without it late fighters raise ValueError.  States are written last: a run
    that was killed between the two is repeated from the old states.  rows: as of advance().
    """
    rows = cut(prepared(frame, shares)) if rows is None else rows  # which is read for each of the three
    step = advance(cut(states.read_keys(rows.select("fighter_id"))), frame, fighters, shares, rows)
    late, rows, after = step.late, step.features, step.states
    if not late.isEmpty():
        if history is None:
            raise ValueError("bouts not after the last known ones of their fighters need all bouts of these")
        again, of_late = recomputed(late, *history, fighters)
        again = cut(again)
        rows = rows.join(again.select("bout_id").distinct(), "bout_id", "left_anti").unionByName(again.select(*rows.columns))
        after = after.unionByName(of_late)
    after = cut(after)
    made = matchup.matrix(rows.withColumn("bout_id", F.col("bout_id").cast("long")), parts=features.parts())
    done = features.upsert(matchup.payloads(made, source).withColumn("generated_at", F.current_timestamp()), placed=True)
    states.upsert(after)
    return done
