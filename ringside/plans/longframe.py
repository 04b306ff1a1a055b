"""One row per fighter and bout, with what its corner did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.functions.expr import result_of
from ringside.operators.checks import assert_unique
from ringside.schema import LONG_FRAME, STATS, Tables


def long_frame(t: Tables, checked: bool = False) -> DataFrame:
    """Corners with their bouts, events and fighters, in the columns of LONG_FRAME.

    Corners without a bout, event or fighter are left out.  ``checked`` raises if an id of the other three stands twice.  Which
    sides are broadcast is left to the sizes that Spark finds.
    """
    bouts = t.bouts.select(F.col("id").alias("bout_id"), "event_id", "winner_id", "method", "round", "ending_time_seconds")
    events = t.events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), F.col("date").alias("event_date"))
    fighters = t.fighters.select(F.col("id").alias("fighter_id"), F.col("name").alias("fighter_name"))
    if checked:
        bouts, events, fighters = assert_unique(bouts, ["bout_id"], "bouts"), assert_unique(events, ["event_id"], "events"), assert_unique(fighters, ["fighter_id"], "fighters")
    rows = t.bout_fighters.select("bout_id", "fighter_id", "corner", *STATS, "source").join(bouts, "bout_id").join(events, "event_id").join(fighters, "fighter_id")
    return rows.withColumn("result", result_of(F.col("winner_id"), F.col("fighter_id"), F.col("method"))).select(*LONG_FRAME)


def round_rows(t: Tables) -> DataFrame:
    """(bout_id, fighter_id, round_number, sig_strikes_landed)."""
    corners = t.bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id", "fighter_id")
    return t.rounds.select("bout_fighter_id", F.col("round").alias("round_number"), "sig_strikes_landed").join(corners, "bout_fighter_id").select("bout_id", "fighter_id", "round_number", "sig_strikes_landed")
