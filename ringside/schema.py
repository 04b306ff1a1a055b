"""Tables, columns and domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Domains, in their order.
CORNERS = ["red", "blue"]
METHODS = ["ko_tko", "submission", "decision", "dq", "no_contest"]
FINISHES = ["ko_tko", "submission"]
STANCES = ["orthodox", "southpaw", "switch"]
RESULTS = ["win", "loss", "draw", "no_contest"]

BASE_STATS = ["knockdowns", "sig_strikes_landed", "sig_strikes_attempted", "takedowns_landed", "takedowns_attempted", "submission_attempts", "control_time_seconds"]
SPLIT_KINDS = ["total_strikes", "head", "body", "leg", "distance", "clinch", "ground"]
SPLIT_STATS = [f"{kind}_{what}" for kind in SPLIT_KINDS for what in ("landed", "attempted")] + ["reversals"]
STATS = BASE_STATS + SPLIT_STATS

LONG_FRAME = ["fighter_id", "fighter_name", "event_id", "event_name", "event_date", "bout_id", "corner", "result", "method", "round", "ending_time_seconds", *STATS, "source"]

# What never becomes a feature: identity, context, and the outcome of the bout itself.
IDENTITY = {"bout_id", "fighter_id", "fighter_name"}
CONTEXT = {"event_id", "event_name", "event_date", "source"}
OUTCOME = {"result", "method", "round", "ending_time_seconds", *STATS}
NO_FEATURES = IDENTITY | CONTEXT | OUTCOME


# Schemas are DDL texts.
_STATS = ", ".join(f"{s} int" for s in STATS)

FIGHTERS = "id int, name string, name_normalized string, nickname string, date_of_birth date, height_cm int, reach_cm int, stance string, weight_kg double, wins int, losses int, draws int, source string"
EVENTS = "id int, name string, date date, location string, source string"
BOUTS = "id int, event_id int, winner_id int, method string, round int, ending_time_seconds int, weight_class string, title_bout boolean, scheduled_rounds int, referee string, source string"
BOUT_FIGHTERS = f"id int, bout_id int, fighter_id int, corner string, {_STATS}, source string"
ROUNDS = f"id int, bout_fighter_id int, round int, {_STATS}, source string"
BOUT_FEATURES = "bout_id long, features string, target_winner_corner string, source string, generated_at timestamp"


@dataclass(frozen=True)
class Tables:
    """The five granular tables; ids may be of any integer type."""

    fighters: DataFrame
    events: DataFrame
    bouts: DataFrame
    bout_fighters: DataFrame
    rounds: DataFrame


# Nested documents of the JSON sources.
_LINE = (
    "boutId string, corner string, fighterSlug string, knockdowns int, submissionAttempts int, reversals int, sigStrikes string, head string, body string, leg string, "
    "distance string, clinch string, ground string, takedowns string, controlTime string"
)
EVENT_DOCUMENT = "event_id string, name string, date date, bouts array<struct<bout_id:string,method:string,finish_round:int,finish_time_seconds:int,weight_class:string,winner_slug:string,corners:array<struct<slug:string,name:string>>>>"
BOUT_STATS_DOCUMENT = "bout_id string, fighters array<struct<corner:string,fighter_slug:string," + ",".join(f"{s}:int" for s in BASE_STATS) + ">>"
FIGHTER_DOCUMENT = "slug string, name string, date_of_birth date, nickname string, height_cm int, reach_cm int, stance string, wins int, losses int, draws int"
EVENT_STATS_DOCUMENT = f"success boolean, data struct<boutStats:array<struct<{_LINE.replace(' ', ':').replace(',:', ',')}>>,roundStats:array<struct<{_LINE.replace(' ', ':').replace(',:', ',')},round:int>>>"


def empty_tables(spark) -> Tables:
    return Tables(*[spark.createDataFrame([], ddl) for ddl in (FIGHTERS, EVENTS, BOUTS, BOUT_FIGHTERS, ROUNDS)])
