"""Registered queries that read indexes and stored states instead of whole tables."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.name_index import NameIndex
from ringside.operators.prefix import running_sums
from ringside.plans import features, matchup, reads, state
from ringside.plans.longframe import long_frame
from ringside.queries import _LABELLED, _ON, _PIVOT, _T, MAIN, _labelled, query
from ringside.schema import Tables
from ringside.sources.scratch import shared_dir, stored


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.fighters.sparkSession)}/{name}-{uuid.uuid4().hex}"


_SEARCHES = ["1", "00_1", "pplier#0000000%5", "r#", "no such name", "%"]


@query(" UNION ALL ".join(f"SELECT '{s}' AS asked, id, name FROM fighters WHERE name ILIKE '%{s}%'" for s in _SEARCHES))
def name_search(t: Tables) -> DataFrame:
    """All fighters whose names match some patterns, by an index of grams."""
    index = NameIndex(t.fighters.sparkSession, _folder(t, "names"))
    index.write(t.fighters.select("id", "name"))
    return functools.reduce(DataFrame.union, [reads.named(t.fighters, s, index).select(F.lit(s).alias("asked"), "id", "name") for s in _SEARCHES])


_OFFSETS = [0, 24, 1000, 100_000_000]


@query(" UNION ALL ".join(f"SELECT {o} AS skipped, (SELECT CAST(count(*) AS BIGINT) FROM events_) AS total, id, CAST(date AS VARCHAR) AS date FROM (SELECT * FROM events_ ORDER BY date DESC, id DESC LIMIT 24 OFFSET {o})" for o in _OFFSETS))
def deep_event_pages(t: Tables) -> DataFrame:
    """Pages of events, newest first, at any offset, each from one range of the ordered table."""
    pages = reads.event_pages(t.events.sparkSession, _folder(t, "pages"))
    pages.write(t.events)
    found = [reads.list_events(t, 24, o, pages) for o in _OFFSETS]
    return functools.reduce(DataFrame.union, [p.items.select(F.lit(p.offset).alias("skipped"), F.lit(p.total).cast("long").alias("total"), "id", F.col("date").cast("string").alias("date")) for p in found])


@query(_LABELLED + MAIN + "SELECT bout_id, CAST(k - 1 AS BIGINT) AS one_before, CAST(coalesce(sum(label) OVER (ORDER BY event_date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS label_before FROM cut")
def running_counts(t: Tables) -> DataFrame:
    """How many decided bouts, and how many wins of red, are before each in order of date and id."""
    rows = _labelled(t).select("bout_id", "event_date", "label", F.lit(1).cast("long").alias("one"))
    return running_sums(rows, ["event_date", "bout_id"], ["one", "label"]).select("bout_id", "one_before", "label_before")


_LAST = "1998-01-01"


@query(_PIVOT + MAIN + f"SELECT a.bout_id, CASE {_T} WHEN 'R' THEN 'red' ELSE 'blue' END AS target_winner_corner, CAST(a.win_rate_prior AS DOUBLE) AS win_rate_prior_a, CAST(b.win_streak_prior AS DOUBLE) AS win_streak_prior_b, CAST(a.layoff_days - b.layoff_days AS DOUBLE) AS layoff_days_diff, CAST(a.sig_strikes_landed_pm_r3 AS DOUBLE) AS sig_strikes_landed_pm_r3_a{_ON} WHERE {_T} IS NOT NULL")
def sink_after_events(t: Tables) -> DataFrame:
    """Stored matchups after the earlier bouts were taken up, and then all later ones: as many and the same as of a full recompute."""
    spark = t.bouts.sparkSession
    frame, shares = long_frame(t).select(*features.LOOKED_AT, "corner"), features.corner_shares(t)
    rows = stored(features.prepared(frame, shares), "prepared")  # corners, bouts and rounds meet once for both
    states, sink = state.state_store(spark, _folder(t, "states")), matchup.feature_store(spark, _folder(t, "matchups"))
    earlier = F.col("event_date") < F.lit(_LAST).cast("date")
    for own in (earlier, ~earlier):
        state.take_up(states, sink, frame.filter(own), t.fighters, shares, source="tables", rows=rows.filter(own))
    values = ["win_rate_prior_a", "win_streak_prior_b", "layoff_days_diff", "sig_strikes_landed_pm_r3_a"]
    return sink.read().withColumn("f", F.from_json("features", ", ".join(f"{c} double" for c in values))).select("bout_id", "target_winner_corner", *[f"f.{c}" for c in values])
