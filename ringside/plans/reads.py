"""What callers ask: lists, lookups, history, head-to-head, cards, details and statistics.

A missing id gives no rows.  Nested results are structs and arrays; arrays are in the order of corners (red first) and rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.functions.expr import corner_order, method_order, share
from ringside.operators.name_index import NameIndex
from ringside.operators.pages import PagedTable
from ringside.schema import METHODS, STATS, Tables

PAGE, LARGEST_PAGE = 50, 100


def page_bounds(limit: int = PAGE, offset: int = 0) -> tuple[int, int]:
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} items and starts at 0 or later")
    return limit, offset


@dataclass(frozen=True)
class Page:
    items: DataFrame
    matching: DataFrame
    limit: int
    offset: int

    known: int | None = None

    @property
    def total(self) -> int:
        """All that match, whatever the page."""
        return self.matching.count() if self.known is None else self.known


def named(fighters: DataFrame, name: str | None, index: NameIndex | None = None) -> DataFrame:
    """Fighters whose name contains ``name`` in any case; % and _ in it are wildcards, none or an empty one matches all.

    With an index of the names only the lists of the name's grams are read, and then the fighters with the ids that are found.
    """
    if not name:
        return fighters
    return fighters.join(index.search(name).select("id"), "id", "left_semi") if index else fighters.filter(F.col("name").ilike(f"%{name}%"))


def list_fighters(t: Tables, name: str | None = None, limit: int = PAGE, offset: int = 0, index: NameIndex | None = None) -> Page:
    limit, offset = page_bounds(limit, offset)
    found = named(t.fighters, name, index)
    return Page(found.orderBy("name", "id").offset(offset).limit(limit), found, limit, offset)


def suggest_fighters(t: Tables, name: str, most: int = 8, index: NameIndex | None = None) -> DataFrame:
    return named(t.fighters, name, index).orderBy("name", "id").limit(most)


def event_pages(spark: SparkSession, folder: str) -> PagedTable:
    """The events in the order of list_events(), written by its write(t.events)."""
    return PagedTable(spark, folder, [F.col("date").desc(), F.col("id").desc()], "date")


def list_events(t: Tables, limit: int = PAGE, offset: int = 0, pages: PagedTable | None = None) -> Page:
    """Newest first.  With event_pages() one range of these is read, and the total is known."""
    limit, offset = page_bounds(limit, offset)
    if pages:
        return Page(pages.page(limit, offset), t.events, limit, offset, pages.total())
    return Page(t.events.orderBy(F.col("date").desc(), F.col("id").desc()).offset(offset).limit(limit), t.events, limit, offset)


def by_id(table: DataFrame, key) -> DataFrame:
    return table.filter(F.col("id") == key)


def existing(t: Tables, ids: DataFrame) -> DataFrame:
    """The fighters among ``ids`` (column id)."""
    return t.fighters.join(ids, "id", "left_semi")


def without_bouts(t: Tables) -> DataFrame:
    return t.fighters.join(t.bout_fighters, t.fighters["id"] == t.bout_fighters["fighter_id"], "left_anti")


def corners(t: Tables) -> DataFrame:
    """bout_id, corner, fighter_id, fighter_name, STATS of every corner whose fighter is known."""
    names = t.fighters.select(F.col("id").alias("fighter_id"), F.col("name").alias("fighter_name"))
    return t.bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id", "corner", "fighter_id", *STATS).join(names, "fighter_id")


def _bouts_with_events(t: Tables) -> DataFrame:
    bouts = t.bouts.select(F.col("id").alias("bout_id"), "event_id", "winner_id", "method", "round", "ending_time_seconds", "weight_class", "title_bout", "scheduled_rounds", "referee")
    events = t.events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), F.col("date").alias("event_date"))
    return bouts.join(events, "event_id")


def history(t: Tables, fighter_id=None) -> DataFrame:
    """A fighter's bouts (or everyone's) in order of date and bout id, with the first other corner as opponent.

    won is whether the fighter is the winner; without a winner it is false.
    """
    all_corners = corners(t)
    own = all_corners
    if fighter_id is not None:
        own = all_corners.filter(F.col("fighter_id") == fighter_id)
        # The other side of a few bouts: all else is left out by a semi-join with their ids before anything is moved.
        mine = t.bout_fighters.filter(F.col("fighter_id") == fighter_id).select("bout_id")
        all_corners = corners(Tables(t.fighters, t.events, t.bouts, t.bout_fighters.join(mine, "bout_id", "left_semi"), t.rounds))
    other = all_corners.select("bout_id", F.col("fighter_id").alias("opponent_id"), F.col("fighter_name").alias("opponent_name"), F.col("corner").alias("opponent_corner"))
    # Both sides are distributed by bout, so that the other corners of a bout are met where the bout is.
    paired = own.join(other, "bout_id", "left").withColumn("is_other", F.col("opponent_id") != F.col("fighter_id"))
    first = Window.partitionBy("bout_id", "fighter_id").orderBy(F.when(F.col("is_other"), 0).otherwise(1), corner_order(F.col("opponent_corner")), "opponent_id")
    paired = paired.withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    paired = paired.withColumn("opponent_id", F.when(F.col("is_other"), F.col("opponent_id"))).withColumn("opponent_name", F.when(F.col("is_other"), F.col("opponent_name")))
    out = paired.join(_bouts_with_events(t), "bout_id").withColumn("won", F.coalesce(F.col("winner_id") == F.col("fighter_id"), F.lit(False)))
    out = out.select("fighter_id", "bout_id", "event_id", "event_name", "event_date", "corner", "opponent_id", "opponent_name", "won", "method", "round", "ending_time_seconds", *STATS)
    return out if fighter_id is None else out.orderBy("event_date", "bout_id")


def head_to_head(t: Tables, a, b) -> DataFrame:
    """The bouts of two fighters in order, with both corners' statistics."""
    if a == b:
        raise ValueError("two different fighters are needed")
    mine = t.bout_fighters.filter(F.col("fighter_id") == a).select("bout_id", F.col("corner").alias("corner_a"), *[F.col(s).alias(f"{s}_a") for s in STATS])
    theirs = t.bout_fighters.filter(F.col("fighter_id") == b).select("bout_id", F.col("corner").alias("corner_b"), *[F.col(s).alias(f"{s}_b") for s in STATS])
    return _bouts_with_events(t).join(mine.join(theirs, "bout_id"), "bout_id").orderBy("event_date", "bout_id")


def event_card(t: Tables, event_id) -> DataFrame:
    """An event's bouts by id, each with its corners, red first."""
    bouts = t.bouts.filter(F.col("event_id") == event_id).select(F.col("id").alias("bout_id"), "event_id", "winner_id", "method", "round", "ending_time_seconds", "weight_class")
    side = corners(t).join(bouts.select("bout_id"), "bout_id").groupBy("bout_id").agg(F.array_sort(F.collect_list(F.struct(corner_order(F.col("corner")).alias("place"), "corner", "fighter_id", "fighter_name"))).alias("corners"))
    return bouts.join(side, "bout_id", "left").orderBy("bout_id")


def bout_detail(t: Tables, bout_id) -> DataFrame:
    """A bout with its corners, red first, and their rounds in order."""
    bout = _bouts_with_events(t).filter(F.col("bout_id") == bout_id)
    own = corners(t).filter(F.col("bout_id") == bout_id)
    rounds = t.rounds.select("bout_fighter_id", F.struct("round", *STATS).alias("r")).join(own.select("bout_fighter_id"), "bout_fighter_id").groupBy("bout_fighter_id").agg(F.array_sort(F.collect_list("r")).alias("rounds"))
    nested = own.join(rounds, "bout_fighter_id", "left").groupBy("bout_id").agg(F.array_sort(F.collect_list(F.struct(corner_order(F.col("corner")).alias("place"), "corner", "fighter_id", "fighter_name", F.struct(*STATS).alias("stats"), F.coalesce("rounds", F.array()).alias("rounds")))).alias("corners"))
    return bout.join(nested, "bout_id", "left")


def bout_results(t: Tables) -> DataFrame:
    """(bout_id, kind, winner_name): no_contest by the method, draw without a winner, else winner, with the name of the winner's corner
    (null if no corner has the winner)."""
    names = corners(t).select("bout_id", F.col("fighter_id").alias("winner_id"), F.col("fighter_name").alias("winner_name"))
    bouts = t.bouts.select(F.col("id").alias("bout_id"), "winner_id", "method").join(names, ["bout_id", "winner_id"], "left")
    kind = F.when(F.col("method") == "no_contest", "no_contest").when(F.col("winner_id").isNull(), "draw").otherwise("winner")
    return bouts.select("bout_id", kind.alias("kind"), F.when(kind == "winner", F.col("winner_name")).alias("winner_name"))


def known_history(t: Tables, fighter_id) -> DataFrame | None:
    """A fighter's history, which may be empty; None for an id that no fighter has."""
    return None if by_id(t.fighters, fighter_id).isEmpty() else history(t, fighter_id)


def _career(rows: DataFrame) -> DataFrame:
    sums = {k: F.coalesce(F.sum(f"{k}_landed"), F.lit(0)) for k in ("head", "body", "leg", "distance", "clinch", "ground")}
    targets, positions = [sums[k] for k in ("head", "body", "leg")], [sums[k] for k in ("distance", "clinch", "ground")]
    return rows.groupBy("fighter_id").agg(
        F.count(F.lit(1)).alias("total_bouts"),
        F.avg("sig_strikes_landed").alias("avg_sig_strikes_landed"),
        F.avg("takedowns_landed").alias("avg_takedowns_landed"),
        F.avg("control_time_seconds").alias("avg_control_time_seconds"),
        *[share(sums[k], targets).alias(f"{k}_share") for k in ("head", "body", "leg")],
        *[share(sums[k], positions).alias(f"{k}_share") for k in ("distance", "clinch", "ground")],
    )


def wins_by_method(t: Tables) -> DataFrame:
    """(fighter_id, method, wins), from the bouts alone."""
    return t.bouts.filter(F.col("winner_id").isNotNull()).groupBy(F.col("winner_id").alias("fighter_id"), "method").agg(F.count(F.lit(1)).alias("wins"))


def fighter_stats(t: Tables, fighter_id=None) -> DataFrame:
    """Career averages, shares and wins by method of one fighter or of all.

    Averages leave unknown values out; in shares they count as 0.  A fighter without bouts has 0 bouts, nulls and no wins.
    """
    fighters = t.fighters.select(F.col("id").alias("fighter_id"))
    rows = t.bout_fighters
    if fighter_id is not None:
        fighters, rows = fighters.filter(F.col("fighter_id") == fighter_id), rows.filter(F.col("fighter_id") == fighter_id)
    wins = wins_by_method(t).groupBy("fighter_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "wins")))).alias("wins_by_method"))
    out = fighters.join(_career(rows), "fighter_id", "left").join(wins, "fighter_id", "left")
    return out.withColumn("total_bouts", F.coalesce("total_bouts", F.lit(0))).withColumn("wins_by_method", F.coalesce("wins_by_method", F.create_map().cast("map<string,bigint>")))


def recut(rows: DataFrame, first=None, last=None, last_n: int | None = None) -> DataFrame:
    """Of a history, the bouts of a period (both ends belong to it), and of these each fighter's last 2 to 8."""
    if first is not None:
        rows = rows.filter(F.col("event_date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(last).cast("date"))
    if last_n is not None:
        if not 2 <= last_n <= 8:
            raise ValueError("the last 2 to 8 bouts")
        latest = Window.partitionBy("fighter_id").orderBy(F.col("event_date").desc(), F.col("bout_id").desc())
        rows = rows.withColumn("__k", F.row_number().over(latest)).filter(F.col("__k") <= last_n).drop("__k")
    return rows


def derived_stats(rows: DataFrame) -> DataFrame:
    """Statistics of a recut history, with wins by method as columns."""
    wins = rows.groupBy("fighter_id").agg(F.count_if("won").alias("wins"), *[F.count_if(F.col("won") & (F.col("method") == m)).alias(f"wins_{m}") for m in METHODS])
    return _career(rows).join(wins, "fighter_id")


def finish_segments(t: Tables) -> DataFrame:
    """(fighter_id, place, method, wins): wins by method in the order of methods, without zeros."""
    return wins_by_method(t).filter("wins > 0").select("fighter_id", method_order(F.col("method")).cast("int").alias("place"), "method", "wins")


def page_info(total: Column, limit: int, offset: int) -> list[Column]:
    return [F.ceil(total / limit).cast("int").alias("pages"), F.lit(offset // limit + 1).alias("page")]
