"""From CSV rows and JSON documents to the granular tables.

Every load is get-or-create by natural key and can be run again without effect.  Loads of files compute whole new tables; an event's
documents give only the rows that are new, which the store appends.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions import expr
from ringside.functions.names import normalize_name
from ringside.operators import merge
from ringside.schema import BASE_STATS, SPLIT_KINDS, SPLIT_STATS, STATS, Tables
from ringside.sources.files import ORDINAL
from ringside.sources.scratch import cut
from ringside.sources.store import Snapshot

#: Suffixes of the CSV columns of a corner, by statistic.
STAT_SUFFIX = {"knockdowns": "kd", "sig_strikes_landed": "sig_str_landed", "sig_strikes_attempted": "sig_str_atmpted", "takedowns_landed": "td_landed", "takedowns_attempted": "td_atmpted", "submission_attempts": "sub_att", "control_time_seconds": "ctrl"}
SPLIT_SUFFIX = {f"{k}_{what}": f"{ {'total_strikes': 'total_str', 'distance': 'dist'}.get(k, k)}_{short}" for k in SPLIT_KINDS for what, short in (("landed", "landed"), ("attempted", "atmpted"))}


#: Beyond so many events, files are not chosen by their keys.
MANY_EVENTS = 50


def fighters_from_csv(rows: DataFrame, source: str = "files") -> DataFrame:
    """Typed fighters, one for each normalised name and date of birth: the first."""
    out = rows.select(
        F.trim("name").alias("name"), normalize_name(F.col("name")).alias("name_normalized"), expr.text_or_null(F.col("nick_name")).alias("nickname"), expr.short_date(F.col("dob")).alias("date_of_birth"),
        expr.int_strict(F.col("height")).alias("height_cm"), expr.int_strict(F.col("reach")).alias("reach_cm"), expr.stance_of(F.col("stance")).alias("stance"), F.lit(None).cast("double").alias("weight_kg"),
        *[F.coalesce(expr.int_strict(F.col(c)), F.lit(0)).alias(c) for c in ("wins", "losses", "draws")], F.lit(source).alias("source"), ORDINAL,
    )
    return merge.first_by_key(out, ["name_normalized", "date_of_birth"])


def load_fighters(old: DataFrame, rows: DataFrame, source: str = "files") -> DataFrame:
    return merge.insert_absent(old, fighters_from_csv(rows, source), ["name_normalized", "date_of_birth"])


def event_rows(fights: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, name, date, location): one for each event id, the first seen; the name is the last that the fights give it."""
    names = merge.last_by_key(fights.select("event_id", "event_name", ORDINAL), ["event_id"]).select("event_id", F.col("event_name").alias("name"))
    first = merge.first_by_key(events.select("event_id", "date", "location", ORDINAL), ["event_id"])
    joined = first.join(names, "event_id", "left").withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
    return joined.filter("name <> ''").select("event_id", "name", expr.long_date(F.col("date")).alias("date"), expr.text_or_null(F.col("location")).alias("location"), ORDINAL)


def load_events(old: DataFrame, fights: DataFrame, events: DataFrame, source: str = "files") -> DataFrame:
    new = event_rows(fights, events).filter("date is not null").drop("event_id").withColumn("source", F.lit(source))
    return merge.insert_absent(old, new, ["name", "date"])


def merged_fights(fights: DataFrame, events: DataFrame) -> DataFrame:
    """Fights with the date of their event and the name of their winner, '' if there is none; the first row of an id counts."""
    dates = merge.first_by_key(events.select("event_id", "date", ORDINAL), ["event_id"]).drop(ORDINAL)
    winners = merge.first_by_key(events.select("fight_id", "winner", ORDINAL), ["fight_id"]).drop(ORDINAL)
    out = fights.join(dates, "event_id", "left").join(winners, "fight_id", "left")
    return out.withColumn("date", F.coalesce("date", F.lit(""))).withColumn("winner", F.coalesce("winner", F.lit("")))


def winner_corner(winner: Column, red: Column, blue: Column, method: Column) -> Column:
    """By equal keys, red first; no winner in a no contest."""
    return F.when(method == "no_contest", None).when(winner == red, "red").when(winner == blue, "blue")


def resolved_fights(fights: DataFrame, events_csv: DataFrame, fighters: DataFrame, events: DataFrame) -> DataFrame:
    """Fights with red_id, blue_id, event, method and winner; what isn't found is null.

    A fighter is found by a name that only one fighter has, an event by its exact name and date.
    """
    rows = merged_fights(fights, events_csv)
    rows = rows.withColumns({"red_key": normalize_name(F.col("r_name")), "blue_key": normalize_name(F.col("b_name")), "winner_key": normalize_name(F.col("winner")), "day": expr.long_date(F.col("date"), strict=False), "event_title": F.trim("event_name")})
    index = merge.unique_only(fighters.select("name_normalized", "id"), "name_normalized", "id")
    rows = rows.join(index.select(F.col("name_normalized").alias("red_key"), F.col("id").alias("red_id")), "red_key", "left").join(index.select(F.col("name_normalized").alias("blue_key"), F.col("id").alias("blue_id")), "blue_key", "left")
    rows = rows.join(events.select(F.col("name").alias("event_title"), F.col("date").alias("day"), F.col("id").alias("event_key")), ["event_title", "day"], "left")
    rows = rows.withColumn("method_kind", expr.method_of(F.col("method"), expr.CSV_METHODS))
    corner = winner_corner(F.nullif(F.col("winner_key"), F.lit("")), F.col("red_key"), F.col("blue_key"), F.col("method_kind"))
    return rows.withColumn("winner_side", corner).withColumn("winner_id", F.when(corner == "red", F.col("red_id")).when(corner == "blue", F.col("blue_id")))


def is_resolved() -> Column:
    return F.col("red_id").isNotNull() & F.col("blue_id").isNotNull() & F.col("event_key").isNotNull()


def bout_index(bouts: DataFrame, bout_fighters: DataFrame) -> DataFrame:
    """(bout_id, event_id, low_id, high_id) of the bouts with exactly two corners."""
    pairs = bout_fighters.groupBy("bout_id").agg(F.min("fighter_id").alias("low_id"), F.max("fighter_id").alias("high_id"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return bouts.select(F.col("id").alias("bout_id"), "event_id").join(pairs, "bout_id").select("bout_id", "event_id", "low_id", "high_id")


def wide_to_long(fights: DataFrame, stats: dict[str, str], strict: bool = True) -> DataFrame:
    """Each fight as its red and its blue corner: the r_* and b_* columns under the names of the statistics, in one scan."""
    number = expr.int_strict if strict else expr.int_lenient
    side = lambda p, corner: F.struct(F.lit(corner).alias("corner"), F.col("red_id" if p == "r" else "blue_id").alias("fighter_id"), *[(number(F.col(f"{p}_{s}")) if f"{p}_{s}" in fights.columns else F.lit(None).cast("int")).alias(n) for n, s in stats.items()])
    return fights.withColumn("__c", F.explode(F.array(side("r", "red"), side("b", "blue")))).select(*fights.columns, "__c.*")


def load_bouts(t: Tables, fights: DataFrame, events_csv: DataFrame, source: str = "files") -> tuple[Tables, DataFrame]:
    """The tables with the resolved fights and their corners, and the fights that were not resolved."""
    rows = cut(resolved_fights(fights, events_csv, t.fighters, t.events))
    good, rejects = rows.filter(is_resolved()), rows.filter(~is_resolved())
    keyed = good.select("*", *expr.pair_key(F.col("event_key"), F.col("red_id"), F.col("blue_id"))[1:])
    keyed = merge.first_by_key(keyed.withColumn("__event", F.col("event_key")), ["__event", "low_id", "high_id"])
    index = bout_index(t.bouts, t.bout_fighters)
    known = index.select(F.col("event_id").alias("__event"), "low_id", "high_id")
    new = merge.absent(keyed, known, ["__event", "low_id", "high_id"])
    core = new.select(
        F.col("__event").cast("int").alias("event_id"), F.col("winner_id").cast("int").alias("winner_id"), F.col("method_kind").alias("method"), expr.int_strict(F.col("finish_round")).alias("round"),
        expr.int_strict(F.col("match_time_sec")).alias("ending_time_seconds"), expr.text_or_null(F.col("division")).alias("weight_class"), *context(new), F.lit(source).alias("source"), "low_id", "high_id",
    )
    core = cut(merge.with_ids(core, t.bouts, ["event_id", "low_id", "high_id"]))
    bouts = t.bouts.unionByName(core.drop("low_id", "high_id"), allowMissingColumns=True)
    every = index.union(core.select(F.col("id").alias("bout_id"), "event_id", "low_id", "high_id"))
    placed = keyed.join(every.withColumnRenamed("event_id", "__event"), ["__event", "low_id", "high_id"])
    corners = wide_to_long(placed.drop("fighter_id", "corner"), STAT_SUFFIX).select("bout_id", "fighter_id", "corner", *BASE_STATS)
    corners = corners.select("*", *[F.lit(None).cast("int").alias(s) for s in SPLIT_STATS], F.lit(source).alias("source"))
    new_corners = merge.with_ids(merge.absent(corners, t.bout_fighters, ["bout_id", "fighter_id"]), t.bout_fighters, ["bout_id", "fighter_id"])
    return dataclasses.replace(t, bouts=bouts, bout_fighters=t.bout_fighters.unionByName(new_corners, allowMissingColumns=True)), rejects


def context(fights: DataFrame) -> list[Column]:
    """Title bout, scheduled rounds and referee, where the file has them."""
    have = lambda c, f, kind: f(F.col(c)) if c in fights.columns else F.lit(None).cast(kind)
    return [have("title_fight", expr.bool_lenient, "boolean").alias("title_bout"), have("total_rounds", expr.int_lenient, "int").alias("scheduled_rounds"), have("referee", expr.text_or_null, "string").alias("referee")]


def backfill_splits(t: Tables, fights: DataFrame, events_csv: DataFrame, source: str = "files") -> Tables:
    """Splits and context of known bouts from the file: overwritten, by nulls too, with the source; nothing is inserted."""
    rows = resolved_fights(fights, events_csv, t.fighters, t.events).filter(is_resolved())
    keyed = rows.select("*", F.col("event_key").alias("__event"), *expr.pair_key(F.col("event_key"), F.col("red_id"), F.col("blue_id"))[1:])
    keyed = merge.first_by_key(keyed, ["__event", "low_id", "high_id"]).join(bout_index(t.bouts, t.bout_fighters).withColumnRenamed("event_id", "__event"), ["__event", "low_id", "high_id"])
    splits = {n: s for n, s in SPLIT_SUFFIX.items()}
    corners = wide_to_long(keyed.drop("fighter_id", "corner"), splits, strict=False).withColumn("source", F.lit(source))
    bout_rows = keyed.select(F.col("bout_id").alias("id"), *context(keyed), F.lit(source).alias("source"))
    bout_fighters = merge.update_only(t.bout_fighters, corners, ["bout_id", "fighter_id"], [*splits, "source"])
    bouts = merge.update_only(t.bouts, bout_rows, ["id"], ["title_bout", "scheduled_rounds", "referee", "source"])
    return dataclasses.replace(t, bouts=bouts, bout_fighters=bout_fighters)


def match_fighters(candidates: DataFrame, fighters: DataFrame) -> DataFrame:
    """candidates with status (match, new or ambiguous) and fighter_id.

    candidates: candidate, name_normalized, date_of_birth.  Nobody of that name is new.  With a date of birth: one exact match is it,
    several are ambiguous, and none is ambiguous if someone of the name has no date, else new.  Without one: the only one of the
    name is it, several are ambiguous.
    """
    others = fighters.select("name_normalized", F.col("date_of_birth").alias("__born"), F.col("id").alias("__id"))
    exact = F.col("__born") == F.col("date_of_birth")
    found = candidates.join(others, "name_normalized", "left").groupBy("candidate", "name_normalized", "date_of_birth").agg(
        F.count("__id").alias("same"), F.count_if(exact).alias("exact"), F.count_if(F.col("__id").isNotNull() & F.col("__born").isNull()).alias("undated"),
        F.min(F.when(exact, F.col("__id"))).alias("exact_id"), F.min("__id").alias("any_id"),
    )
    dated = F.when(F.col("exact") == 1, "match").when((F.col("exact") > 1) | (F.col("undated") > 0), "ambiguous").otherwise("new")
    undated = F.when(F.col("same") == 1, "match").otherwise("ambiguous")
    status = F.when(F.col("same") == 0, "new").when(F.col("date_of_birth").isNotNull(), dated).otherwise(undated)
    out = found.withColumn("status", status)
    return out.select("candidate", "name_normalized", "date_of_birth", "status", F.when(status == "match", F.coalesce(F.when(F.col("date_of_birth").isNotNull(), F.col("exact_id")), F.col("any_id"))).alias("fighter_id"))


def no_ambiguous(matches: DataFrame) -> DataFrame:
    return matches.filter(F.when(F.col("status") == "ambiguous", F.raise_error(F.concat(F.lit("more than one fighter may be "), F.col("name_normalized"))).cast("boolean")).otherwise(True))


def absent_events(events: DataFrame, heads: DataFrame, last: int | None = None) -> DataFrame:
    """The heads (name, date, ...) with ids whose normalised name and date no event has."""
    keyed = lambda rows: rows.withColumn("name_key", normalize_name(F.col("name")))
    return merge.fresh(keyed(events), keyed(heads), ["name_key", "date"], last=last)


def take_in_event(t: Tables, event: DataFrame, fighters: DataFrame, stats: DataFrame, source: str = "documents") -> Tables:
    """The tables with one event's documents: its event, new fighters, bouts and corners; what is there already stays as it is."""
    new = event_rows_to_add(t, event, fighters, stats, source)
    return Tables(*[getattr(t, f.name).unionByName(getattr(new, f.name), allowMissingColumns=True) for f in dataclasses.fields(t)])


def names_of(fighters: DataFrame) -> list[str]:
    """The normalised names of one event's fighters, some dozens."""
    return [r[0] for r in fighters.select(normalize_name(F.col("name"))).distinct().collect()]


def tables_for(view: Snapshot, event: DataFrame, fighters: DataFrame) -> Tables:
    """What a store holds of the names and the day of one event's documents: all that its intake compares them with.

    Files are chosen by the event's date, its fighters' names, and the ids of its event and bouts, if these are there already.  Documents
    of very many events at once are compared with the whole tables.
    """
    heads = event.select(normalize_name(F.col("event_name")).alias("name_key"), F.col("event_date").alias("date")).distinct()
    days = [r["date"] for r in heads.limit(MANY_EVENTS + 1).collect()]
    if len(days) > MANY_EVENTS:
        return view.read()
    asked = {"events": days, "fighters": names_of(fighters), "bouts": [], "bout_fighters": [], "rounds": []}
    t = view.read(asked)
    known = t.events.withColumn("name_key", normalize_name(F.col("name"))).join(heads, ["name_key", "date"], "left_semi")
    asked["bouts"] = [r["id"] for r in known.select("id").collect()]
    if asked["bouts"]:
        asked["bout_fighters"] = [r["id"] for r in view.read(asked).bouts.select("id").collect()]  # of one card
    return view.read(asked)


def event_rows_to_add(t: Tables, event: DataFrame, fighters: DataFrame, stats: DataFrame, source: str = "documents", last: dict[str, int] | None = None) -> Tables:
    """The rows that one event's documents add to the tables.

    event: event_documents; fighters: fighter_documents of its slugs; stats: bout_stats_documents.  last: the largest id of each
    table, where ``t`` is only a part of the tables (tables_for).
    """
    last = last or {}
    heads = event.select(F.trim("event_name").alias("name"), F.col("event_date").alias("date"), F.lit(None).cast("string").alias("location"), F.lit(source).alias("source")).distinct()
    new_events = cut(absent_events(t.events, heads, last.get("events")))
    events = t.events.withColumn("name_key", normalize_name(F.col("name"))).unionByName(new_events, allowMissingColumns=True)
    candidates = fighters.select(F.col("slug").alias("candidate"), normalize_name(F.col("name")).alias("name_normalized"), "date_of_birth", F.struct("*").alias("doc")).dropDuplicates(["candidate"])
    matched = no_ambiguous(match_fighters(candidates.drop("doc"), t.fighters)).join(candidates.select("candidate", "doc"), "candidate")
    matched = cut(matched)
    fresh = matched.filter("status = 'new'").select(F.trim("doc.name").alias("name"), "name_normalized", "doc.nickname", "date_of_birth", "doc.height_cm", "doc.reach_cm", expr.stance_of(F.col("doc.stance")).alias("stance"), F.lit(None).cast("double").alias("weight_kg"), "doc.wins", "doc.losses", "doc.draws", F.lit(source).alias("source"))
    new_fighters = cut(merge.fresh(t.fighters, fresh, ["name_normalized", "date_of_birth"], last=last.get("fighters")))
    new_ids = new_fighters.select("name_normalized", F.col("date_of_birth").alias("__born"), F.col("id").alias("new_id"))
    slugs = matched.join(new_ids, (matched["name_normalized"] == new_ids["name_normalized"]) & matched["date_of_birth"].eqNullSafe(new_ids["__born"]) & (matched["status"] == "new"), "left").select(F.col("candidate").alias("slug"), F.coalesce("fighter_id", "new_id").alias("fighter_id"))
    rows = event.select("event_name", "event_date", "bout.*").withColumn("red_slug", F.col("corners")[0]["slug"]).withColumn("blue_slug", F.col("corners")[1]["slug"]).withColumn(ORDINAL, F.monotonically_increasing_id())
    # The key of a name is made once for an event, not for each of its bouts.
    named = event.select("event_name", "event_date").distinct().withColumn("name_key", normalize_name(F.col("event_name")))
    named = cut(named.join(events.select("name_key", F.col("date").alias("event_date"), F.col("id").alias("__event")), ["name_key", "event_date"]))
    rows = rows.join(named.select("event_name", "event_date", "__event"), ["event_name", "event_date"])
    rows = rows.join(slugs.select(F.col("slug").alias("red_slug"), F.col("fighter_id").alias("red_id")), "red_slug").join(slugs.select(F.col("slug").alias("blue_slug"), F.col("fighter_id").alias("blue_id")), "blue_slug")
    rows = rows.withColumn("method_kind", expr.method_of(F.col("method"), expr.JSON_METHODS)).withColumn("low_id", F.least("red_id", "blue_id")).withColumn("high_id", F.greatest("red_id", "blue_id"))
    side = winner_corner(F.col("winner_slug"), F.col("red_slug"), F.col("blue_slug"), F.col("method_kind"))
    rows = cut(rows.withColumn("winner_id", F.when(side == "red", F.col("red_id")).when(side == "blue", F.col("blue_id"))))
    index = cut(bout_index(t.bouts, t.bout_fighters))
    keyed = merge.first_by_key(rows, ["__event", "low_id", "high_id"])
    new = merge.absent(keyed, index.withColumnRenamed("event_id", "__event"), ["__event", "low_id", "high_id"])
    core = new.select(F.col("__event").cast("int").alias("event_id"), F.col("winner_id").cast("int").alias("winner_id"), F.col("method_kind").alias("method"), F.col("finish_round").alias("round"), F.col("finish_time_seconds").alias("ending_time_seconds"), "weight_class", F.lit(source).alias("source"), "low_id", "high_id")
    core = cut(merge.with_ids(core, t.bouts, ["event_id", "low_id", "high_id"], last=last.get("bouts")))
    every = index.union(core.select(F.col("id").alias("bout_id"), "event_id", "low_id", "high_id")).withColumnRenamed("event_id", "__event").withColumnRenamed("bout_id", "own_bout")
    placed = keyed.join(every, ["__event", "low_id", "high_id"])
    seats = placed.select("own_bout", "bout_id", F.explode(F.array(F.struct(F.lit("red").alias("corner"), F.col("red_id").alias("fighter_id")), F.struct(F.lit("blue").alias("corner"), F.col("blue_id").alias("fighter_id")))).alias("c")).select("own_bout", "bout_id", "c.*")
    corners = seats.join(stats.select("bout_id", "corner", *BASE_STATS), ["bout_id", "corner"], "left").select(F.col("own_bout").alias("bout_id"), "fighter_id", "corner", *BASE_STATS, *[F.lit(None).cast("int").alias(s) for s in SPLIT_STATS], F.lit(source).alias("source"))
    new_corners = merge.with_ids(merge.absent(corners, t.bout_fighters, ["bout_id", "fighter_id"]), t.bout_fighters, ["bout_id", "fighter_id"], last=last.get("bout_fighters"))
    return as_rows_of(t, new_fighters, new_events.drop("name_key"), core.drop("low_id", "high_id"), new_corners)


def as_rows_of(t: Tables, *rows: DataFrame) -> Tables:
    """Rows in the columns and types of the tables, which are named in their order; of tables that aren't given, none."""
    out = []
    for f, new in zip(dataclasses.fields(t), (*rows, *[None] * 5), strict=False):
        table = getattr(t, f.name)
        if new is None:
            out.append(table.limit(0))
        else:
            out.append(new.select(*[(F.col(c.name) if c.name in new.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in table.schema]))
    return Tables(*out)


def matched_lines(t: Tables, event_id, lines: DataFrame) -> DataFrame:
    """Statistics lines of an event with the bout_fighter_id of its fighter of that name, null if there is none; several raise."""
    return matched_lines_of(t, lines.withColumn("__event", F.lit(event_id))).drop("__event")


def matched_lines_of(t: Tables, lines: DataFrame, event: str = "__event") -> DataFrame:
    """Lines of any events (their ids are in column ``event``) with bout_fighter_id; a name of several corners raises."""
    found = with_candidates(t, lines, event)
    one = F.when(F.col("corners_of_name") > 1, F.raise_error(F.concat(F.lit("more than one corner is "), F.col("name_normalized"))).cast("long")).otherwise(F.col("bout_fighter_id"))
    return found.withColumn("bout_fighter_id", one).drop("corners_of_name", "name_normalized")


def with_candidates(t: Tables, lines: DataFrame, event: str = "__event") -> DataFrame:
    """Lines with name_normalized, corners_of_name (how many corners of their event have that name, null for none) and the first one's bout_fighter_id."""
    asked = lines.select(F.col(event).alias("event_id")).distinct()
    bouts = t.bouts.join(asked, "event_id", "left_semi").select(F.col("id").alias("bout_id"), "event_id")
    names = t.bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id", "fighter_id").join(bouts, "bout_id").join(t.fighters.select(F.col("id").alias("fighter_id"), "name_normalized"), "fighter_id")
    index = names.groupBy(F.col("event_id").alias(event), "name_normalized").agg(F.min("bout_fighter_id").alias("bout_fighter_id"), F.count(F.lit(1)).alias("corners_of_name"))
    return lines.withColumn("name_normalized", slug_name(F.col("fighter_slug"))).join(index, [event, "name_normalized"], "left")


def slug_name(slug: Column) -> Column:
    return normalize_name(F.translate(slug, "-", " "))


def tables_of_events(view: Snapshot, event_ids: list[int], lines: DataFrame) -> Tables:
    """What a store holds of a few events and of the names in their lines."""
    names = [r[0] for r in lines.select(slug_name(F.col("fighter_slug"))).distinct().collect()]  # of the events that were asked for
    asked = {"events": [], "fighters": names, "bouts": event_ids, "bout_fighters": [], "rounds": []}
    asked["bout_fighters"] = [r["id"] for r in view.read(asked).bouts.filter(F.col("event_id").isin(event_ids)).select("id").collect()]
    asked["rounds"] = [r["id"] for r in view.read(asked).bout_fighters.select("id").collect()]
    return view.read(asked)


def coverage(matched: DataFrame) -> DataFrame:
    """(total, matched, coverage) of distinct fighters; 0.0 of none."""
    who = matched.groupBy("fighter_slug").agg(F.max(F.col("bout_fighter_id").isNotNull()).alias("hit"))
    counts = who.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("matched"))
    return counts.withColumn("coverage", F.coalesce(expr.ratio(F.col("matched"), F.col("total")), F.lit(0.0)))


def backfill_rounds(t: Tables, event_id, lines: DataFrame, source: str = "documents") -> Tables:
    """The tables with an event's round lines, by corner and round; known rounds stay, lines of unknown fighters are left out."""
    return dataclasses.replace(t, rounds=t.rounds.unionByName(rounds_to_add(t, matched_lines(t, event_id, lines), source), allowMissingColumns=True))


def rounds_to_add(t: Tables, matched: DataFrame, source: str = "documents", last: int | None = None) -> DataFrame:
    """The rounds of matched lines that the table doesn't have."""
    known = matched.filter("bout_fighter_id is not null")
    have = set(known.columns)
    rows = known.select("bout_fighter_id", "round", *[(F.col(s) if s in have else F.lit(None).cast("int")).alias(s) for s in STATS], F.lit(source).alias("source"))
    return merge.fresh(t.rounds, rows, ["bout_fighter_id", "round"], last=last)


def events_between(events: DataFrame, first: str = "2019-01-01", last: str = "2025-12-31") -> DataFrame:
    """Events of the period, both ends in it, with their slugs (null for names without one), in order."""
    found = events.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return found.withColumn("slug", expr.event_slug(F.col("name"))).orderBy("date", "id")


def table_changes(old: Tables, new: Tables) -> dict[str, int]:
    """Rows that each table has more than before, counted in one job."""
    each = [getattr(x, f.name).agg(F.count(F.lit(sign)).alias("n")).select(F.lit(f.name).alias("k"), (F.col("n") * sign).alias("n")) for x, sign in ((old, -1), (new, 1)) for f in dataclasses.fields(old)]
    return {r["k"]: r["n"] for r in functools.reduce(DataFrame.union, each).groupBy("k").agg(F.sum("n").alias("n")).collect()}
