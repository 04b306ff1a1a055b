"""Registered queries of the sources: tables written as the sources' files and read back, and what documents add to the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.plans import ingest
from ringside.queries import MAIN, query
from ringside.schema import BASE_STATS, SPLIT_STATS, Tables
from ringside.sources import files
from ringside.sources.files import ORDINAL
from ringside.sources.scratch import cut, shared_dir


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


#: Column of documents: those with the same number stand in one file.
CHUNK = "chunk"
#: Bouts of one file of statistics, of some 500 bytes a round: 2 MB, so that files don't become more than a driver can list and move.
FILE_BOUTS = 4096


def _written(docs: DataFrame, name: str) -> str:
    """The rows of ``docs`` as JSON documents, in files with an array of those of one CHUNK each; returns the folder."""
    path = _folder(docs, name)
    texts = docs.select(CHUNK, F.to_json(F.struct(*[c for c in docs.columns if c != CHUNK])).alias("doc"))
    arrays = texts.groupBy(CHUNK).agg(F.collect_list("doc").alias("docs")).select(F.concat(F.lit("["), F.array_join("docs", ","), F.lit("]")).alias("value"))
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _by_file(rows: DataFrame) -> DataFrame:
    """Rows of bouts with the CHUNK of their file, all of which lie together: they become lines, documents and files there."""
    return rows.withColumn(CHUNK, F.floor(F.col("bout_id") / FILE_BOUTS)).repartition(CHUNK)


def _slug(fighter: Column) -> Column:
    return F.concat(F.lit("f-"), fighter.cast("string"))


def _cards(t: Tables) -> DataFrame:
    """(bout_id, event_id, event_name, event_date, bout) with the bout as in documents of events."""
    side = lambda c: t.bout_fighters.filter(F.col("corner") == c).select("bout_id", F.col("fighter_id").alias(c)).join(t.fighters.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c)
    rows = t.bouts.withColumnRenamed("id", "bout_id").join(side("red"), "bout_id").join(side("blue"), "bout_id").join(t.events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), F.col("date").alias("event_date")), "event_id")
    tokens = {"ko_tko": "KO/TKO", "submission": "Submission", "decision": "Decision - Unanimous", "dq": "DQ", "no_contest": "No Contest"}
    token = F.element_at(F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv]), F.col("method"))
    corners = F.array(*[F.struct(_slug(F.col(c)).alias("slug"), F.col(f"{c}_name").alias("name")) for c in ("red", "blue")])
    bout = F.struct(
        F.col("bout_id").cast("string").alias("bout_id"), token.alias("method"), F.col("round").alias("finish_round"), F.col("ending_time_seconds").alias("finish_time_seconds"), "weight_class",
        F.when(F.col("winner_id").isNotNull(), _slug(F.col("winner_id"))).alias("winner_slug"), corners.alias("corners"),
    )
    return rows.select("bout_id", "event_id", "event_name", "event_date", F.least("red", "blue").alias("low"), F.greatest("red", "blue").alias("high"), bout.alias("bout"))


# ---------------------------------------------------------------- files written and read back


@query("""SELECT 'the "' || name || '", so called' AS name, CASE WHEN id % 3 = 0 THEN '' ELSE 'n' || id END AS nick_name, height_cm || '.0' AS height, coalesce(reach_cm || '.0', '') AS reach, coalesce(stance, '') AS stance FROM fighters""")
def csv_files_read(t: Tables) -> DataFrame:
    """Fighters written as the CSV file, with quotes and commas, and read as texts: what is missing is empty."""
    text = lambda c: F.concat(F.col(c).cast("string"), F.lit(".0"))
    rows = t.fighters.select(F.concat(F.lit('the "'), "name", F.lit('", so called')).alias("name"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("nick_name"), text("height_cm").alias("height"), text("reach_cm").alias("reach"), "stance")
    folder = _folder(rows, "csv")
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/{files.FIGHTER_FILE}")
    return files.fighter_details(t.fighters.sparkSession, folder).drop(ORDINAL)


_SIDES = "JOIN bout_fighters r ON r.bout_id = b.id AND r.corner = 'red' JOIN bout_fighters l ON l.bout_id = b.id AND l.corner = 'blue'"


@query(f"""SELECT CAST(b.event_id AS VARCHAR) AS event_id, e.name AS event_name, CAST(e.date AS VARCHAR) AS event_date, CAST(b.id AS VARCHAR) AS bout_id, b.round AS finish_round, b.ending_time_seconds AS finish_time_seconds, 'f-' || b.winner_id AS winner_slug, 'f-' || r.fighter_id AS red_slug, 'f-' || l.fighter_id AS blue_slug
FROM bouts b {_SIDES} JOIN events_ e ON e.id = b.event_id""")
def event_documents_read(t: Tables) -> DataFrame:
    """All bouts as documents of events and read again; a document holds 256 bouts at most."""
    docs = _cards(t).groupBy(F.floor(F.col("bout_id") / 256).alias("part"), "event_id", "event_name", "event_date").agg(F.collect_list("bout").alias("bouts"))
    docs = docs.select(F.floor(F.col("event_id") / 4).alias(CHUNK), F.col("event_id").cast("string").alias("event_id"), F.col("event_name").alias("name"), F.col("event_date").alias("date"), "bouts")
    back = files.event_documents(t.bouts.sparkSession, _written(docs, "events"))
    return back.select("event_id", "event_name", F.col("event_date").cast("string").alias("event_date"), "bout.bout_id", "bout.finish_round", "bout.finish_time_seconds", "bout.winner_slug", F.col("bout.corners")[0]["slug"].alias("red_slug"), F.col("bout.corners")[1]["slug"].alias("blue_slug"))


@query("SELECT 'f-' || id AS slug, name, CASE WHEN id % 4 <> 0 THEN CAST(date_of_birth AS VARCHAR) END AS date_of_birth, height_cm, reach_cm, stance, CASE WHEN id % 3 = 0 THEN 0 ELSE wins END AS wins, losses, draws FROM fighters")
def fighter_documents_read(t: Tables) -> DataFrame:
    """Fighters as documents, some without a date of birth or wins, and read again: missing counts are 0."""
    docs = t.fighters.select(F.floor(F.col("id") / 256).alias(CHUNK), _slug(F.col("id")).alias("slug"), "name", F.when(F.col("id") % 4 != 0, F.col("date_of_birth")).alias("date_of_birth"), "height_cm", "reach_cm", "stance", F.when(F.col("id") % 3 != 0, F.col("wins")).alias("wins"), "losses", "draws")
    back = files.fighter_documents(t.fighters.sparkSession, _written(docs, "fighters"))
    return back.select("slug", "name", F.col("date_of_birth").cast("string").alias("date_of_birth"), "height_cm", "reach_cm", "stance", "wins", "losses", "draws")


@query(f"SELECT CAST(bout_id AS VARCHAR) AS bout_id, corner, 'f-' || fighter_id AS fighter_slug, CASE WHEN bout_id % 5 <> 0 THEN knockdowns END AS knockdowns, {', '.join(BASE_STATS[1:])} FROM bout_fighters")
def bout_stats_read(t: Tables) -> DataFrame:
    """Base statistics as documents of bouts, in some of which a key is absent, and read again."""
    line = F.struct("corner", _slug(F.col("fighter_id")).alias("fighter_slug"), F.when(F.col("bout_id") % 5 != 0, F.col("knockdowns")).alias("knockdowns"), *BASE_STATS[1:])
    docs = _by_file(t.bout_fighters).groupBy(CHUNK, "bout_id").agg(F.collect_list(line).alias("fighters")).withColumn("bout_id", F.col("bout_id").cast("string"))
    return files.bout_stats_documents(t.bouts.sparkSession, _written(docs, "stats")).select("bout_id", "corner", "fighter_slug", *BASE_STATS)


_WIRE = ["sig_strikes", "takedowns", "head", "body", "leg", "distance", "clinch", "ground"]
_READ = [f"{k}_{what}" for k in _WIRE for what in ("landed", "attempted")]


@query(f"SELECT CAST(c.bout_id AS VARCHAR) AS bout_id, c.corner, 'f-' || c.fighter_id AS fighter_slug, r.round, r.knockdowns, r.submission_attempts, r.reversals, r.control_time_seconds, {', '.join('r.' + c for c in _READ)} FROM rounds r JOIN bout_fighters c ON c.id = r.bout_fighter_id")
def round_stats_read(t: Tables) -> DataFrame:
    """All rounds as envelopes of statistics with pairs and clocks as texts, and read again."""
    corners = t.bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id", "corner", _slug(F.col("fighter_id")).alias("fighter_slug"))
    rows = _by_file(t.rounds.join(corners, "bout_fighter_id")).withColumn("bout_id", F.col("bout_id").cast("string"))
    lines = files.to_wire(rows, [CHUNK])
    docs = lines.groupBy(CHUNK, "boutId").agg(F.collect_list(F.struct(*lines.drop(CHUNK).columns)).alias("roundStats")).select(CHUNK, F.lit(True).alias("success"), F.struct("roundStats").alias("data"))
    back = files.event_stats_documents(t.bouts.sparkSession, _written(docs, "envelopes"), rounds=True)
    return back.select("bout_id", "corner", "fighter_slug", "round", "knockdowns", "submission_attempts", "reversals", "control_time_seconds", *_READ)


# ---------------------------------------------------------------- what events add

_FROM = "1996-01-01"


def _intake(t: Tables) -> Tables:
    """What the documents of all events add to tables without every seventh fighter and without events from a day on.

    Of bouts of one event between the same two, documents have the first.  Documents of earlier events are given again: these add nothing.
    """
    new_fighter = lambda c: F.col(c) % 7 == 0
    later = F.col("event_date") >= F.lit(_FROM).cast("date")
    first = Window.partitionBy("event_id", "low", "high").orderBy("bout_id")
    cards = cut(_cards(t).withColumn("k", F.row_number().over(first)).filter("k = 1").filter(later | (~new_fighter("low") & ~new_fighter("high"))))  # read several times
    fighters = t.fighters.select(_slug(F.col("id")).alias("slug"), "name", "date_of_birth", "nickname", "height_cm", "reach_cm", "stance", "wins", "losses", "draws")
    people = cards.select(F.explode("bout.corners").alias("c")).select("c.slug").distinct()
    old_fighters = t.fighters.filter(~new_fighter("id")).withColumn("name_normalized", ingest.normalize_name(F.col("name")))
    old_events = t.events.filter(F.col("date") < F.lit(_FROM).cast("date"))
    old = cards.filter(~later).select("bout_id")
    corners = t.bout_fighters.join(old, "bout_id", "left_semi")
    stats = t.bout_fighters.select(F.col("bout_id").cast("string").alias("bout_id"), "corner", *BASE_STATS)
    known = Tables(old_fighters, old_events, t.bouts.join(old.withColumnRenamed("bout_id", "id"), "id", "left_semi").select(*t.bouts.columns), corners.select(*t.bout_fighters.columns), t.rounds.limit(0))
    return ingest.event_rows_to_add(known, cards.select(F.col("event_id").cast("string").alias("event_id"), "event_name", "event_date", "bout"), fighters.join(people, "slug", "left_semi"), stats)


_INTAKE = f""", p AS (SELECT b.*, e.date, e.name, r.fighter_id AS red_id, l.fighter_id AS blue_id, least(r.fighter_id, l.fighter_id) AS low, greatest(r.fighter_id, l.fighter_id) AS high, row_number() OVER (PARTITION BY b.event_id, least(r.fighter_id, l.fighter_id), greatest(r.fighter_id, l.fighter_id) ORDER BY b.id) AS k
  FROM bouts b {_SIDES} JOIN events_ e ON e.id = b.event_id),
cards AS (SELECT * FROM p WHERE k = 1 AND (date >= DATE '{_FROM}' OR low % 7 <> 0 AND high % 7 <> 0)),
new_f AS (SELECT s_suppkey AS old_id, (SELECT max(id) FROM fighters WHERE id % 7 <> 0) + row_number() OVER (ORDER BY lower(s_name), date_of_birth) AS id, lower(s_name) AS name_normalized FROM supplier JOIN fighters f ON f.id = s_suppkey WHERE f.id % 7 = 0 AND f.id IN (SELECT red_id FROM cards UNION ALL SELECT blue_id FROM cards)),
ids AS (SELECT id AS old_id, id FROM fighters WHERE id % 7 <> 0 UNION ALL SELECT old_id, id FROM new_f),
new_e AS (SELECT event_id AS old_id, (SELECT max(id) FROM events_ WHERE date < DATE '{_FROM}') + row_number() OVER (ORDER BY lower(name), date) AS id FROM (SELECT DISTINCT event_id, name, date FROM cards WHERE date >= DATE '{_FROM}')),
new_b AS (SELECT (SELECT max(id) FROM cards WHERE date < DATE '{_FROM}') + row_number() OVER (ORDER BY n.id, least(r.id, l.id), greatest(r.id, l.id)) AS id, c.id AS old_id, n.id AS event_id, r.id AS red_id, l.id AS blue_id, w.id AS winner_id, c.method, c.round, c.ending_time_seconds, c.weight_class
  FROM cards c JOIN new_e n ON n.old_id = c.event_id JOIN ids r ON r.old_id = c.red_id JOIN ids l ON l.old_id = c.blue_id LEFT JOIN ids w ON w.old_id = c.winner_id)"""


@query(_INTAKE + MAIN + "SELECT CAST(id AS INTEGER) AS id, name_normalized FROM new_f")
def intake_fighters(t: Tables) -> DataFrame:
    return _intake(t).fighters.select(F.col("id").cast("int").alias("id"), "name_normalized")


@query(_INTAKE + MAIN + "SELECT CAST(id AS INTEGER) AS id, CAST(event_id AS INTEGER) AS event_id, CAST(winner_id AS INTEGER) AS winner_id, method, CAST(round AS INTEGER) AS round, CAST(ending_time_seconds AS INTEGER) AS ending_time_seconds, weight_class FROM new_b")
def intake_bouts(t: Tables) -> DataFrame:
    return _intake(t).bouts.select(F.col("id").cast("int").alias("id"), F.col("event_id").cast("int").alias("event_id"), F.col("winner_id").cast("int").alias("winner_id"), "method", "round", "ending_time_seconds", "weight_class")


@query(_INTAKE + f""", seats AS (SELECT b.id AS bout_id, b.old_id, c.corner, c.fighter_id, {', '.join('c.' + s for s in BASE_STATS)}, CASE c.corner WHEN 'red' THEN b.red_id ELSE b.blue_id END AS own FROM new_b b JOIN bout_fighters c ON c.bout_id = b.old_id)""" + MAIN + f"""SELECT CAST((SELECT max(x.id) FROM bout_fighters x JOIN cards c ON c.id = x.bout_id WHERE c.date < DATE '{_FROM}') + row_number() OVER (ORDER BY bout_id, own) AS INTEGER) AS id, CAST(bout_id AS INTEGER) AS bout_id, CAST(own AS INTEGER) AS fighter_id, corner, {', '.join(BASE_STATS)} FROM seats""")
def intake_corners(t: Tables) -> DataFrame:
    return _intake(t).bout_fighters.select(*[F.col(c).cast("int").alias(c) for c in ("id", "bout_id", "fighter_id")], "corner", *BASE_STATS)


# ---------------------------------------------------------------- splits

_SPLITS = [s for s in SPLIT_STATS if s in ingest.SPLIT_SUFFIX]


@query(f""", f AS (SELECT b.id, b.event_id, least(r.fighter_id, l.fighter_id) AS low, greatest(r.fighter_id, l.fighter_id) AS high, row_number() OVER (PARTITION BY b.event_id, least(r.fighter_id, l.fighter_id), greatest(r.fighter_id, l.fighter_id) ORDER BY b.id) AS k FROM bouts b {_SIDES}),
g AS (SELECT f.id, f.event_id, f.low, f.high FROM f WHERE k = 1),
new AS (SELECT f.id AS bout_id, c.fighter_id, {', '.join(f'c.{s} + 1 AS {s}' for s in _SPLITS)} FROM f JOIN g ON g.event_id = f.event_id AND g.low = f.low AND g.high = f.high JOIN bout_fighters c ON c.bout_id = g.id)""" + MAIN + f"""SELECT c.bout_id, c.corner, {', '.join(f'CASE WHEN new.bout_id IS NULL THEN c.{s} ELSE new.{s} END AS {s}' for s in _SPLITS)}, CASE WHEN new.bout_id IS NULL THEN c.source ELSE 'files' END AS source FROM bout_fighters c LEFT JOIN new ON new.bout_id = c.bout_id AND new.fighter_id = c.fighter_id""")
def splits_backfill(t: Tables) -> DataFrame:
    """Splits of known bouts overwritten from the CSV file, by nulls too; of an event's bouts between the same two the file's first row counts."""
    named = t.fighters.withColumn("name_normalized", ingest.normalize_name(F.col("name")))
    text = lambda s: F.concat((F.col(s) + 1).cast("string"), F.lit(".0"))
    side = lambda c, p: t.bout_fighters.filter(F.col("corner") == c).join(t.fighters.select(F.col("id").alias("fighter_id"), F.col("name").alias(f"{p}_name")), "fighter_id").select("bout_id", f"{p}_name", *[F.coalesce(text(s), F.lit("")).alias(f"{p}_{x}") for s, x in ingest.SPLIT_SUFFIX.items()])
    rows = t.bouts.select(F.col("id").alias("bout_id"), "event_id").join(side("red", "r"), "bout_id").join(side("blue", "b"), "bout_id").join(t.events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date"), "event_id")
    rows = rows.withColumn(ORDINAL, F.col("bout_id")).withColumn("fight_id", F.col("bout_id").cast("string")).withColumn("event_id", F.col("event_id").cast("string")).withColumn("method", F.lit("DQ"))
    events = rows.select("event_id", "fight_id", F.date_format("date", "MMMM d, yyyy").alias("date"), F.lit("").alias("winner"), ORDINAL)
    done = ingest.backfill_splits(Tables(named, t.events, t.bouts, t.bout_fighters, t.rounds), rows.drop("date", "bout_id"), events)
    return done.bout_fighters.select("bout_id", "corner", *_SPLITS, "source")
