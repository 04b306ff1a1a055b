"""Registered queries over the granular tables made of the order tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.functions import display, expr
from ringside.functions.names import normalize_name
from ringside.operators import merge
from ringside.plans import features, ingest, matchup, model, reads, state
from ringside.plans.longframe import long_frame, round_rows
from ringside.schema import LONG_FRAME, METHODS, STATS, Tables
from ringside.sources import adapter
from ringside.sources.files import ORDINAL
from ringside.sources.scratch import cut, exists, stored

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DOMAIN = adapter.sql()
A, B = 1, 2  # two fighters that every scale has
MAIN = "\nMAIN:"  # stands between common table expressions and the query itself


#: Date columns of results; both sides give them as text.
DATES = {
    "event_page_desc": ["date"],
    "fighter_lookup": ["date_of_birth"],
    "fighter_history": ["event_date"],
    "history_with_opponent": ["event_date"],
    "head_to_head": ["event_date"],
    "bout_detail_corners": ["event_date"],
    "long_frame_rows": ["event_date"],
    "matchup_pivot": ["event_date_a"],
    "matchup_matrix": ["event_date_a"],
    "insert_absent": ["date_of_birth"],
    "event_upsert": ["date"],
    "temporal_split": ["event_date"],
    "gbt_train_predict": ["event_date"],
    "events_window": ["date"],
    "csv_fighters_load": ["date_of_birth"],
    "csv_events_load": ["date"],
    "csv_fields": ["born"],
    "features_read_back": ["event_date"],
    "split_boundary": ["boundary"],
}


def query(sql: str | None = None):
    """Register a function of the tables under its name; ``sql`` follows the common table expressions of the domain."""

    def add(f):
        dates = DATES.get(f.__name__, [])
        Q[f.__name__] = lambda spark, sf_dir: f(adapter.read(spark, sf_dir)).withColumns({d: F.col(d).cast("string") for d in dates})
        if sql is not None:
            made, _, last = sql.rpartition(MAIN) if MAIN in sql else ("", "", sql)
            text = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({last})" if dates else last
            SQL[f.__name__] = f"WITH {DOMAIN.strip()}{made}\n{text}"
        return f

    return add


# ---------------------------------------------------------------- lists and lookups


@query("SELECT id, name, height_cm FROM fighters WHERE name ILIKE '%00_1%' ORDER BY name, id LIMIT 20 OFFSET 1")
def fighter_list_ilike(t: Tables):
    return reads.list_fighters(t, "00_1", 20, 1).items.select("id", "name", "height_cm")


@query("SELECT id, name, stance, wins, losses, draws FROM fighters ORDER BY name, id LIMIT 5 OFFSET 3")
def fighter_page(t):
    return reads.list_fighters(t, limit=5, offset=3).items.select("id", "name", "stance", "wins", "losses", "draws")


@query("SELECT id, name FROM fighters WHERE name ILIKE '%1%' ORDER BY name, id LIMIT 8")
def fighter_suggestions(t):
    return reads.suggest_fighters(t, "1").select("id", "name")


@query("SELECT id, name, date FROM events_ ORDER BY date DESC, id DESC LIMIT 24 OFFSET 24")
def event_page_desc(t):
    return reads.list_events(t, 24, 24).items.select("id", "name", "date")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 24.0) AS INTEGER) AS pages, 2 AS page FROM fighters WHERE name ILIKE '%1%'")
def filtered_total(t):
    total = reads.named(t.fighters, "1").agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", *reads.page_info(F.col("total"), 24, 24))


@query(f"SELECT id, name, height_cm, reach_cm, stance, date_of_birth FROM fighters WHERE id = {A}")
def fighter_lookup(t):
    return reads.by_id(t.fighters, A).select("id", "name", "height_cm", "reach_cm", "stance", "date_of_birth")


@query("SELECT id, name FROM fighters WHERE id IN (SELECT fighter_id FROM bout_fighters)")
def fighters_exist_semi(t):
    return reads.existing(t, t.bout_fighters.select(F.col("fighter_id").alias("id"))).select("id", "name")


@query("SELECT f.id, f.name FROM fighters f WHERE NOT EXISTS (SELECT 1 FROM bout_fighters b WHERE b.fighter_id = f.id AND b.corner = 'blue')")
def fighters_without_bouts_anti(t):
    blue = Tables(t.fighters, t.events, t.bouts, t.bout_fighters.filter("corner = 'blue'"), t.rounds)
    return reads.without_bouts(blue).select("id", "name")


@query("SELECT (SELECT CAST(count(*) AS BIGINT) FROM fighters) AS fighters, (SELECT CAST(count(*) AS BIGINT) FROM events_) AS events, (SELECT CAST(count(*) AS BIGINT) FROM bouts) AS bouts, (SELECT CAST(count(*) AS BIGINT) FROM bout_fighters) AS bout_fighters")
def table_counts(t):
    each = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("k"), "n") for n in ("fighters", "events", "bouts", "bout_fighters")]
    union = each[0].union(each[1]).union(each[2]).union(each[3])
    return union.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in ("fighters", "events", "bouts", "bout_fighters")])


# ---------------------------------------------------------------- history, head-to-head, cards

_HIST = """, hist AS (
SELECT c.fighter_id, c.bout_id, b.event_id, e.name AS event_name, e.date AS event_date, c.corner, o.fighter_id AS opponent_id, g.name AS opponent_name,
  coalesce(b.winner_id = c.fighter_id, FALSE) AS won, b.method, b.round, b.ending_time_seconds, %s
FROM bout_fighters c JOIN fighters f ON f.id = c.fighter_id JOIN bouts b ON b.id = c.bout_id JOIN events_ e ON e.id = b.event_id
LEFT JOIN bout_fighters o ON o.bout_id = c.bout_id AND o.fighter_id <> c.fighter_id LEFT JOIN fighters g ON g.id = o.fighter_id
)""" % ", ".join(f"c.{s}" for s in STATS)  # fmt: skip


@query(_HIST + MAIN + f"SELECT * FROM hist WHERE fighter_id = {A} ORDER BY event_date, bout_id")
def fighter_history(t):
    return reads.history(t, A)


@query(_HIST + MAIN + "SELECT * FROM hist")
def history_with_opponent(t):
    return reads.history(t)


@query(f"""SELECT b.id AS bout_id, e.date AS event_date, b.winner_id, b.method, x.corner AS corner_a, y.corner AS corner_b, x.sig_strikes_landed AS sig_strikes_landed_a, y.sig_strikes_landed AS sig_strikes_landed_b
FROM bouts b JOIN events_ e ON e.id = b.event_id JOIN bout_fighters x ON x.bout_id = b.id AND x.fighter_id = {A} JOIN bout_fighters y ON y.bout_id = b.id AND y.fighter_id = {B} ORDER BY e.date, b.id""")
def head_to_head(t):
    return reads.head_to_head(t, A, B).select("bout_id", "event_date", "winner_id", "method", "corner_a", "corner_b", "sig_strikes_landed_a", "sig_strikes_landed_b")


_SOME_EVENT = "(SELECT max(event_id) FROM bouts)"


@query(f"""SELECT b.id AS bout_id, b.winner_id, b.method, c.corner, c.fighter_id, f.name AS fighter_name, CASE c.corner WHEN 'red' THEN 0 ELSE 1 END AS place
FROM bouts b LEFT JOIN bout_fighters c ON c.bout_id = b.id LEFT JOIN fighters f ON f.id = c.fighter_id WHERE b.event_id = {_SOME_EVENT} ORDER BY b.id, place""")
def event_card(t):
    event = t.bouts.agg(F.max("event_id")).first()[0]
    return reads.event_card(t, event).select("bout_id", "winner_id", "method", F.explode_outer("corners").alias("c")).select("bout_id", "winner_id", "method", "c.corner", "c.fighter_id", "c.fighter_name", F.col("c.place").alias("place"))


_SOME_BOUT = "(SELECT min(bout_id) FROM bout_fighters WHERE head_landed IS NOT NULL)"


def _some_bout(t):
    return t.bout_fighters.filter("head_landed is not null").agg(F.min("bout_id")).first()[0]


@query(f"""SELECT b.id AS bout_id, e.name AS event_name, e.date AS event_date, c.corner, c.fighter_id, {', '.join('c.' + s for s in STATS)}
FROM bouts b JOIN events_ e ON e.id = b.event_id JOIN bout_fighters c ON c.bout_id = b.id WHERE b.id = {_SOME_BOUT}""")
def bout_detail_corners(t):
    d = reads.bout_detail(t, _some_bout(t)).select("bout_id", "event_name", "event_date", F.explode("corners").alias("c"))
    return d.select("bout_id", "event_name", "event_date", "c.corner", "c.fighter_id", "c.stats.*")


@query(f"""SELECT c.corner, r.round, {', '.join('r.' + s for s in STATS)}, row_number() OVER (PARTITION BY c.corner ORDER BY r.round) - 1 AS i
FROM bout_fighters c JOIN rounds r ON r.bout_fighter_id = c.id WHERE c.bout_id = {_SOME_BOUT}""")
def bout_rounds(t):
    d = reads.bout_detail(t, _some_bout(t)).select(F.explode("corners").alias("c")).select("c.corner", F.posexplode("c.rounds").alias("i", "r"))
    return d.select("corner", F.col("i").cast("long").alias("i"), "r.*")


# ---------------------------------------------------------------- statistics

_SUMS = {k: f"coalesce(sum({k}_landed), 0)" for k in ("head", "body", "leg", "distance", "clinch", "ground")}


def _share_sql(k: str) -> str:
    group = ("head", "body", "leg") if k in ("head", "body", "leg") else ("distance", "clinch", "ground")
    return f"CAST({_SUMS[k]} AS DOUBLE) / nullif(CAST({' + '.join(_SUMS[g] for g in group)} AS DOUBLE), 0) AS {k}_share"


_CAREER = f"CAST(count(*) AS BIGINT) AS total_bouts, avg(sig_strikes_landed) AS avg_sig_strikes_landed, avg(takedowns_landed) AS avg_takedowns_landed, avg(control_time_seconds) AS avg_control_time_seconds, {', '.join(map(_share_sql, _SUMS))}"


@query(f""", career AS (SELECT fighter_id, {_CAREER} FROM bout_fighters GROUP BY fighter_id), wins AS (SELECT winner_id AS fighter_id, count(*) AS n, sum(CASE WHEN method = 'ko_tko' THEN 1 ELSE 0 END) AS k FROM bouts WHERE winner_id IS NOT NULL GROUP BY 1){MAIN}SELECT f.id AS fighter_id, coalesce(c.total_bouts, 0) AS total_bouts, {', '.join('c.' + x for x in ['avg_sig_strikes_landed', 'avg_takedowns_landed', 'avg_control_time_seconds', *[k + '_share' for k in _SUMS]])}, CAST(coalesce(w.n, 0) AS BIGINT) AS wins, CAST(coalesce(w.k, 0) AS BIGINT) AS wins_ko
FROM fighters f LEFT JOIN career c ON c.fighter_id = f.id LEFT JOIN wins w ON w.fighter_id = f.id""")
def fighter_career_stats(t):
    out = reads.fighter_stats(t)
    wins = F.aggregate(F.map_values("wins_by_method"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("wins", wins).withColumn("wins_ko", F.coalesce(F.try_element_at("wins_by_method", F.lit("ko_tko")), F.lit(0).cast("long"))).drop("wins_by_method")


@query("SELECT winner_id AS fighter_id, method, CAST(count(*) AS BIGINT) AS wins FROM bouts WHERE winner_id IS NOT NULL GROUP BY winner_id, method")
def wins_by_method(t):
    return reads.wins_by_method(t)


@query(f"SELECT fighter_id, {', '.join(map(_share_sql, _SUMS))} FROM bout_fighters WHERE fighter_id = {A} GROUP BY fighter_id")
def striking_profile(t):
    return reads.fighter_stats(t, A).select("fighter_id", *[f"{k}_share" for k in _SUMS])


_DERIVED = f"SELECT fighter_id, {_CAREER}, CAST(sum(CASE WHEN won THEN 1 ELSE 0 END) AS BIGINT) AS wins, " + ", ".join(f"CAST(sum(CASE WHEN won AND method = '{m}' THEN 1 ELSE 0 END) AS BIGINT) AS wins_{m}" for m in METHODS)


@query(_HIST + MAIN + f"{_DERIVED} FROM hist WHERE event_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY fighter_id")
def stats_recut_period(t):
    return reads.derived_stats(reads.recut(reads.history(t), "1994-01-01", "1996-12-31"))


@query(_HIST + f", lastn AS (SELECT *, row_number() OVER (PARTITION BY fighter_id ORDER BY event_date DESC, bout_id DESC) AS k FROM hist){MAIN}{_DERIVED} FROM lastn WHERE k <= 5 GROUP BY fighter_id")
def stats_recut_last_n(t):
    return reads.derived_stats(reads.recut(reads.history(t), last_n=5))


@query(f"SELECT winner_id AS fighter_id, CAST(list_position([{', '.join(repr(m) for m in METHODS)}], method) AS INTEGER) AS place, method, CAST(count(*) AS BIGINT) AS wins FROM bouts WHERE winner_id IS NOT NULL GROUP BY winner_id, method")
def finish_segments(t):
    return reads.finish_segments(t)


# ---------------------------------------------------------------- features

_LONG = f""", lf AS (
SELECT c.fighter_id, f.name AS fighter_name, b.event_id, e.name AS event_name, e.date AS event_date, c.bout_id, c.corner,
  CASE WHEN b.winner_id IS NOT NULL THEN CASE WHEN b.winner_id = c.fighter_id THEN 'win' ELSE 'loss' END WHEN b.method = 'no_contest' THEN 'no_contest' ELSE 'draw' END AS result,
  b.method, b.round, b.ending_time_seconds, {', '.join('c.' + s for s in STATS)}, c.source
FROM bout_fighters c JOIN bouts b ON b.id = c.bout_id JOIN events_ e ON e.id = b.event_id JOIN fighters f ON f.id = c.fighter_id
)"""
_PR, _R3, _O = "(w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "w"


def _s3(x: str) -> str:
    return f"CAST(sum({x}) OVER {_R3} AS DOUBLE)"


def _share3(k: str) -> str:
    group = features.TARGETS if k in features.TARGETS else features.POSITIONS
    return f"{_s3(k + '_landed')} / nullif({' + '.join(_s3(g + '_landed') for g in group)}, 0)"


_FEATURE_SQL = {
    "win_rate_prior": f"avg(CASE result WHEN 'win' THEN 1.0::DOUBLE WHEN 'loss' THEN 0.0::DOUBLE END) OVER {_PR}",
    "finish_rate_prior": f"avg(CASE WHEN result = 'win' AND method IN ('ko_tko', 'submission') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER {_PR}",
    "win_streak_prior": "CAST(CASE WHEN np = 0 THEN NULL WHEN coalesce(lw, 0) > coalesce(ll, 0) THEN np - coalesce(ll, 0) ELSE -(np - coalesce(lw, 0)) END AS INTEGER)",
    "sig_strikes_landed_pm_r3": f"{_s3('sig_strikes_landed')} / nullif({_s3('secs')} / 60.0::DOUBLE, 0)",
    "sig_strikes_absorbed_pm_r3": f"{_s3('o_sig')} / nullif({_s3('secs')} / 60.0::DOUBLE, 0)",
    "takedowns_landed_avg_r3": f"avg(takedowns_landed) OVER {_R3}",
    "takedown_defense_r3": f"1.0::DOUBLE - {_s3('o_td')} / nullif({_s3('o_tried')}, 0)",
    "control_time_avg_r3": f"avg(control_time_seconds) OVER {_R3}",
    **{f"share_{k}_r3": _share3(k) for k in features.TARGETS + features.POSITIONS},
    "round1_sig_strike_share_r3": f"round(avg(r1) OVER {_R3}, 6)",
    "age_years": "CAST(year(event_date) - year(date_of_birth) - CASE WHEN (month(event_date), day(event_date)) < (month(date_of_birth), day(date_of_birth)) THEN 1 ELSE 0 END AS INTEGER)",
    "layoff_days": "CAST(date_diff('day', lag(event_date) OVER w, event_date) AS INTEGER)",
    "career_bouts_before": "CAST(row_number() OVER w - 1 AS INTEGER)",
    "height_cm": "height_cm",
    "reach_cm": "reach_cm",
    "stance": "stance",
}
_ENRICHED = (
    _LONG
    + f""", rr AS (SELECT c.bout_id, c.fighter_id, CAST(sum(CASE WHEN r.round = 1 THEN r.sig_strikes_landed END) AS DOUBLE) / nullif(CAST(sum(r.sig_strikes_landed) AS DOUBLE), 0) AS r1 FROM rounds r JOIN bout_fighters c ON c.id = r.bout_fighter_id GROUP BY c.bout_id, c.fighter_id),
e0 AS (SELECT lf.*, o.sig_strikes_landed AS o_sig, o.takedowns_landed AS o_td, o.takedowns_attempted AS o_tried, rr.r1, g.date_of_birth, g.height_cm, g.reach_cm, g.stance, (lf.round - 1) * 300 + lf.ending_time_seconds AS secs,
  count(CASE WHEN lf.result IN ('win', 'loss') THEN 1 END) OVER (PARTITION BY lf.fighter_id ORDER BY lf.event_date, lf.bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nd
  FROM lf LEFT JOIN lf o ON o.bout_id = lf.bout_id AND o.fighter_id <> lf.fighter_id LEFT JOIN rr ON rr.bout_id = lf.bout_id AND rr.fighter_id = lf.fighter_id LEFT JOIN fighters g ON g.id = lf.fighter_id),
e1 AS (SELECT *, count(CASE WHEN result IN ('win', 'loss') THEN 1 END) OVER {_PR} AS np, max(CASE WHEN result = 'win' THEN nd END) OVER {_PR} AS lw, max(CASE WHEN result = 'loss' THEN nd END) OVER {_PR} AS ll FROM e0 WINDOW w AS (PARTITION BY fighter_id ORDER BY event_date, bout_id)),
enriched AS (SELECT {', '.join(LONG_FRAME)}, {', '.join(f'{v} AS {k}' if k != v else k for k, v in _FEATURE_SQL.items())} FROM e1 WINDOW w AS (PARTITION BY fighter_id ORDER BY event_date, bout_id))"""
)


_ROUNDED = {"round1_sig_strike_share_r3"}


def enriched(t: Tables) -> DataFrame:
    return features.add_features(long_frame(t), t.fighters, shares=features.corner_shares(t))


@query(_LONG + MAIN + "SELECT * FROM lf")
def long_frame_rows(t):
    return long_frame(t)


@query(", " + "rr AS (SELECT c.bout_id, c.fighter_id, r.round AS round_number, r.sig_strikes_landed FROM rounds r JOIN bout_fighters c ON c.id = r.bout_fighter_id)" + MAIN + "SELECT * FROM rr")
def round_stats(t):
    return round_rows(t)



def _feature_query(name: str, columns: list[str]):
    def f(t):
        return enriched(t).select("fighter_id", "bout_id", *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in columns])

    f.__name__ = name
    query(_ENRICHED + MAIN + f"SELECT fighter_id, bout_id, {', '.join(columns)} FROM enriched")(f)


for _name, _columns in {
    "prior_win_rate": ["win_rate_prior"],
    "prior_finish_rate": ["finish_rate_prior"],
    "prior_streak": ["win_streak_prior"],
    "rolling_strikes_pm": ["sig_strikes_landed_pm_r3"],
    "rolling_absorbed_pm": ["sig_strikes_absorbed_pm_r3"],
    "rolling_takedowns": ["takedowns_landed_avg_r3"],
    "takedown_defense": ["takedown_defense_r3"],
    "control_time_avg": ["control_time_avg_r3"],
    "striking_share_target": [f"share_{k}_r3" for k in features.TARGETS],
    "striking_share_position": [f"share_{k}_r3" for k in features.POSITIONS],
    "round1_share": ["round1_sig_strike_share_r3"],
    "age_years": ["age_years"],
    "layoff_days": ["layoff_days"],
    "career_bouts_before": ["career_bouts_before"],
    "physical_attrs": ["height_cm", "reach_cm", "stance"],
}.items():
    _feature_query(_name, _columns)

_SINCE = "1995-06-17"


@query(_ENRICHED + MAIN + f"SELECT fighter_id, bout_id, {', '.join(features.FEATURES)} FROM enriched WHERE event_date >= DATE '{_SINCE}'")
def features_after_append(t):
    """The features of all later bouts from the states of their fighters after the earlier ones; no earlier corner is read for them."""
    frame, shares, later = long_frame(t).select(*features.LOOKED_AT), features.corner_shares(t), F.col("event_date") >= F.lit(_SINCE).cast("date")
    rows = stored(features.prepared(frame, shares), "prepared")  # corners, bouts and rounds meet once for all
    states = stored(state.states_of(frame, shares, rows.filter(~later)), "states")
    out = state.advance(states, frame, t.fighters, shares, rows.filter(later)).features
    return out.select("fighter_id", "bout_id", *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in features.FEATURES])


# ---------------------------------------------------------------- matchups

_PIVOT = _ENRICHED + ", red AS (SELECT * FROM enriched WHERE corner = 'red'), blue AS (SELECT * FROM enriched WHERE corner = 'blue')"
_ON = " FROM red a JOIN blue b ON a.bout_id = b.bout_id"
_T = "CASE a.result WHEN 'win' THEN 'R' WHEN 'loss' THEN 'B' END"


@query(_PIVOT + MAIN + "SELECT a.bout_id, a.fighter_id AS fighter_id_a, b.fighter_id AS fighter_id_b, a.result AS result_a, b.result AS result_b, a.event_date AS event_date_a, a.sig_strikes_landed AS sig_strikes_landed_a, b.sig_strikes_landed AS sig_strikes_landed_b" + _ON)
def matchup_pivot(t):
    return matchup.pivot_corners(long_frame(t)).select("bout_id", "fighter_id_a", "fighter_id_b", "result_a", "result_b", "event_date_a", "sig_strikes_landed_a", "sig_strikes_landed_b")


_DIFFS = [c for c in features.NUMERIC if c not in _ROUNDED]


@query(_PIVOT + MAIN + f"SELECT a.bout_id, {', '.join(f'a.{c} - b.{c} AS {c}_diff' for c in _DIFFS)}" + _ON)
def matchup_differentials(t):
    return matchup.add_differentials(matchup.pivot_corners(enriched(t))).select("bout_id", *[f"{c}_diff" for c in _DIFFS])


@query(_LONG + MAIN + f"SELECT a.bout_id, {_T} AS winner_corner FROM lf a JOIN lf b ON a.bout_id = b.bout_id WHERE a.corner = 'red' AND b.corner = 'blue'")
def matchup_target(t):
    return matchup.pivot_corners(long_frame(t).select("bout_id", "corner", "result")).select("bout_id", matchup.target().alias("winner_corner"))


_BASE = _LONG + f", t AS (SELECT {_T} AS t FROM lf a JOIN lf b ON a.bout_id = b.bout_id WHERE a.corner = 'red' AND b.corner = 'blue')"


@query(_BASE + MAIN + "SELECT avg(CASE t WHEN 'R' THEN 1.0::DOUBLE WHEN 'B' THEN 0.0::DOUBLE END) AS red_corner_win_rate, CAST(count(t) AS BIGINT) AS decided FROM t")
def red_corner_baseline(t):
    return matchup.baseline(long_frame(t)).select("red_corner_win_rate", "decided")


@query(_BASE + MAIN + "SELECT CAST(count(*) - count(t) AS BIGINT) AS excluded_no_result FROM t")
def excluded_no_result(t):
    return matchup.baseline(long_frame(t)).select("excluded_no_result")


_KEEP = ["bout_id", "event_date_a", "fighter_id_a", "fighter_id_b"]


@query(_PIVOT + MAIN + "SELECT a.bout_id, a.event_date AS event_date_a, a.fighter_id AS fighter_id_a, b.fighter_id AS fighter_id_b, " + ", ".join([f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in features.FEATURES if c not in _ROUNDED] + [f"a.{c} - b.{c} AS {c}_diff" for c in _DIFFS]) + f", a.round1_sig_strike_share_r3 AS round1_sig_strike_share_r3_a, b.round1_sig_strike_share_r3 AS round1_sig_strike_share_r3_b, {_T} AS winner_corner" + _ON + " WHERE a.result IN ('win', 'loss')")
def matchup_matrix(t):
    """The flagship: all features of both corners and their differences (but that of the rounded one)."""
    frame = matchup.matrix(enriched(t)).frame
    kept = [c for c in matchup.feature_columns(frame.columns) if not c.endswith("_diff") or c[:-5] not in _ROUNDED]
    return frame.select(*_KEEP, *[F.round(c, 6).alias(c) if c.rsplit("_", 1)[0] in _ROUNDED else F.col(c) for c in kept], matchup.TARGET)


# ---------------------------------------------------------------- ingestion


def fights_csv(t: Tables) -> DataFrame:
    """Bouts as rows of the CSV file: texts, with dirty names, and a row ordinal."""
    red = t.bout_fighters.filter("corner = 'red'").join(t.fighters.select(F.col("id").alias("fighter_id"), F.col("name").alias("r_name")), "fighter_id")
    blue = t.bout_fighters.filter("corner = 'blue'").join(t.fighters.select(F.col("id").alias("fighter_id"), F.col("name").alias("b_name")), "fighter_id")
    cols = lambda p: [F.concat(F.col(s).cast("string"), F.lit(".0")).alias(f"{p}_{x}") for s, x in ingest.STAT_SUFFIX.items()]
    out = t.bouts.select(F.col("id").alias("bout_id"), "event_id", "method", F.col("round").cast("string").alias("finish_round"))
    return out.join(red.select("bout_id", "r_name", F.col("fighter_id").alias("red_id"), *cols("r")), "bout_id").join(blue.select("bout_id", "b_name", F.col("fighter_id").alias("blue_id"), *cols("b")), "bout_id").withColumn(ORDINAL, F.col("bout_id"))


@query(f"SELECT c.bout_id, c.corner, c.fighter_id, {', '.join('c.' + s for s in ingest.STAT_SUFFIX)} FROM bout_fighters c")
def wide_to_long(t):
    return ingest.wide_to_long(fights_csv(t), ingest.STAT_SUFFIX).select("bout_id", "corner", "fighter_id", *ingest.STAT_SUFFIX)


@query("SELECT event_id, min(id) AS bout_id, arg_min(method, id) AS method FROM bouts GROUP BY event_id")
def first_wins_dedup(t):
    return merge.first_by_key(t.bouts.withColumn(ORDINAL, F.col("id")), ["event_id"]).select("event_id", F.col("id").alias("bout_id"), "method")


@query("SELECT event_id, max(id) AS bout_id, arg_max(method, id) AS method FROM bouts GROUP BY event_id")
def last_wins_lookup(t):
    return merge.last_by_key(t.bouts.withColumn(ORDINAL, F.col("id")), ["event_id"]).select("event_id", F.col("id").alias("bout_id"), "method")


@query("SELECT 'born ' || CAST(year(date_of_birth) AS VARCHAR) || ' ' || stance AS name_normalized, min(id) AS id FROM fighters WHERE stance IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def unique_name_index(t):
    named = t.fighters.filter("stance is not null").select(F.concat(F.lit("born "), F.year("date_of_birth").cast("string"), F.lit(" "), F.col("stance")).alias("name_normalized"), "id")
    return merge.unique_only(named, "name_normalized", "id")


@query("SELECT c.bout_id, b.event_id, min(c.fighter_id) AS low_id, max(c.fighter_id) AS high_id FROM bout_fighters c JOIN bouts b ON b.id = c.bout_id GROUP BY c.bout_id, b.event_id HAVING count(*) = 2")
def bout_key_index(t):
    return ingest.bout_index(t.bouts, t.bout_fighters)


@query(""", old AS (SELECT id, name_normalized, date_of_birth FROM fighters WHERE id % 3 <> 0), fresh AS (SELECT name_normalized, date_of_birth FROM fighters WHERE id % 3 = 0),
n AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY name_normalized, date_of_birth) AS id, * FROM fresh)""" + MAIN + """SELECT CAST(id AS BIGINT) AS id, name_normalized, date_of_birth FROM (SELECT * FROM old UNION ALL SELECT * FROM n)""")
def insert_absent(t):
    cols = ["id", "name_normalized", "date_of_birth"]
    old, new = t.fighters.filter("id % 3 <> 0").select(*cols), t.fighters.select(*cols[1:])
    return merge.insert_absent(old, new, cols[1:])


@query("SELECT bout_id, fighter_id, CASE WHEN corner = 'red' THEN CASE WHEN knockdowns = 0 THEN NULL ELSE sig_strikes_landed END ELSE head_landed END AS head_landed, CASE WHEN corner = 'red' THEN 'files' ELSE source END AS source FROM bout_fighters")
def update_only_backfill(t):
    """The file has all red corners, some without a number, and as many of unknown bouts, which are not inserted."""
    new = t.bout_fighters.filter("corner = 'red'").select("bout_id", "fighter_id", F.when(F.col("knockdowns") != 0, F.col("sig_strikes_landed")).alias("head_landed"), F.lit("files").alias("source"))
    extra = new.withColumn("bout_id", -F.col("bout_id") - 1)
    return merge.update_only(t.bout_fighters, new.union(extra), ["bout_id", "fighter_id"], ["head_landed", "source"]).select("bout_id", "fighter_id", "head_landed", "source")


@query(""", old AS (SELECT id, name, date FROM events_ WHERE id % 2 = 0), fresh AS (SELECT upper(name) AS name, date FROM events_ WHERE id % 2 <> 0), n AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY name, date) AS id, * FROM fresh)""" + MAIN + """SELECT CAST(id AS BIGINT) AS id, name, date FROM (SELECT * FROM old UNION ALL SELECT * FROM n)""")
def event_upsert(t):
    """All events once more in capitals: those that are there already are found by their normalised names."""
    old, heads = t.events.filter("id % 2 = 0").select("id", "name", "date"), t.events.select(F.upper("name").alias("name"), "date")
    return old.unionByName(ingest.absent_events(old, heads).drop("name_key"))


def _fight_names(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Fights and events as CSV texts; every fifth bout has an unknown red fighter, every seventh an event of no known date."""
    f = fights_csv(t).join(t.events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date"), "event_id")
    f = f.withColumn("r_name", F.when(F.col("bout_id") % 5 == 0, F.concat("r_name", F.lit(" nobody"))).otherwise(F.col("r_name"))).withColumn("fight_id", F.col("bout_id").cast("string"))
    f = f.withColumn("event_id", F.when(F.col("bout_id") % 7 == 0, F.lit("none")).otherwise(F.col("event_id").cast("string")))
    events = f.select("event_id", "fight_id", F.date_format("date", "MMMM d, yyyy").alias("date"), F.col("b_name").alias("winner"), ORDINAL).withColumn("date", F.when(F.col("event_id") != "none", F.col("date")).otherwise("no date"))
    return f.drop("date", "red_id", "blue_id").withColumn("method", F.lit("KO/TKO")), events


@query("""SELECT b.id AS bout_id, CASE WHEN b.id % 5 <> 0 THEN r.fighter_id END AS red_id, l.fighter_id AS blue_id, CASE WHEN b.id % 7 <> 0 THEN b.event_id END AS event_key, b.id % 5 <> 0 AND b.id % 7 <> 0 AS resolved, l.fighter_id AS winner_id
FROM bouts b JOIN bout_fighters r ON r.bout_id = b.id AND r.corner = 'red' JOIN bout_fighters l ON l.bout_id = b.id AND l.corner = 'blue'""")
def fk_resolution_rejects(t):
    fights, events = _fight_names(t)
    keyed = t.fighters.withColumn("name_normalized", normalize_name(F.col("name")))
    return ingest.resolved_fights(fights, events, keyed, t.events).select("bout_id", "red_id", "blue_id", "event_key", ingest.is_resolved().alias("resolved"), "winner_id")


@query(""", k AS (SELECT id, 'n' || CAST(id % 10 AS VARCHAR) || CASE WHEN id % 10 > 5 THEN CAST(id AS VARCHAR) ELSE '' END AS nm, CASE WHEN id % 4 <> 0 THEN DATE '1990-01-01' + CAST(id % 6 AS INTEGER) END AS dob FROM fighters),
c AS (SELECT id AS candidate, 'n' || CAST(id % 12 AS VARCHAR) || CASE WHEN id % 12 > 5 THEN CAST(id AS VARCHAR) ELSE '' END AS nm, CASE WHEN id % 3 <> 0 THEN DATE '1990-01-01' + CAST(id % 5 AS INTEGER) END AS dob FROM fighters),
j AS (SELECT c.candidate, c.dob, count(k.id) AS same, count(CASE WHEN k.dob = c.dob THEN 1 END) AS exact, count(CASE WHEN k.id IS NOT NULL AND k.dob IS NULL THEN 1 END) AS undated, min(CASE WHEN k.dob = c.dob THEN k.id END) AS exact_id, min(k.id) AS any_id FROM c LEFT JOIN k ON k.nm = c.nm GROUP BY c.candidate, c.dob),
s AS (SELECT *, CASE WHEN same = 0 THEN 'new' WHEN dob IS NOT NULL THEN CASE WHEN exact = 1 THEN 'match' WHEN exact > 1 OR undated > 0 THEN 'ambiguous' ELSE 'new' END WHEN same = 1 THEN 'match' ELSE 'ambiguous' END AS status FROM j)""" + MAIN + """SELECT candidate, status, CASE WHEN status = 'match' THEN CASE WHEN dob IS NOT NULL THEN exact_id ELSE any_id END END AS fighter_id FROM s""")
def entity_match_status(t):
    name = lambda m: F.concat(F.lit("n"), (F.col("id") % m).cast("string"), F.when(F.col("id") % m > 5, F.col("id").cast("string")).otherwise(""))
    born = lambda unless, m: F.when(F.col("id") % unless != 0, F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % m).cast("int")))
    known = t.fighters.select("id", name(10).alias("name_normalized"), born(4, 6).alias("date_of_birth"))
    candidates = t.fighters.select(F.col("id").alias("candidate"), name(12).alias("name_normalized"), born(3, 5).alias("date_of_birth"))
    return ingest.match_fighters(candidates, known).select("candidate", "status", "fighter_id")


@query(f""", own AS (SELECT DISTINCT fighter_id FROM bout_fighters c JOIN bouts b ON b.id = c.bout_id WHERE b.event_id = {_SOME_EVENT}){MAIN}SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(own.fighter_id) AS BIGINT) AS matched, CAST(count(own.fighter_id) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS coverage FROM fighters f LEFT JOIN own ON own.fighter_id = f.id""")
def match_coverage(t):
    """Lines of all fighters against one event's corners."""
    event = t.bouts.agg(F.max("event_id")).first()[0]
    lines = t.fighters.select(_slug(F.col("name")).alias("fighter_slug"))
    # A fighter may have several corners in these events, which the matching of real cards rejects: one corner each is kept.
    single = merge.first_by_key(t.bout_fighters.join(t.bouts.filter(F.col("event_id") == event).select(F.col("id").alias("bout_id")), "bout_id").withColumn(ORDINAL, F.col("id")), ["fighter_id"]).drop(ORDINAL)
    return ingest.coverage(ingest.matched_lines(Tables(_keyed(t.fighters), t.events, t.bouts, single, t.rounds), event, lines))


def _slug(name):
    return F.lower(F.replace(F.replace(name, F.lit("#"), F.lit("-")), F.lit(" "), F.lit("-")))


def _keyed(fighters: DataFrame) -> DataFrame:
    return fighters.withColumn("name_normalized", normalize_name(F.replace("name", F.lit("#"), F.lit(" "))))


_ONCE = """, seats AS (SELECT c.id, c.bout_id, c.fighter_id, c.corner, b.event_id, count(*) OVER (PARTITION BY b.event_id, c.fighter_id) AS n FROM bout_fighters c JOIN bouts b ON b.id = c.bout_id),
once AS (SELECT * FROM seats WHERE n = 1)"""


@query(_ONCE + """, lines AS (SELECT o.id AS bout_fighter_id, r.round, r.sig_strikes_landed FROM once o JOIN rounds r ON r.bout_fighter_id = o.id),
kept AS (SELECT * FROM rounds WHERE round % 2 = 0), n AS (SELECT (SELECT max(id) FROM kept) + row_number() OVER (ORDER BY bout_fighter_id, round) AS id, *, 'documents' AS source FROM lines l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.bout_fighter_id = l.bout_fighter_id AND k.round = l.round))""" + MAIN + """SELECT CAST(id AS BIGINT) AS id, bout_fighter_id, round, sig_strikes_landed, source FROM n""")
def backfill_rounds(t):
    """Lines of all events, by the slug of their fighter: of rounds that are there already nothing is added."""
    seats = t.bout_fighters.join(t.bouts.select(F.col("id").alias("bout_id"), "event_id"), "bout_id")
    once = seats.groupBy("event_id", "fighter_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    corners = seats.join(once, ["event_id", "fighter_id"], "left_semi")
    lines = corners.select(F.col("id").alias("bout_fighter_id"), F.col("event_id").alias("__event"), "fighter_id").join(t.fighters.select(F.col("id").alias("fighter_id"), _slug(F.col("name")).alias("fighter_slug")), "fighter_id")
    lines = lines.join(t.rounds.select("bout_fighter_id", "round", *STATS), "bout_fighter_id").drop("bout_fighter_id", "fighter_id")
    own = Tables(_keyed(t.fighters), t.events, t.bouts, corners.select(*t.bout_fighters.columns), t.rounds.filter("round % 2 = 0"))
    return ingest.rounds_to_add(own, ingest.matched_lines_of(own, lines)).select("id", "bout_fighter_id", "round", "sig_strikes_landed", "source")


@query("SELECT id, date, 'ufc-' || CAST(id AS VARCHAR) AS slug FROM events_ WHERE id % 3 <> 0 AND date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31' UNION ALL SELECT id, date, NULL FROM events_ WHERE id % 3 = 0 AND date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'")
def events_window(t):
    named = t.events.withColumn("name", F.when(F.col("id") % 3 != 0, F.concat(F.lit("UFC "), F.col("id").cast("string"))).otherwise(F.col("name")))
    return ingest.events_between(named, "1993-01-01", "1995-12-31").select("id", "date", "slug")


@query("""SELECT row_number() OVER (ORDER BY name_normalized, date_of_birth) AS id, name, name_normalized, date_of_birth, height_cm, reach_cm, stance, CAST(wins AS INTEGER) AS wins
FROM (SELECT s_name AS name, lower(s_name) AS name_normalized, date_of_birth, height_cm, reach_cm, stance, wins FROM fighters JOIN supplier ON s_suppkey = id)""")
def csv_fighters_load(t):
    """Each fighter twice, as rows of the CSV file: the second one differs in spelling and is left out."""
    text = lambda c: F.coalesce(F.concat(F.col(c).cast("string"), F.lit(".0")), F.lit(""))
    rows = t.fighters.select(F.concat(F.lit(" "), "name").alias("name"), F.lit("").alias("nick_name"), F.date_format("date_of_birth", "MMM d, yyyy").alias("dob"), text("height_cm").alias("height"), text("reach_cm").alias("reach"), F.initcap(F.coalesce("stance", F.lit("Open"))).alias("stance"), text("wins").alias("wins"), text("losses").alias("losses"), text("draws").alias("draws"), (F.col("id") * 2).alias(ORDINAL))
    again = rows.withColumn("name", F.concat(F.upper(F.trim("name")), F.lit(" Jr."))).withColumn("height", F.lit("100")).withColumn(ORDINAL, F.col(ORDINAL) + 1)
    none = t.fighters.limit(0)
    return ingest.load_fighters(none, rows.union(again)).select("id", "name", "name_normalized", "date_of_birth", "height_cm", "reach_cm", "stance", "wins")


@query("""SELECT row_number() OVER (ORDER BY name, date) AS id, name, date, 'Rio, Brazil' AS location FROM (SELECT 'Last ' || name AS name, date FROM events_ WHERE id IN (SELECT event_id FROM bouts))""")
def csv_events_load(t):
    """Events by their bouts' rows: the date of the first row, the name of the last one."""
    rows = t.bouts.join(t.events.select(F.col("id").alias("event_id"), "name", "date"), "event_id").withColumn("last", F.max("id").over(Window.partitionBy("event_id")))
    fights = rows.select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("id") == F.col("last"), F.concat(F.lit("Last "), "name")).otherwise("An earlier name").alias("event_name"), F.col("id").alias(ORDINAL))
    first = F.col("id") == F.min("id").over(Window.partitionBy("event_id"))
    events = rows.select(F.col("event_id").cast("string").alias("event_id"), F.when(first, F.date_format("date", "MMMM d, yyyy")).otherwise("May 1, 2001").alias("date"), F.lit(" Rio, Brazil").alias("location"), F.col("id").alias(ORDINAL))
    # An event with one bout has its name and date from the same row.
    return ingest.load_events(t.events.limit(0), fights, events).select("id", "name", "date", "location")


@query(""", f AS (SELECT b.id AS bout_id, b.event_id, b.round, b.ending_time_seconds AS secs, b.weight_class, r.fighter_id AS red_id, l.fighter_id AS blue_id, least(r.fighter_id, l.fighter_id) AS low_id, greatest(r.fighter_id, l.fighter_id) AS high_id
FROM bouts b JOIN bout_fighters r ON r.bout_id = b.id AND r.corner = 'red' JOIN bout_fighters l ON l.bout_id = b.id AND l.corner = 'blue' WHERE b.id % 5 <> 0 AND b.id % 7 <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY event_id, low_id, high_id ORDER BY bout_id) AS k FROM f)""" + MAIN + """SELECT row_number() OVER (ORDER BY event_id, low_id, high_id) AS id, CAST(event_id AS INTEGER) AS event_id, CAST(blue_id AS INTEGER) AS winner_id, 'ko_tko' AS method, CAST(round AS INTEGER) AS round, CAST(secs AS INTEGER) AS ending_time_seconds, weight_class, CAST(5 AS INTEGER) AS scheduled_rounds FROM g WHERE k = 1""")
def csv_bouts_load(t):
    """All resolved fights of the file as bouts, one for each event and pair of fighters."""
    fights, events = _fight_names(t)
    more = t.bouts.select(F.col("id").alias("bout_id"), F.col("ending_time_seconds").cast("string").alias("match_time_sec"), F.col("weight_class").alias("division"), F.lit("5.0").alias("total_rounds"))
    own = Tables(t.fighters.withColumn("name_normalized", normalize_name(F.col("name"))), t.events, t.bouts.limit(0), t.bout_fighters.limit(0), t.rounds.limit(0))
    loaded, _ = ingest.load_bouts(own, fights.join(more, "bout_id").drop("bout_id"), events)
    return loaded.bouts.select("id", "event_id", "winner_id", "method", "round", "ending_time_seconds", "weight_class", "scheduled_rounds")


# ---------------------------------------------------------------- parsers


@query("SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 50 AS INTEGER) END AS landed, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 50 + 3 AS INTEGER) END AS attempted FROM bouts")
def parse_stat(t):
    text = F.when(F.col("id") % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), (F.col("id") % 50).cast("string"), F.lit(" of "), (F.col("id") % 50 + 3).cast("string")))
    return t.bouts.select("id", expr.parse_stat(text).alias("p")).select("id", "p.landed", "p.attempted")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE ending_time_seconds END AS seconds, CASE WHEN id % 6 <> 0 THEN CAST(ending_time_seconds // 60 AS VARCHAR) || ':' || lpad(CAST(ending_time_seconds % 60 AS VARCHAR), 2, '0') END AS text FROM bouts")
def parse_clock(t):
    text = expr.clock_text(F.when(F.col("id") % 6 != 0, F.col("ending_time_seconds")))
    return t.bouts.select("id", expr.parse_clock(F.coalesce(text, F.lit("--"))).alias("seconds"), text.alias("text"))


@query("SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(CASE WHEN (id % 40) % 2 = 0 THEN id % 40 // 2 ELSE 2 * ((id % 40 // 2 + 1) // 2) END AS INTEGER) END AS number, CASE WHEN id % 5 = 0 OR id % 6 = 0 THEN NULL ELSE CAST(id % 40 AS INTEGER) END AS lenient FROM bouts")
def parse_number_half_even(t):
    halves = F.when(F.col("id") % 6 == 0, F.lit("")).otherwise(((F.col("id") % 40) / 2.0).cast("string"))
    dirty = F.when(F.col("id") % 6 == 0, F.lit(" ")).when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise(F.concat((F.col("id") % 40).cast("string"), F.lit(".0")))
    return t.bouts.select("id", expr.int_strict(halves).alias("number"), expr.int_lenient(dirty).alias("lenient"))


_TOKENS = [*expr.CSV_METHODS, "unknown"]


@query(f"SELECT id, [{', '.join(repr(expr.CSV_METHODS.get(x, 'no_contest')) for x in _TOKENS)}][CAST(id % {len(_TOKENS)} AS INTEGER) + 1] AS method FROM bouts")
def method_map(t):
    token = F.element_at(F.array(*[F.lit(x) for x in _TOKENS]), (F.col("id") % len(_TOKENS) + 1).cast("int"))
    return t.bouts.select("id", expr.method_of(token, expr.CSV_METHODS).alias("method"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'ufc-' || CAST(id AS VARCHAR) END AS slug FROM bouts")
def event_slug(t):
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" Ufc "), F.col("id").cast("string"), F.lit(": A vs B"))).otherwise(F.concat(F.lit("Fight Night "), F.col("id").cast("string")))
    return t.bouts.select("id", expr.event_slug(name).alias("slug"))


@query("SELECT id, 'ukasz ' || lower(name) AS name_normalized FROM fighters")
def name_keys(t):
    return t.fighters.select("id", normalize_name(F.concat(F.lit("Łukász  "), F.col("name"), F.lit(" Jr."))).alias("name_normalized"))


@query("SELECT id, 'R' || CAST(round AS VARCHAR) || ' ' || CAST(ending_time_seconds // 60 AS VARCHAR) || ':' || lpad(CAST(ending_time_seconds % 60 AS VARCHAR), 2, '0') AS ending, CASE method WHEN 'ko_tko' THEN 'KO/TKO' WHEN 'submission' THEN 'Finalização' WHEN 'decision' THEN 'Decisão' WHEN 'dq' THEN 'Desqualificação' ELSE 'No contest' END AS method FROM bouts")
def display_texts(t):
    return t.bouts.select("id", display.ending_time(F.col("round"), F.col("ending_time_seconds")).alias("ending"), display.label(F.col("method"), display.METHOD_LABELS).alias("method"))


@query("""SELECT id, wins || '-' || losses || '-' || draws AS record, CASE stance WHEN 'orthodox' THEN 'Ortodoxa' WHEN 'southpaw' THEN 'Canhota' WHEN 'switch' THEN 'Alternada' ELSE '—' END AS stance, height_cm || ' cm' AS height, coalesce(reach_cm || ' cm', '—') AS reach,
CASE WHEN id % 4 = 0 THEN '—' WHEN id % 4 = 1 THEN CAST(id AS VARCHAR) || ' kg' ELSE CAST(id AS VARCHAR) || ',3 kg' END AS weight FROM fighters""")
def display_fighters(t):
    weight = F.when(F.col("id") % 4 == 1, F.col("id") * 1.0).when(F.col("id") % 4 > 1, F.col("id") + 0.25 + 0.01)
    return t.fighters.select("id", display.record(F.col("wins"), F.col("losses"), F.col("draws")).alias("record"), display.label(F.col("stance"), display.STANCE_LABELS).alias("stance"), display.centimetres(F.col("height_cm")).alias("height"), display.centimetres(F.col("reach_cm")).alias("reach"), display.kilograms(weight).alias("weight"))


@query(_HIST + MAIN + """SELECT fighter_id, bout_id, CASE WHEN won THEN 'Vitória' WHEN method = 'no_contest' THEN 'Sem resultado' ELSE 'Derrota' END AS result, CAST(control_time_seconds // 60 AS VARCHAR) || ':' || lpad(CAST(control_time_seconds % 60 AS VARCHAR), 2, '0') AS control,
coalesce(CAST(head_landed AS VARCHAR), '—') || CASE WHEN head_landed IS NULL AND head_attempted IS NULL THEN '' ELSE ' de ' || coalesce(CAST(head_attempted AS VARCHAR), '—') END AS head FROM hist""")
def display_bouts(t):
    return reads.history(t).select("fighter_id", "bout_id", display.result(F.col("won"), F.col("method")).alias("result"), display.average_control(F.col("control_time_seconds")).alias("control"), display.attempts(F.col("head_landed"), F.col("head_attempted")).alias("head"))


@query("""SELECT b.id AS bout_id, CASE WHEN b.method = 'no_contest' THEN 'no_contest' WHEN b.winner_id IS NULL THEN 'draw' ELSE 'winner' END AS kind, CASE WHEN b.method <> 'no_contest' THEN f.name END AS winner_name
FROM bouts b LEFT JOIN fighters f ON f.id = b.winner_id""")
def bout_results(t):
    return reads.bout_results(t)


@query("""SELECT id, CASE id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE WHEN id % 3 <> 0 THEN date_of_birth END AS born, CASE WHEN id % 5 <> 0 THEN CAST(2 * ((height_cm + 1) // 2) AS INTEGER) END AS height_cm, CASE WHEN stance IN ('orthodox', 'southpaw') THEN stance END AS stance, CASE WHEN id % 3 <> 0 THEN 'n ' || id END AS nickname FROM (SELECT *, CASE WHEN height_cm % 2 = 0 THEN height_cm ELSE height_cm END AS h FROM fighters)""")
def csv_fields(t):
    """Fields of the CSV files back into values; heights such as 151.5 go to the even number."""
    flag = F.element_at(F.array(F.lit("1.0"), F.lit(" 0"), F.lit("yes"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    half = F.when(F.col("height_cm") % 2 == 0, F.col("height_cm").cast("string")).otherwise(F.concat(F.col("height_cm").cast("string"), F.lit(".5")))
    return t.fighters.select(
        "id", expr.bool_lenient(flag).alias("flag"), expr.short_date(F.when(F.col("id") % 3 != 0, F.date_format("date_of_birth", "MMM d, yyyy")).otherwise(" ")).alias("born"),
        expr.int_strict(F.when(F.col("id") % 5 != 0, half).otherwise("")).alias("height_cm"), expr.stance_of(F.when(F.col("stance") != "switch", F.concat(F.lit(" "), F.initcap("stance"))).otherwise("Open Stance")).alias("stance"),
        expr.text_or_null(F.when(F.col("id") % 3 != 0, F.concat(F.lit(" n "), F.col("id").cast("string"))).otherwise("  ")).alias("nickname"),
    )


_JSON_TOKENS = [*expr.JSON_METHODS, "unknown"]


@query(f"""SELECT id, [{', '.join(repr(expr.JSON_METHODS.get(x, 'no_contest')) for x in _JSON_TOKENS)}][CAST(id % {len(_JSON_TOKENS)} AS INTEGER) + 1] AS method,
CASE WHEN [{', '.join(repr(expr.JSON_METHODS.get(x, 'no_contest')) for x in _JSON_TOKENS)}][CAST(id % {len(_JSON_TOKENS)} AS INTEGER) + 1] = 'no_contest' THEN NULL WHEN id % 3 = 0 THEN 'red' WHEN id % 3 = 1 THEN 'blue' END AS winner FROM bouts""")
def json_method_and_winner(t):
    method = expr.method_of(F.element_at(F.array(*[F.lit(x) for x in _JSON_TOKENS]), (F.col("id") % len(_JSON_TOKENS) + 1).cast("int")), expr.JSON_METHODS)
    slug = F.when(F.col("id") % 3 == 0, "a-a").when(F.col("id") % 3 == 1, "b-b").otherwise("c-c")
    return t.bouts.select("id", method.alias("method"), ingest.winner_corner(slug, F.lit("a-a"), F.lit("b-b"), method).alias("winner"))


@query(_LONG + MAIN + "SELECT CAST(count(DISTINCT fighter_id) AS BIGINT) AS debuts FROM lf")
def debuts(t):
    return features.debuts(long_frame(t))


# ---------------------------------------------------------------- payloads and models


@query()
def features_json(t):
    return matchup.payloads(matchup.matrix(enriched(t)), "tables")


_READ_BACK = ["win_rate_prior", "win_streak_prior", "takedown_defense_r3", "layoff_days"]


@query(_PIVOT + MAIN + f"SELECT a.bout_id, a.event_date, CASE {_T} WHEN 'R' THEN 'red' ELSE 'blue' END AS target_winner_corner, {', '.join(f'CAST(a.{c} AS DOUBLE) AS {c}_a, CAST(a.{c} - b.{c} AS DOUBLE) AS {c}_diff' for c in _READ_BACK)}, a.stance AS stance_a{_ON} WHERE {_T} IS NOT NULL")
def features_read_back(t):
    """The stored features of every decided bout, written as JSON and read again as columns, by the schema they were written with."""
    m = matchup.matrix(enriched(t))
    stored = cut(matchup.payloads(m, "tables"))
    rows, names = model.expand(stored, matchup.payload_schema(m, [*[c for b in _READ_BACK for c in (f"{b}_a", f"{b}_diff")], "stance_a"]))
    return model.with_dates(rows, t.bouts, t.events).select("bout_id", "event_date", "target_winner_corner", *names)


def _labelled(t: Tables) -> DataFrame:
    """(bout_id, event_date, label, probability, prediction): red's landed share as its probability."""
    p = matchup.pivot_corners(long_frame(t).select("bout_id", "corner", "result", "event_date", "sig_strikes_attempted"))
    share = expr.ratio(F.col("sig_strikes_attempted_a"), F.col("sig_strikes_attempted_a") + F.col("sig_strikes_attempted_b"))
    rows = p.withColumn("t", matchup.target()).filter("t is not null")
    rows = rows.select("bout_id", F.col("event_date_a").alias("event_date"), F.when(F.col("t") == "R", 1.0).otherwise(0.0).alias("label"), share.alias("probability"))
    return rows.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))


_LABELLED = _LONG + """, lab AS (SELECT a.bout_id, a.event_date, CASE a.result WHEN 'win' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CAST(a.sig_strikes_attempted AS DOUBLE) / CAST(a.sig_strikes_attempted + b.sig_strikes_attempted AS DOUBLE) AS probability
FROM lf a JOIN lf b ON a.bout_id = b.bout_id WHERE a.corner = 'red' AND b.corner = 'blue' AND a.result IN ('win', 'loss')),
cut AS (SELECT *, row_number() OVER (ORDER BY event_date, bout_id) AS k, count(*) OVER () - greatest(1, CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT)) AS n_train FROM lab)"""


@query(_LABELLED + MAIN + "SELECT bout_id, event_date, k > n_train AS test FROM cut")
def temporal_split(t):
    rows = cut(_labelled(t).select("bout_id", "event_date"))
    return rows.withColumn("test", model.temporal_cut(rows).is_later())


@query(_LABELLED + f", p AS (SELECT label, greatest({model.CLIP}, least(1 - {model.CLIP}, (SELECT avg(label) FROM cut WHERE k <= n_train))) AS p FROM cut WHERE k > n_train){MAIN}SELECT CAST(count(*) AS BIGINT) AS n, round(avg(label), 9) AS accuracy, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS log_loss, 0.5::DOUBLE AS roc_auc FROM p")
def baseline_metrics(t):
    earlier, later = model.temporal_split(cut(_labelled(t)))
    return model.baseline(earlier, later).select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "log_loss", "roc_auc")])


@query(_LABELLED + f", p AS (SELECT *, greatest({model.CLIP}, least(1 - {model.CLIP}, probability)) AS p FROM lab){MAIN}SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS log_loss FROM p")
def logloss_accuracy(t):
    return model.metrics(_labelled(t)).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("log_loss", 9).alias("log_loss"))


@query(_LABELLED + ", r AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rk FROM lab)" + MAIN + "SELECT round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 9) AS roc_auc FROM r")
def roc_auc_exact(t):
    return model.metrics(_labelled(t)).select(F.round("roc_auc", 9).alias("roc_auc"))


_DAY = "2030-06-15"


@query(_LONG + f""", o AS (SELECT lf.*, coalesce(x.sig_strikes_landed, NULL) AS o_sig, (lf.round - 1) * 300 + lf.ending_time_seconds AS secs, row_number() OVER (PARTITION BY lf.fighter_id ORDER BY lf.event_date DESC, lf.bout_id DESC) AS k FROM lf LEFT JOIN lf x ON x.bout_id = lf.bout_id AND x.fighter_id <> lf.fighter_id WHERE lf.fighter_id IN ({A}, {B})),
s AS (SELECT fighter_id, avg(CASE result WHEN 'win' THEN 1.0::DOUBLE WHEN 'loss' THEN 0.0::DOUBLE END) AS wr, CAST(count(*) AS INTEGER) AS n, CAST(sum(CASE WHEN k <= 3 THEN sig_strikes_landed END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN k <= 3 THEN secs END) AS DOUBLE) / 60.0::DOUBLE, 0) AS pm, CAST(date_diff('day', max(event_date), DATE '{_DAY}') AS INTEGER) AS layoff FROM o GROUP BY fighter_id){MAIN}SELECT v.red_is, a.wr AS win_rate_prior_a, b.wr AS win_rate_prior_b, a.n AS career_bouts_before_a, b.n AS career_bouts_before_b, a.pm AS sig_strikes_landed_pm_r3_a, b.pm AS sig_strikes_landed_pm_r3_b, a.layoff AS layoff_days_a, a.n - b.n AS career_bouts_before_diff
FROM (VALUES ('a', {A}, {B}), ('b', {B}, {A})) v(red_is, x, y) JOIN s a ON a.fighter_id = v.x JOIN s b ON b.fighter_id = v.y""")
def hypothetical_matchup_features(t):
    return model.hypothetical(t, A, B, _DAY).select("red_is", "win_rate_prior_a", "win_rate_prior_b", "career_bouts_before_a", "career_bouts_before_b", "sig_strikes_landed_pm_r3_a", "sig_strikes_landed_pm_r3_b", "layoff_days_a", "career_bouts_before_diff")


@query(_LABELLED + MAIN + "SELECT max(CASE WHEN k <= n_train THEN event_date END) AS boundary, CAST(count(CASE WHEN k <= n_train THEN 1 END) AS BIGINT) AS n_train, CAST(count(CASE WHEN k > n_train THEN 1 END) AS BIGINT) AS n_test FROM cut")
def split_boundary(t):
    rows = cut(_labelled(t).select("bout_id", "event_date"))
    where = model.temporal_cut(rows)
    return rows.agg(F.max(F.when(~where.is_later(), F.col("event_date"))).alias("boundary"), F.count_if(~where.is_later()).alias("n_train"), F.count_if(where.is_later()).alias("n_test"))


#: What a session has trained, by the files that hold the bouts.
_models: dict[tuple, model.TrainingResult] = {}


def _trained(t: Tables) -> model.TrainingResult:
    """The model of these tables, which is trained once for all queries that ask for it."""
    spark = t.bouts.sparkSession
    key = (spark.sparkContext.applicationId, *sorted(t.bouts.inputFiles()))
    if key not in _models or not all(exists(spark, f) for f in _models[key].scored.inputFiles()):
        _models[key] = model.run_training(*model.live_dataset(matchup.matrix(enriched(t))), written=True)
    return _models[key]


@query()
def gbt_train_predict(t):
    return _trained(t).scored


@query()
def training_report(t):
    """The metrics of the model and of always saying red, and the model's beside the recorded ones."""
    result = _trained(t)
    compared = model.compare_training(result)
    rows = [("model", *dataclasses.astuple(result.model)), ("always red", *dataclasses.astuple(result.baseline))]
    rows += [(k, None, *dataclasses.astuple(d)) for k, d in (("beside always red", compared.vs_baseline), ("beside the recorded model", compared.vs_recorded))]
    return t.bouts.sparkSession.createDataFrame(rows, "what string, n long, accuracy double, log_loss double, roc_auc double")


@query()
def neutral_matchup_prob(t):
    return model.predict(t, _trained(t).winner, A, B, _DAY)


def _all() -> None:
    """Register the queries of the other modules, which use this one."""
    from ringside import index_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
