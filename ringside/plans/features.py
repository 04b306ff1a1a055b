"""Point-in-time features: what was known of a fighter before each bout.

All windows run over a fighter's bouts by date and bout id and end one row before the current one, so nothing of the bout itself
or of later ones gets in.  They share one partitioning and order, and with it one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.expr import age_years, fight_seconds, is_finish, ratio
from ringside.operators.checks import assert_unique
from ringside.schema import Tables

RECENT = ["win_rate_prior", "finish_rate_prior", "win_streak_prior", "sig_strikes_landed_pm_r3", "sig_strikes_absorbed_pm_r3", "takedowns_landed_avg_r3", "takedown_defense_r3", "control_time_avg_r3"]
TARGETS, POSITIONS = ["head", "body", "leg"], ["distance", "clinch", "ground"]
SHARES = [f"share_{k}_r3" for k in TARGETS + POSITIONS]
ROUND1 = "round1_sig_strike_share_r3"
TRAJECTORY = ["age_years", "layoff_days", "career_bouts_before", "height_cm", "reach_cm"]
NUMERIC = [*RECENT, *SHARES, ROUND1, *TRAJECTORY]
FEATURES = [*NUMERIC, "stance"]

#: A fighter's time series.  Rows of one bout id and date stand in the order of ``synthetic``, where there is one.
ORDER = ["event_date", "bout_id"]


class Frames:
    """The windows over a fighter's bouts."""

    def __init__(self, order: list[Column] | None = None):
        self.all = Window.partitionBy("fighter_id").orderBy(*(order or ORDER))
        self.prior = self.all.rowsBetween(Window.unboundedPreceding, -1)
        self.last3 = self.all.rowsBetween(-3, -1)
        self.to_current = self.all.rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: What the opponent's numbers are taken from.
OPPONENT = ["sig_strikes_landed", "takedowns_landed", "takedowns_attempted"]


def with_opponent(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame`` with opp_* columns of the first other fighter of the bout by fighter id; null without one.

    One window by bout finds it: the first row, or for the first fighter the next one.  Bouts with more than two corners therefore give
    the lowest other id, as a self-join with fighter_id <> opponent would.  A fighter stands once in a bout.
    """
    by_bout = Window.partitionBy("bout_id").orderBy("fighter_id")
    pack = F.struct("fighter_id", *columns)
    rows = frame.withColumns({"__low": F.first(pack).over(by_bout), "__next": F.lead(pack).over(by_bout)})
    packed = rows.withColumn("__opp", F.when(F.col("fighter_id") != F.col("__low.fighter_id"), F.col("__low")).otherwise(F.col("__next")))
    return packed.selectExpr(*[f"`{c}`" for c in frame.columns], *[f"__opp.`{c}` AS `opp_{c}`" for c in columns])


def streak() -> Column:
    """The signed run of decided bouts before this one; draws and no contests neither count nor break it; null before any."""
    win, loss = F.coalesce("__last_win", F.lit(0)), F.coalesce("__last_loss", F.lit(0))
    return F.when(F.col("__decided_prior") == 0, None).when(win > loss, F.col("__decided_prior") - loss).otherwise(-(F.col("__decided_prior") - win))


def round1_shares(rounds: DataFrame) -> DataFrame:
    """(bout_id, fighter_id, round1_share): landed in round 1 over landed in all; null if nothing is known or landed."""
    landed = F.col("sig_strikes_landed")
    sums = rounds.groupBy("bout_id", "fighter_id").agg(F.sum(F.when(F.col("round_number") == 1, landed)).alias("first"), F.sum(landed).alias("total"))
    return sums.select("bout_id", "fighter_id", ratio(F.col("first"), F.col("total")).alias("round1_share"))


def corner_shares(t: Tables) -> DataFrame:
    """round1_shares() of the tables: rounds are added up by corner before they meet the corners."""
    landed = F.col("sig_strikes_landed")
    sums = t.rounds.groupBy("bout_fighter_id").agg(F.sum(F.when(F.col("round") == 1, landed)).alias("first"), F.sum(landed).alias("total"))
    corners = t.bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id", "fighter_id")
    return corners.join(sums, "bout_fighter_id").select("bout_id", "fighter_id", ratio(F.col("first"), F.col("total")).alias("round1_share"))


#: What prepared() and the windows take from a long frame.
LOOKED_AT = ["fighter_id", *ORDER, "result", "method", "round", "ending_time_seconds", *OPPONENT, "control_time_seconds", *[f"{k}_landed" for k in TARGETS + POSITIONS]]


def prepared(frame: DataFrame, shares: DataFrame) -> DataFrame:
    """The frame with all that the windows over a fighter's bouts look at: opp_*, round1_share and the bout's __seconds.

    Shares are joined by the bout, where the rows lie after the opponents were found, and compared by fighter there: a join by both ids
    would move all rows once more.
    """
    of_bout = shares.select(F.col("bout_id").alias("__bout"), F.col("fighter_id").alias("__who"), "round1_share")
    same = (F.col("bout_id") == F.col("__bout")) & (F.col("fighter_id") <= F.col("__who")) & (F.col("fighter_id") >= F.col("__who"))
    rows = with_opponent(frame, OPPONENT).join(of_bout, same, "left").drop("__bout", "__who")
    return rows.withColumn("__seconds", fight_seconds(F.col("round"), F.col("ending_time_seconds")))


def with_form(rows: DataFrame, f: Frames, g: Frames, carried: bool = False) -> DataFrame:
    """Prepared rows with the features that look back.

    carried: rows with __old are known bouts that only the last-three frames look at; all before and of them is in the columns __base_*
    (bouts, kept, decided, wins, finishes, last_win, last_loss; kept is how many of the old rows there are).
    """
    new = (lambda c: F.when(~F.col("__old"), c)) if carried else (lambda c: c)
    plus = (lambda n, c: F.col(f"__base_{n}") + c) if carried else (lambda n, c: c)
    latest = (lambda n, c: F.greatest(F.col(f"__base_{n}"), c)) if carried else (lambda n, c: c)
    win, loss = F.col("result") == "win", F.col("result") == "loss"
    decided = F.when(win | loss, 1)
    counted = plus("decided", F.count(new(decided)).over(f.to_current))
    rows = rows.withColumn("__n", counted)
    none = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({
        "__decided_prior": plus("decided", F.count(new(decided)).over(f.prior)),
        "__wins_prior": plus("wins", F.count(new(F.when(win, 1))).over(f.prior)),
        "__bouts_prior": plus("bouts", F.count(new(F.lit(1))).over(f.prior)),
        "__finishes_prior": plus("finishes", F.count(new(F.when(win & is_finish(F.col("method")), 1))).over(f.prior)),
        "__last_win": latest("last_win", none(F.max(new(F.when(win, F.col("__n")))).over(f.prior))),
        "__last_loss": latest("last_loss", none(F.max(new(F.when(loss, F.col("__n")))).over(f.prior))),
        "__minutes": F.sum("__seconds").over(f.last3) / 60.0,
        "__landed": F.sum("sig_strikes_landed").over(f.last3),
        "__absorbed": F.sum("opp_sig_strikes_landed").over(f.last3),
        "__opp_td": F.sum("opp_takedowns_landed").over(f.last3),
        "__opp_tried": F.sum("opp_takedowns_attempted").over(f.last3),
        "takedowns_landed_avg_r3": F.avg("takedowns_landed").over(f.last3),
        "control_time_avg_r3": F.avg("control_time_seconds").over(f.last3),
        **{f"__{k}": F.sum(f"{k}_landed").over(f.last3) for k in TARGETS + POSITIONS},
        ROUND1: F.avg("round1_share").over(g.last3),
        "__before": F.lag("event_date").over(g.all),
        "__nth": F.row_number().over(g.all) + ((F.col("__base_bouts") - F.col("__base_kept")) if carried else F.lit(0)),
    })
    targets, positions = (F.col("__head") + F.col("__body") + F.col("__leg")), (F.col("__distance") + F.col("__clinch") + F.col("__ground"))
    return rows.withColumns({
        "win_rate_prior": ratio(F.col("__wins_prior"), F.col("__decided_prior")),
        "finish_rate_prior": ratio(F.col("__finishes_prior"), F.col("__bouts_prior")),
        "win_streak_prior": streak().cast("int"),
        "sig_strikes_landed_pm_r3": ratio(F.col("__landed"), F.col("__minutes")),
        "sig_strikes_absorbed_pm_r3": ratio(F.col("__absorbed"), F.col("__minutes")),
        "takedown_defense_r3": 1.0 - ratio(F.col("__opp_td"), F.col("__opp_tried")),
        **{f"share_{k}_r3": ratio(F.col(f"__{k}"), targets) for k in TARGETS},
        **{f"share_{k}_r3": ratio(F.col(f"__{k}"), positions) for k in POSITIONS},
        "layoff_days": F.datediff("event_date", "__before"),
        "career_bouts_before": (F.col("__nth") - 1).cast("int"),
    })


def with_bio(rows: DataFrame, fighters: DataFrame) -> DataFrame:
    bio = assert_unique(fighters.select(F.col("id").alias("fighter_id"), "date_of_birth", "height_cm", "reach_cm", "stance"), ["fighter_id"], "fighters")
    return rows.join(bio, "fighter_id", "left").withColumn("age_years", age_years(F.col("event_date"), F.col("date_of_birth")))


def add_features(frame: DataFrame, fighters: DataFrame, rounds: DataFrame | None = None, order: list[Column] | None = None, trajectory_order: list[Column] | None = None, shares: DataFrame | None = None) -> DataFrame:
    """The frame's columns and FEATURES.

    frame: a long frame.  rounds: its rounds (longframe.round_rows), or shares: what round1_shares() makes of them.  ``order`` sorts a
    fighter's bouts for form and shares, ``trajectory_order`` for layoff, experience and round dynamics (as ``order``, if not given);
    without either both go by date and bout id.
    """
    rows = prepared(frame, round1_shares(rounds) if shares is None else shares)
    rows = with_form(with_bio(rows, fighters), Frames(order), Frames(trajectory_order or order))
    return rows.select(*frame.columns, *FEATURES)


def debuts(rows: DataFrame) -> DataFrame:
    """(debuts): how many fighters have a first bout, which has no form to look back on."""
    return rows.agg(F.countDistinct("fighter_id").alias("debuts"))
