"""Point-in-time features against hand-computed values, and their leakage."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from ringside import queries
from ringside.functions.expr import age_years
from ringside.operators.checks import assert_unique
from ringside.plans import features, matchup, model
from ringside.plans.features import add_features, with_opponent
from ringside.schema import LONG_FRAME, STATS
from ringside.sources import adapter
from ringside.sources.scratch import cut

D = dt.date

FRAME = "fighter_id int, fighter_name string, event_id int, event_name string, event_date date, bout_id int, corner string, result string, method string, round int, ending_time_seconds int, " + ", ".join(f"{s} int" for s in STATS) + ", source string"


def row(fighter, bout, day, result, method, rnd, secs, corner="red", **stats):
    base = {"fighter_id": fighter, "fighter_name": f"f{fighter}", "event_id": bout, "event_name": "e", "event_date": day, "bout_id": bout, "corner": corner, "result": result, "method": method, "round": rnd, "ending_time_seconds": secs, "source": "test"} | dict.fromkeys(STATS) | stats
    return tuple(base[c] for c in LONG_FRAME)


def career():
    """Fighter 1: W L W W W against opponents 11 to 15."""
    own = [("win", "ko_tko", 1, 120, 30, 1, 60), ("loss", "decision", 3, 300, 20, 0, 30), ("win", "submission", 2, 60, 15, 3, 120), ("win", "decision", 3, 300, 50, 1, 10), ("win", "ko_tko", 1, 60, 10, 0, 0)]
    opponents = [(10, 0, 2), (40, 2, 4), (5, 0, 1), (25, 1, 3), (1, 0, 0)]
    rows = []
    for i, ((result, method, rnd, secs, sig, td, ctrl), (osig, otd, otried)) in enumerate(zip(own, opponents, strict=True)):
        bout, day = 101 + i, D(2020, 1 + 2 * i, 1)
        other = {"win": "loss", "loss": "win"}[result]
        rows.append(row(1, bout, day, result, method, rnd, secs, sig_strikes_landed=sig, takedowns_landed=td, takedowns_attempted=td + 1, control_time_seconds=ctrl, head_landed=20, body_landed=5, leg_landed=5, distance_landed=18, clinch_landed=6, ground_landed=6))
        rows.append(row(11 + i, bout, day, other, method, rnd, secs, "blue", sig_strikes_landed=osig, takedowns_landed=otd, takedowns_attempted=otried, control_time_seconds=0))
    return rows


@pytest.fixture(scope="module")
def bio(spark):
    rows = [(i, D(1992, 2, 29), 180, None if i == 12 else 185, "orthodox") for i in [1, *range(11, 16)]]
    return spark.createDataFrame(rows, "id int, date_of_birth date, height_cm int, reach_cm int, stance string")


@pytest.fixture(scope="module")
def rounds(spark):
    return spark.createDataFrame([(101, 1, 1, 15), (101, 1, 2, 5), (102, 1, 1, None)], "bout_id int, fighter_id int, round_number int, sig_strikes_landed int")


def of_fighter(spark, rows, bio, rounds):
    out = add_features(spark.createDataFrame(rows, FRAME), bio, rounds)
    return out, [r for r in out.filter("fighter_id = 1").orderBy("event_date", "bout_id").collect()]


def values(rows, name):
    return [None if r[name] is None else float(r[name]) for r in rows]


def approx(got, want):
    assert [g is None for g in got] == [w is None for w in want], got
    assert all(g is None or abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True)), got


def test_recent_form(spark, bio, rounds):
    _, rows = of_fighter(spark, career(), bio, rounds)
    approx(values(rows, "win_rate_prior"), [None, 1, 1 / 2, 2 / 3, 3 / 4])
    approx(values(rows, "finish_rate_prior"), [None, 1, 1 / 2, 2 / 3, 1 / 2])
    approx(values(rows, "win_streak_prior"), [None, 1, -1, 1, 2])
    approx(values(rows, "sig_strikes_landed_pm_r3"), [None, 15, 50 / 17, 65 / 23, 85 / 36])
    approx(values(rows, "sig_strikes_absorbed_pm_r3"), [None, 5, 50 / 17, 55 / 23, 70 / 36])
    approx(values(rows, "takedowns_landed_avg_r3"), [None, 1, 1 / 2, 4 / 3, 4 / 3])
    approx(values(rows, "takedown_defense_r3"), [None, 1, 1 - 2 / 6, 1 - 2 / 7, 1 - 3 / 8])
    approx(values(rows, "control_time_avg_r3"), [None, 60, 45, 70, 160 / 3])
    approx(values(rows, "share_head_r3")[1:2] + values(rows, "share_body_r3")[1:2] + values(rows, "share_leg_r3")[1:2], [20 / 30, 5 / 30, 5 / 30])
    approx(values(rows, "share_distance_r3")[1:2] + values(rows, "share_clinch_r3")[1:2] + values(rows, "share_ground_r3")[1:2], [18 / 30, 6 / 30, 6 / 30])
    approx(values(rows, "round1_sig_strike_share_r3"), [None, 0.75, 0.75, 0.75, None])
    approx(values(rows, "career_bouts_before"), [0, 1, 2, 3, 4])
    approx(values(rows, "layoff_days"), [None, 60, 61, 61, 62])


def test_nothing_of_the_bout_or_later_leaks(spark, bio, rounds):
    _, before = of_fighter(spark, career(), bio, rounds)
    changed = career()
    at = LONG_FRAME.index("sig_strikes_landed")
    changed = [tuple(999 if i == at and r[LONG_FRAME.index("bout_id")] >= 103 else v for i, v in enumerate(r)) for r in changed]
    _, after = of_fighter(spark, changed, bio, rounds)
    for a, b in zip(before[:3], after[:3], strict=True):
        assert all(a[f] == b[f] for f in features.FEATURES)
    assert before[3]["sig_strikes_landed_pm_r3"] != after[3]["sig_strikes_landed_pm_r3"]


def test_draws_and_unknown_values(spark, bio, rounds):
    rows = [row(1, 1, D(2020, 1, 1), "draw", "decision", 3, 300, sig_strikes_landed=10, head_landed=None, body_landed=1, leg_landed=1), row(1, 2, D(2020, 2, 1), "win", "dq", None, None, sig_strikes_landed=7), row(1, 3, D(2020, 3, 1), "no_contest", "no_contest", 1, 60), row(1, 4, D(2020, 3, 1), "win", "decision", 1, 60)]
    _, got = of_fighter(spark, rows, bio, rounds)
    approx(values(got, "win_streak_prior"), [None, None, 1, 1])
    approx(values(got, "win_rate_prior"), [None, None, 1, 1])
    approx(values(got, "finish_rate_prior"), [None, 0, 0, 0])
    approx(values(got, "sig_strikes_landed_pm_r3"), [None, 10 / 15, 17 / 15, 17 / 16])  # unknown minutes, but known strikes
    approx(values(got, "share_head_r3"), [None, None, None, None])
    assert all(r["sig_strikes_absorbed_pm_r3"] is None for r in got)  # no opponent


def test_opponent_is_the_lowest_other(spark):
    df = spark.createDataFrame([(1, 5, 50), (1, 3, 30), (1, 9, 90), (2, 4, 40)], "bout_id int, fighter_id int, x int")
    got = {(r["bout_id"], r["fighter_id"]): r["opp_x"] for r in with_opponent(df, ["x"]).collect()}
    assert got == {(1, 3): 50, (1, 5): 30, (1, 9): 30, (2, 4): None}


def test_age(spark):
    df = spark.createDataFrame([(D(2022, 6, 1), D(1992, 6, 1)), (D(2022, 5, 31), D(1992, 6, 1)), (D(2022, 12, 1), D(1992, 6, 1)), (D(2021, 2, 28), D(1992, 2, 29)), (D(2021, 2, 28), None)], "d date, b date")
    assert [r[0] for r in df.select(age_years(F.col("d"), F.col("b"))).collect()] == [30, 29, 30, 28, None]


def test_duplicate_bio_raises(spark, bio, rounds):
    with pytest.raises(Exception, match="not unique"):
        add_features(spark.createDataFrame(career(), FRAME), bio.union(bio), rounds).collect()
    assert assert_unique(bio, ["id"], "bio").count() == 6


def test_matrix(spark, bio, rounds):
    enriched, _ = of_fighter(spark, career() + [row(1, 200, D(2022, 1, 1), "draw", "decision", 3, 300), row(12, 200, D(2022, 1, 1), "draw", "decision", 3, 300, "blue"), row(13, 201, D(2022, 1, 1), "win", "decision", 3, 300)], bio, rounds)
    m = matchup.matrix(enriched)
    rows = {r["bout_id"]: r for r in m.frame.collect()}
    assert sorted(rows) == [101, 102, 103, 104, 105] and len(m.features) == 62 and "stance_a" in m.features and "stance_diff" not in m.features
    assert [rows[b]["winner_corner"] for b in sorted(rows)] == ["R", "B", "R", "R", "R"]
    assert rows[102]["career_bouts_before_diff"] == 1 and rows[102]["win_rate_prior_diff"] is None
    assert not any(c.startswith(("sig_strikes_landed_a", "result", "event")) for c in m.features)
    base = matchup.baseline(enriched).first()
    assert (base["excluded_no_result"], base["decided"], base["red_corner_win_rate"]) == (1, 5, 0.8)


def test_two_reds_raise(spark, bio, rounds):
    rows = career() + [row(15, 101, D(2020, 1, 1), "win", "decision", 3, 300)]
    with pytest.raises(Exception, match="two corners"):
        matchup.pivot_corners(spark.createDataFrame(rows, FRAME)).collect()


def test_materialize(spark, bio, rounds, tmp_path):
    enriched, _ = of_fighter(spark, career(), bio, rounds)
    m, path = matchup.matrix(enriched), str(tmp_path / "features")
    assert matchup.materialize(m, path) == 5
    early = matchup.Matrix(m.frame.filter("bout_id <= 102").withColumn("height_cm_a", F.lit(1)), m.features)
    assert matchup.materialize(early, path) == 2
    stored = {r["bout_id"]: r for r in matchup.stored_features(spark, path).collect()}
    assert sorted(stored) == [101, 102, 103, 104, 105]
    payload = json.loads(stored[101]["features"])
    assert payload["height_cm_a"] == 1 and payload["win_rate_prior_a"] is None and set(payload) == set(m.features)
    assert stored[102]["target_winner_corner"] == "blue"
    assert matchup.materialize(matchup.Matrix(m.frame.limit(0), m.features), path) == 0
    # Read back, with the events' dates.
    bouts = spark.createDataFrame([(i, i * 10) for i in range(101, 106)], "id int, event_id int")
    events = spark.createDataFrame([(i * 10, dt.date(2020, 1, i - 100)) for i in range(101, 105)], "id int, date date")
    raw = model.read_bout_features(matchup.stored_features(spark, path), bouts, events)
    assert raw.count() == 4  # the last bout's event isn't known
    rows, names = model.expand(raw)
    assert set(names) == set(m.features) and dict(rows.dtypes)["height_cm_a"] == "double" and dict(rows.dtypes)["stance_a"] == "string"
    back = {r["bout_id"]: r for r in rows.collect()}
    for r in m.frame.filter("bout_id in (103, 104)").collect():
        assert all(back[r["bout_id"]][f] == r[f] for f in m.features)
    data, kept = model.stored_dataset(raw)
    assert "stance_a" not in kept and "height_cm_b" in kept and {r["bout_id"]: r["label"] for r in data.collect()}[102] == 0.0
    assert features.debuts(enriched).first()["debuts"] == enriched.select("fighter_id").distinct().count()


def test_features_are_read_by_the_schema_they_were_written_with(spark):
    """Reading by schema gives what one pass over the texts finds, and texts are read before rows meet their dates: they don't move."""
    t = adapter.read(spark, "/root/testdata/sf0.001")
    m = matchup.matrix(queries.enriched(t))
    stored = cut(matchup.payloads(m, "tables"))
    found, names = model.expand(model.read_bout_features(stored, t.bouts, t.events))
    schema = matchup.payload_schema(m)
    assert {f.name: f.dataType for f in schema} == {n: found.schema[n].dataType for n in names}
    read, _ = model.expand(stored, schema)
    assert model.with_dates(read, t.bouts, t.events).select(found.columns).exceptAll(found).isEmpty() and read.count() == found.count() == stored.count()
    plan = queries.features_read_back(t)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, p in enumerate(plan) if "from_json" in p) > min(i for i, p in enumerate(plan) if "Join" in p)


def test_prepared_rows_move_by_bout_alone(spark):
    """Where nothing is broadcast, corners meet opponents and shares in one place, and later bouts are prepared once for all that reads them."""
    t = adapter.read(spark, "/root/testdata/sf0.001")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame, shares = queries.long_frame(t).select(*features.LOOKED_AT), features.corner_shares(t)
        rows = features.prepared(frame, shares)
        by = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", rows._jdf.queryExecution().executedPlan().toString())
        assert by and not [k for k in by if "," in k]  # none by bout and fighter
        want = features.with_opponent(frame, features.OPPONENT).join(shares, ["bout_id", "fighter_id"], "left").select("bout_id", "fighter_id", "round1_share", "opp_sig_strikes_landed")
        got = rows.select(*want.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
        read = queries.Q["features_after_append"](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not [f for f in read if "/rounds/" in f or "/bout_fighters/" in f]  # neither is gone through again
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_shares_of_no_fighter_or_bout_stay_away(spark):
    """Rows without a share, or without a known fighter, get none; those of others in the bout aren't taken."""
    stats = ", ".join(f"{c} int" for c in features.OPPONENT)
    frame = spark.createDataFrame([(1, 7, 1, 1, 1, 1, 1), (1, 8, 1, 1, 1, 1, 1), (2, 7, 1, 1, 1, 1, 1), (3, None, 1, 1, 1, 1, 1)], f"bout_id int, fighter_id int, {stats}, round int, ending_time_seconds int")
    shares = spark.createDataFrame([(1, 8, 0.5), (1, 9, 0.1), (3, 7, 0.2), (4, 7, 0.3)], "bout_id long, fighter_id long, round1_share double")
    got = {(r["bout_id"], r["fighter_id"]): r["round1_share"] for r in features.prepared(frame, shares).collect()}
    assert got == {(1, 7): None, (1, 8): 0.5, (2, 7): None, (3, None): None}
