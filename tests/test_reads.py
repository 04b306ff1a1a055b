"""Reads over a small set of tables: lists, history, cards, details, statistics, prediction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringside.plans import model, reads
from ringside.schema import BOUT_FIGHTERS, BOUTS, EVENTS, FIGHTERS, ROUNDS, STATS, Tables

D = dt.date


def fighter(i, name, born=None):
    return (i, name, name.lower(), None, born, 180, 180, "orthodox", None, 0, 0, 0, "test")


def corner(i, bout, who, side, **stats):
    return (i, bout, who, side, *[stats.get(s) for s in STATS], "test")


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    fighters = make([fighter(1, "Ana Silva"), fighter(2, "Bea Costa", D(1990, 1, 1)), fighter(3, "Cara Dias"), fighter(4, "Dora 100%")], FIGHTERS)
    events = make([(1, "One", D(2020, 1, 1), None, "t"), (2, "Two", D(2021, 1, 1), "Rio", "t"), (3, "Three", D(2021, 1, 1), None, "t")], EVENTS)
    bout = lambda i, e, w, m, r=1: (i, e, w, m, r, 60, "fly", None, 3, None, "t")
    bouts = make([bout(11, 1, 1, "ko_tko"), bout(12, 2, None, "decision", 3), bout(13, 3, 2, "submission", 2)], BOUTS)
    rows = [
        corner(1, 11, 2, "blue", sig_strikes_landed=10, head_landed=1), corner(2, 11, 1, "red", sig_strikes_landed=30, head_landed=6, body_landed=2, leg_landed=2, distance_landed=7, clinch_landed=1, ground_landed=2),
        corner(3, 12, 1, "blue", sig_strikes_landed=20, head_landed=9, body_landed=None, leg_landed=1), corner(4, 12, 3, "red"), corner(5, 13, 2, "red", sig_strikes_landed=5), corner(6, 13, 1, "blue"),
    ]
    rounds = make([(1, 2, 2, *[None] * len(STATS), "t"), (2, 2, 1, *[4] * len(STATS), "t")], ROUNDS)
    return Tables(fighters, events, bouts, make(rows, BOUT_FIGHTERS), rounds)


def test_lists(t):
    page = reads.list_fighters(t, "a", limit=2, offset=1)
    assert [r["id"] for r in page.items.collect()] == [2, 3] and page.total == 4
    assert reads.list_fighters(t, "SILVA").total == 1 and reads.list_fighters(t, "").total == 4 and reads.list_fighters(t, "a_a").total == 2
    past = reads.list_fighters(t, offset=50)
    assert past.items.count() == 0 and past.total == 4
    assert [r["id"] for r in reads.list_events(t).items.collect()] == [3, 2, 1]
    assert reads.by_id(t.fighters, 99).count() == 0
    assert [r["id"] for r in reads.without_bouts(t).collect()] == [4]


def test_history(t):
    rows = reads.history(t, 1).collect()
    assert [(r["bout_id"], r["opponent_id"], r["won"], r["corner"]) for r in rows] == [(11, 2, True, "red"), (12, 3, False, "blue"), (13, 2, False, "blue")]
    assert reads.history(t, 4).count() == 0 and reads.history(t).count() == 6


def test_head_to_head(t):
    rows = reads.head_to_head(t, 1, 2).collect()
    assert [(r["bout_id"], r["corner_a"], r["sig_strikes_landed_a"], r["sig_strikes_landed_b"]) for r in rows] == [(11, "red", 30, 10), (13, "blue", None, 5)]
    assert reads.head_to_head(t, 2, 3).count() == 0
    with pytest.raises(ValueError):
        reads.head_to_head(t, 1, 1)


def test_card_and_detail(t):
    card = reads.event_card(t, 1).collect()
    assert [c["corner"] for c in card[0]["corners"]] == ["red", "blue"] and card[0]["corners"][0]["fighter_name"] == "Ana Silva"
    detail = reads.bout_detail(t, 11).first()
    assert [[r["round"] for r in c["rounds"]] for c in detail["corners"]] == [[1, 2], []] and detail["event_name"] == "One"
    assert reads.bout_detail(t, 99).count() == 0


def test_stats(t):
    rows = {r["fighter_id"]: r for r in reads.fighter_stats(t).collect()}
    ana = rows[1]
    assert (ana["total_bouts"], ana["avg_sig_strikes_landed"], ana["wins_by_method"]) == (3, 25.0, {"ko_tko": 1})
    assert (ana["head_share"], ana["body_share"], ana["leg_share"]) == (0.75, 0.1, 0.15)
    assert (ana["distance_share"], ana["clinch_share"], ana["ground_share"]) == (0.7, 0.1, 0.2)
    assert (rows[4]["total_bouts"], rows[4]["avg_sig_strikes_landed"], rows[4]["wins_by_method"], rows[4]["head_share"]) == (0, None, {}, None)
    assert reads.fighter_stats(t, 99).count() == 0
    one = reads.derived_stats(reads.recut(reads.history(t, 1), "2020-01-01", "2021-01-01", last_n=2)).first()
    assert (one["total_bouts"], one["wins"], one["avg_sig_strikes_landed"]) == (2, 0, 20.0)
    with pytest.raises(ValueError):
        reads.recut(reads.history(t), last_n=9)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.9), (1.0, 0.4), (0.0, 0.1), (1.0, 0.4), (0.0, 0.4)], "label double, probability double").withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))
    m = model.metrics(df).first()
    pairs = [(p > n) + 0.5 * (p == n) for p in (0.9, 0.4, 0.4) for n in (0.9, 0.1, 0.4)]
    assert abs(m["roc_auc"] - sum(pairs) / 9) < 1e-12 and m["accuracy"] == 0.5 and m["n"] == 6
    same = spark.createDataFrame([(1.0, 0.75, 1.0), (0.0, 0.75, 1.0)], "label double, probability double, prediction double")
    import math

    m = model.metrics(same).first()
    assert abs(m["log_loss"] + (math.log(0.75) + math.log(0.25)) / 2) < 1e-12 and m["roc_auc"] == 0.5


def test_temporal_split(spark):
    rows = spark.createDataFrame([(i, D(2020, 1, 1 + i // 3)) for i in range(10)], "bout_id int, event_date date")
    early, late = model.temporal_split(rows, 0.25)
    assert sorted(r["bout_id"] for r in late.collect()) == [8, 9] and early.count() == 8  # 2.5 is rounded to 2
    for bad in (0, 1, -0.5):
        with pytest.raises(ValueError):
            model.temporal_split(rows, bad)
    with pytest.raises(ValueError):
        model.temporal_split(rows.limit(1), 0.2)


def test_prediction(spark, t, tmp_path):
    rows = model.hypothetical(t, 1, 2, "2022-01-01").orderBy("red_is").collect()
    assert [(r["red_is"], r["career_bouts_before_a"], r["career_bouts_before_b"], r["layoff_days_a"]) for r in rows] == [("a", 3, 2, 365), ("b", 2, 3, 365)]
    assert rows[0]["win_rate_prior_a"] == 0.5 and rows[0]["win_rate_prior_b"] == 0.5
    with pytest.raises(ValueError):
        model.require_history(t, 1, 4)
    data = spark.createDataFrame([(i, D(2020, 1, 1 + i), float(i % 2), float(i % 2), None if i % 3 else 1.0) for i in range(20)], "bout_id int, event_date date, label double, x double, y double")
    winner = model.train(data, ["x", "y"], iterations=2, depth=2)
    winner.save(str(tmp_path / "m"))
    scored = model.Winner.load(str(tmp_path / "m")).score(data.drop("y")).collect()
    assert all((r["probability"] > 0.5) == (r["label"] == 1) for r in scored)
    with pytest.raises(FileNotFoundError):
        model.Winner.load(str(tmp_path / "none"))
    pair = spark.createDataFrame([("a", 0.7), ("b", 0.6)], "red_is string, probability double")
    out = model.neutral(pair, 5, 3).first()
    assert abs(out["probability_a"] - 0.55) < 1e-12 and out["winner_id"] == 5
    tie = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "red_is string, probability double")
    assert model.neutral(tie, 5, 3).first()["winner_id"] == 3


def test_training_report(spark, tmp_path):
    """What a run reports, beside always saying red and beside recorded metrics."""
    data = spark.createDataFrame([(i, D(2020, 1, 1 + i // 2), float(i % 3 > 0), float(i % 3 > 0)) for i in range(40)], "bout_id int, event_date date, label double, x double")
    result = model.run_training(data, ["x"], iterations=2, depth=2)
    assert (result.n_samples, result.n_train, result.n_test, result.boundary) == (40, 32, 8, D(2020, 1, 16))
    assert result.model.accuracy == 1.0 and result.model.n == 8 and result.baseline.accuracy < 1 and result.baseline.roc_auc == 0.5
    compared = model.compare_training(result)
    assert compared.vs_baseline.improves_accuracy and compared.vs_baseline.log_loss < 0
    assert abs(compared.vs_recorded.accuracy - (1 - model.RECORDED.accuracy)) < 1e-12
    assert not model.metrics_delta(result.model, result.model).improves_accuracy
    with pytest.raises(ValueError):
        model.run_training(data.limit(0), ["x"])


def test_prediction_checks_in_order(spark, t, tmp_path):
    path = str(tmp_path / "none")
    for a, b, error in ((1, 1, ValueError), (1, 99, model.UnknownFighter), (1, 2, FileNotFoundError), (1, 4, FileNotFoundError)):
        with pytest.raises(error):
            model.predict_matchup(t, path, a, b, "2022-01-01")
    data = spark.createDataFrame([(i, D(2020, 1, 1 + i), float(i % 2), float(i % 2)) for i in range(20)], "bout_id int, event_date date, label double, career_bouts_before_diff double")
    model.train(data, ["career_bouts_before_diff"], iterations=1, depth=1).save(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no bouts"):
        model.predict_matchup(t, str(tmp_path / "m"), 1, 4, "2022-01-01")
    one, two = (model.predict_matchup(t, str(tmp_path / "m"), a, b, "2022-01-01").first() for a, b in ((1, 2), (2, 1)))
    assert abs(one["probability_a"] + two["probability_a"] - 1) < 1e-9 and one["winner_id"] == two["winner_id"]


def test_results_and_unknown_fighters(t):
    kinds = {r["bout_id"]: (r["kind"], r["winner_name"]) for r in reads.bout_results(t).collect()}
    for b in t.bouts.collect():
        kind, name = kinds[b["id"]]
        assert kind == ("no_contest" if b["method"] == "no_contest" else "winner" if b["winner_id"] else "draw")
        assert (name is not None) == (kind == "winner")
    assert reads.known_history(t, 99) is None and reads.known_history(t, 4).count() == 0


def test_cut_within_a_date(spark, monkeypatch):
    """The boundary is found by ranges of ids, however they lie."""
    monkeypatch.setattr(model, "RANGES", 4)
    monkeypatch.setattr(model, "FEW", 2)
    ids = [1, 2, 3, 1000, 1001, 5_000_000_000, 7, 8, 900, 901, 902, 903]
    rows = spark.createDataFrame([(i, D(2020, 1, 1)) for i in ids], "bout_id long, event_date date")
    for share in (0.1, 0.3, 0.5, 0.9):
        early, late = model.temporal_split(rows, share)
        n = len(ids) - max(1, round(len(ids) * share))
        assert sorted(r["bout_id"] for r in early.collect()) == sorted(ids)[:n] and late.count() == len(ids) - n
