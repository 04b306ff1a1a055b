"""Features from per-fighter states against a full recompute."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ringside.plans import features, matchup, state
from ringside.plans.features import add_features
from tests.test_features import FRAME, row


def history(seed, bouts=70, fighters=9):
    """Rows of bouts with few fighters: several in a day, draws, unknown numbers, and bouts of one corner."""
    r = random.Random(seed)
    rows = []
    for b in range(1, bouts + 1):
        a, z = r.sample(range(1, fighters + 1), 2)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=b // 3 * 7)
        result, method = r.choice([("win", "ko_tko"), ("win", "decision"), ("loss", "submission"), ("draw", "decision"), ("no_contest", "no_contest")])
        other = {"win": "loss", "loss": "win"}.get(result, result)
        numbers = lambda: {c: r.choice([None, *range(30)]) for c in ("sig_strikes_landed", "takedowns_landed", "takedowns_attempted", "control_time_seconds", *[f"{k}_landed" for k in features.TARGETS + features.POSITIONS])}
        length = r.choice([(None, None), (1, 60), (3, 300), (2, 100)])
        rows.append(row(a, b, day, result, method, *length, "red", **numbers()))
        if r.random() < 0.9:
            rows.append(row(z, b, day, other, method, *length, "blue", **numbers()))
    return rows


@pytest.fixture(scope="module")
def bio(spark):
    return spark.createDataFrame([(i, dt.date(1990, 1, i), 170 + i, None, "orthodox") for i in range(1, 10)], "id int, date_of_birth date, height_cm int, reach_cm int, stance string")


@pytest.fixture(scope="module")
def shares(spark):
    return spark.createDataFrame([(b, f, (b * f % 10) / 10) for b in range(1, 71) for f in range(1, 10) if (b + f) % 4], "bout_id int, fighter_id int, round1_share double")


def keyed(df):
    return {(r["fighter_id"], r["bout_id"]): [None if r[c] is None else r[c] if isinstance(r[c], str) else round(float(r[c]), 9) for c in features.FEATURES] for r in df.collect()}


def test_states_equal_a_full_recompute(spark, bio, shares):
    """Events in three parts, some fighters new in each."""
    frame = spark.createDataFrame(history(1), FRAME)
    want = keyed(add_features(frame, bio, shares=shares))
    got, states = {}, spark.createDataFrame([], state.STATE)
    for low, high in ((0, 20), (20, 23), (23, 71)):
        part = frame.filter((F.col("bout_id") > low) & (F.col("bout_id") <= high))
        step = state.advance(states, part, bio, shares)
        assert step.late.count() == 0 and dict(step.features.dtypes)["sig_strikes_landed"] == "int"
        got |= keyed(step.features)
        after = spark.createDataFrame(step.states.collect(), state.STATE)
        states = after.union(states.join(after, "fighter_id", "left_anti"))
        whole = state.states_of(frame.filter(F.col("bout_id") <= high), shares)
        assert sorted(map(str, states.collect())) == sorted(map(str, whole.collect()))
    assert got == want


def test_an_event_reads_no_old_corners(spark, bio, shares, tmp_path):
    frame = spark.createDataFrame(history(2), FRAME)
    paths = {n: str(tmp_path / n) for n in ("old", "new", "shares")}
    frame.filter("bout_id <= 60").write.parquet(paths["old"])
    frame.filter("bout_id > 60").write.parquet(paths["new"])
    shares.filter("bout_id > 60").write.parquet(paths["shares"])
    store = state.state_store(spark, str(tmp_path / "states"), buckets=16)
    store.upsert(state.states_of(spark.read.parquet(paths["old"]), shares))
    new = spark.read.parquet(paths["new"])
    step = state.advance(store.read_keys(new.select("fighter_id")), new, bio, spark.read.parquet(paths["shares"]))
    assert keyed(step.features) == {k: v for k, v in keyed(add_features(frame, bio, shares=shares)).items() if k[1] > 60}
    assert not any("/old/" in f for f in step.features.inputFiles()) and any("/states/" in f for f in step.features.inputFiles())
    one = spark.createDataFrame([(3,)], "fighter_id int")
    assert len({f.rsplit("/", 2)[1] for f in store.read_keys(one).inputFiles()}) == 1  # of 16 buckets


def stored(df):
    return {r["bout_id"]: json.loads(r["features"]) for r in df.collect()}


def rounded(found):
    return {b: {k: round(v, 9) if isinstance(v, float) else v for k, v in f.items()} for b, f in found.items()}


def test_take_up_with_a_late_bout(spark, bio, shares, tmp_path):
    """A bout before later ones of its fighters: their later matchups are made again; all equal a full recompute."""
    rows = history(3)
    frame = spark.createDataFrame(rows, FRAME)
    states, sink = state.state_store(spark, str(tmp_path / "s"), 4), matchup.feature_store(spark, str(tmp_path / "f"), 4)
    full = lambda df: rounded(stored(matchup.payloads(matchup.matrix(add_features(df, bio, shares=shares)), "x")))
    taken = frame.filter("bout_id <= 30 and bout_id <> 12")
    state.take_up(states, sink, taken, bio, shares)
    assert rounded(stored(sink.read())) == full(taken)
    late = frame.filter("bout_id = 12 or bout_id in (31, 32, 33)")
    with pytest.raises(ValueError):
        state.take_up(states, sink, late, bio, shares)
    now = frame.filter("bout_id <= 33")
    state.take_up(states, sink, late, bio, shares, history=(now, shares))
    assert rounded(stored(sink.read())) == full(now)
    assert sorted(map(str, states.read().collect())) == sorted(map(str, state.states_of(now, shares).collect()))
    # The same event once more changes nothing.
    state.take_up(states, sink, frame.filter("bout_id in (31, 32, 33)"), bio, shares, history=(now, shares))
    assert rounded(stored(sink.read())) == full(now)
    assert sorted(map(str, states.read().collect())) == sorted(map(str, state.states_of(now, shares).collect()))
    state.take_up(states, sink, frame.filter("bout_id > 33"), bio, shares)
    assert rounded(stored(sink.read())) == full(frame)
