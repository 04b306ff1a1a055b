"""Tasks and tables between steps don't grow faster than the tables."""

from pathlib import Path

from pyspark.sql import functions as F

from ringside import queries, source_queries
from ringside.plans import features, matchup, model, state
from ringside.plans.longframe import long_frame
from ringside.sources import adapter, keyed_store, scratch
from ringside.sources.keyed_store import KeyedStore

SMALL = "/root/testdata/sf0.001"


def test_shuffles_follow_the_rows(spark, monkeypatch):
    usual = {k: spark.conf.get(k, None) for k in (adapter.SIZE, adapter.NUMBER)}
    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    monkeypatch.setattr(adapter, "_numbers", {})
    try:
        for k in usual:
            spark.conf.unset(k)
        adapter.read(spark, SMALL)
        assert spark.conf.get(adapter.NUMBER) == "12"  # 6,000 lines
        assert spark.conf.get(adapter.SIZE) == "8m"
        adapter.small_tasks(spark, 100_000)  # other tables
        assert spark.conf.get(adapter.NUMBER) == "200"
        adapter.small_tasks(spark, 100)
        assert spark.conf.get(adapter.NUMBER) == spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set(adapter.NUMBER, "7")  # the user's own
        adapter.small_tasks(spark, 100_000)
        assert spark.conf.get(adapter.NUMBER) == "7"
    finally:
        for k, v in usual.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cut_is_smaller_than_its_rows(spark):
    rows = spark.range(20_000).selectExpr("id", "concat(repeat('the same text ', 20), id) AS text")
    cut = scratch.cut(rows)
    size = sum(Path(f.removeprefix("file:")).stat().st_size for f in cut.inputFiles())
    assert size < 20_000 * 100 and cut.exceptAll(rows).isEmpty() and cut.count() == 20_000


def test_rounds_meet_corners_by_bout(spark):
    """The statistics of rounds aren't shuffled: of the plan's exchanges none has them."""
    corners = adapter.read(spark, SMALL).bout_fighters
    made = adapter.derive(spark, SMALL, corners).rounds
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(bout_id" in plan and not [p for p in plan.splitlines() if "Exchange hashpartitioning" in p and "fighter_id" in p]


def test_an_upsert_writes_its_rows_once(spark, tmp_path):
    """Nothing but the rows' own files is written on the way into a keyed store."""
    files = lambda: sorted(str(p) for p in Path(scratch.shared_dir(spark)).rglob("*"))
    spark.range(1).count()
    store, before = KeyedStore(spark, str(tmp_path / "store"), "id long, text string", "id", 4), files()
    assert store.upsert(spark.range(100).selectExpr("id", "'t' AS text")) == 100 and store.upsert(store.read().limit(0)) == 0
    assert files() == before and store.read().count() == 100


def test_intake_reads_its_cards_from_a_table(spark, monkeypatch):
    """What the intake's steps take again and again is no chain of joins that is run each time."""
    seen = []
    monkeypatch.setattr(source_queries.ingest, "event_rows_to_add", lambda known, event, fighters, stats: seen.append(event))
    source_queries._intake(adapter.read(spark, SMALL))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and seen[0].count() > 0


def test_files_of_statistics_are_few_and_their_rows_move_once(spark, monkeypatch):
    """1,500 bouts' rounds stand in one file, and between their join and their files there is one shuffle."""
    seen, written = [], source_queries._written
    monkeypatch.setattr(source_queries, "_written", lambda docs, *a: seen.append(docs) or written(docs, *a))
    t = adapter.read(spark, SMALL)
    back = source_queries.round_stats_read(t)
    assert len(back.inputFiles()) == 1 and back.count() == t.rounds.count()
    exchanges = [p for p in seen[0]._jdf.queryExecution().executedPlan().toString().split("Join")[0].splitlines() if "Exchange" in p]
    assert len(exchanges) == 1


def test_rows_of_one_set_do_not_move_when_they_are_read(spark, tmp_path, monkeypatch):
    """Of a store with several upserts only the rows of keys that stand there twice are grouped."""
    monkeypatch.setattr(keyed_store, "FEW", 0)
    store = KeyedStore(spark, str(tmp_path / "store"), "id long, text string", "id", 4)
    rows = lambda low, high, text: spark.range(low, high).selectExpr("id", f"'{text}' AS text").repartition(store.parts(), "id")
    store.upsert(rows(0, 100, "old"), placed=True)
    store.upsert(rows(100, 200, "old"), placed=True)
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan.split("Aggregate")[1]
    assert store.read().filter("text = 'old'").count() == 200 and len(list((tmp_path / "store").glob("*/bucket=*/*.parquet"))) == 8
    store.upsert(rows(90, 110, "new"), placed=True)
    assert sorted((r["id"], r["text"]) for r in store.read().collect()) == [(i, "new" if 90 <= i < 110 else "old") for i in range(200)]


def test_corners_move_once_into_the_matrix(spark):
    """Rows move by bout as they are, and not as both corners' columns, of which half are empty."""
    m = matchup.matrix(queries.enriched(adapter.read(spark, SMALL)))
    plan = m.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [bout_id" in plan.split("Aggregate [bout_id")[1]


def test_training_rows_are_written_once_without_differences(spark, monkeypatch):
    written = []
    monkeypatch.setattr(model, "cut", lambda df: written.append(df.columns) or scratch.cut(df))
    rows, names = model.live_dataset(matchup.matrix(queries.enriched(adapter.read(spark, SMALL))))
    assert any(c.endswith("_diff") for c in names) and len(written) == 1 and not [c for c in written[0] if c.endswith("_diff")]
    model.run_training(rows, names, written=True, iterations=1, depth=1)
    assert len(written) == 1


def test_a_hypothetical_bout_looks_at_a_small_table_of_corners(spark):
    """The two fighters' corners are a table of known size, so that rounds and bouts of all others needn't move to meet them."""
    t = adapter.read(spark, SMALL)
    assert not [f for f in model.hypothetical(t, 1, 2, "2030-06-15").inputFiles() if "/bout_fighters/" in f]


def test_late_fighters_are_told_from_their_first_new_rows(spark):
    """advance() finds late fighters once, as a table, and its features' plan has no join that moves rows for them."""
    t = adapter.read(spark, SMALL)
    frame, shares = long_frame(t), features.corner_shares(t)
    rows = scratch.cut(features.prepared(frame, shares))
    earlier = F.col("event_date") < F.lit("1998-01-01").cast("date")
    states = scratch.cut(state.states_of(frame, shares, rows.filter(earlier)))
    step = state.advance(states, frame, t.fighters, shares, rows.filter(~earlier))
    assert "Join" not in step.late._jdf.queryExecution().optimizedPlan().toString() and step.late.isEmpty()
    again = state.advance(states, frame, t.fighters, shares, rows)
    want = {r["fighter_id"] for r in rows.filter(earlier).select("fighter_id").collect()}
    assert {r["fighter_id"] for r in again.late.collect()} == want
