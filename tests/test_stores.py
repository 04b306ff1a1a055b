"""Stores: commits, choosing of files, two writers, and the feature sink between its steps."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from ringside.plans import ingest, runs
from ringside.plans.matchup import feature_store
from ringside.schema import Tables, empty_tables
from ringside.sources import files, keyed_store
from ringside.sources.commits import CommitLog, Conflict, State
from ringside.sources.store import TableStore
from tests.test_ingest import Documents, card

D = dt.date


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    seen = log.state()
    file = lambda name: {"path": f"{tmp_path}/{name}", "rows": 1}
    log.put(seen, [file("a")], most={"n": 3})
    with pytest.raises(Conflict):
        CommitLog(spark, str(tmp_path)).put(seen, [file("b")])
    for i in range(45):  # over two whole lists
        log.put(log.state(), [file(f"f{i}")], [f"{tmp_path}/f{i - 1}"], {"n": i % 7})
    now = CommitLog(spark, str(tmp_path)).state()
    assert (now.number, sorted(p.rsplit("/", 1)[1] for p in now.files), now.most) == (46, ["a", "f44"], {"n": 6})
    assert sorted(p.rsplit("/", 1)[1] for p in log.state(10).files) == ["a", "f8"] and State() == log.state(0)


def docs(spark, tmp_path, key, day, bouts, fighters):
    """(event, fighters, stats) of one card's documents."""
    all_of = card(key, day, bouts, fighters)
    put = lambda name, d: (tmp_path / f"{key}-{name}.json").write_text(json.dumps(d)) and str(tmp_path / f"{key}-{name}.json")
    event = files.event_documents(spark, put("event", all_of["event", key]))
    people = files.fighter_documents(spark, [put(f, all_of["fighter", f]) for f in fighters])
    return event, people, files.bout_stats_documents(spark, [put(b, all_of["bout", b]) for b, _, _ in bouts])


def test_two_writers(spark, tmp_path):
    """Two events with common fighters at once: no row is lost, ids and natural keys stay unique."""
    both = threading.Barrier(2)
    cards = [docs(spark, tmp_path, "ufc-1", "2020-01-01", [("x1", "a-a", "b-b")], ["a-a", "b-b"]), docs(spark, tmp_path, "ufc-2", "2020-02-01", [("x2", "a-a", "c-c")], ["a-a", "x-x", "c-c"])]
    failed = []

    def write(documents):
        store, first = TableStore(spark, str(tmp_path / "store")), [True]

        def make(view):
            if first.pop() if first else False:
                both.wait(60)  # both have seen the empty store
            return ingest.event_rows_to_add(ingest.tables_for(view, documents[0], documents[1]), *documents, last=view.last_ids())

        try:
            store.update(make)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(c,)) for c in cards]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == []
    t = TableStore(spark, str(tmp_path / "store")).read()
    for table, key, n in ((t.fighters, ["name_normalized", "date_of_birth"], 4), (t.events, ["name", "date"], 2), (t.bouts, ["event_id"], 2), (t.bout_fighters, ["bout_id", "fighter_id"], 4)):
        assert table.count() == n == table.select("id").distinct().count() == table.select(*key).distinct().count()
    with pytest.raises(Conflict):
        store = TableStore(spark, str(tmp_path / "store"))
        store.append(t, "late", based_on=store.log.state(1))


def test_an_event_opens_its_own_files(spark, tmp_path, monkeypatch):
    """However many events a store has, an intake reads the files of its own keys; compacted or not."""
    monkeypatch.setattr("ringside.sources.sorted_files.FILE_ROWS", 40)
    store, none = TableStore(spark, str(tmp_path / "store")), empty_tables(spark)
    events = spark.range(1, 601).select(F.col("id").cast("int"), F.concat(F.lit("UFC "), F.col("id") + 1000).alias("name"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    bouts = spark.range(1, 1201).select(F.col("id").cast("int"), F.expr("cast(1 + id % 600 as int)").alias("event_id"))
    corners = spark.range(1, 2401).select(F.col("id").cast("int"), F.expr("cast((id + 1) / 2 as int)").alias("bout_id"), F.expr("cast(1 + id % 900 as int)").alias("fighter_id"))
    fighters = spark.range(1, 901).select(F.col("id").cast("int"), F.format_string("n%04d x", "id").alias("name"), F.format_string("n%04d x", "id").alias("name_normalized"), F.lit(D(1980, 1, 1)).alias("date_of_birth"))
    store.append(Tables(fighters, events, bouts, corners, none.rounds), "base")
    store.compact()
    opened = {}
    for i, key in enumerate(("ufc-9001", "ufc-9002")):
        mine = docs(spark, tmp_path, key, f"2030-01-0{i + 1}", [("x1", "n0005-x", f"new-{i}")], ["n0005-x", f"new-{i}"])
        view = store.snapshot()
        part = ingest.tables_for(view, mine[0], mine[1])
        opened[key] = sum(len(getattr(part, t).inputFiles()) for t in ("fighters", "events", "bouts", "bout_fighters", "rounds"))
        whole, pruned = (ingest.event_rows_to_add(t, *mine, last=view.last_ids()) for t in (view.read(), part))
        for t in ("fighters", "events", "bouts", "bout_fighters"):
            assert sorted(map(str, getattr(whole, t).collect())) == sorted(map(str, getattr(pruned, t).collect()))
        assert store.update(lambda v, m=mine: ingest.event_rows_to_add(ingest.tables_for(v, m[0], m[1]), *m, last=v.last_ids()))["bouts"] == 1  # noqa: B023
    assert len(store.read().fighters.inputFiles()) > 20 and max(opened.values()) <= 3
    again = docs(spark, tmp_path, "ufc-9002", "2030-01-02", [("x1", "n0005-x", "new-1")], ["n0005-x", "new-1"])
    view = store.snapshot()
    part = ingest.tables_for(view, again[0], again[1])
    assert sum(len(getattr(part, t).inputFiles()) for t in ("fighters", "events", "bouts", "bout_fighters")) <= 6
    assert not any(getattr(ingest.event_rows_to_add(part, *again, last=view.last_ids()), t).count() for t in ("fighters", "events", "bouts", "bout_fighters"))
    # Files that no commit names any more go; readers still find all rows.
    assert store.vacuum(3600) == [] and len(store.vacuum(-1)) == 4 and store.read().bouts.count() == 1202 and store.read().fighters.count() == 902


def test_compaction_beside_an_append(spark, tmp_path):
    store, none = TableStore(spark, str(tmp_path)), empty_tables(spark)
    event = lambda i: Tables(none.fighters, spark.createDataFrame([(i, f"E{i}", D(2020, 1, i))], "id int, name string, date date"), none.bouts, none.bout_fighters, none.rounds)
    store.append(event(1), "a")
    seen = store.snapshot()
    store.append(event(2), "b")
    store.append(seen.read(), "c", instead_of=("a",))  # a compaction that had not seen b
    assert store.batches() == ["b", "c"] and sorted(r["id"] for r in store.read().events.collect()) == [1, 2]
    with pytest.raises(Conflict):
        store.append(seen.read(), "d", instead_of=("a",))
    with pytest.raises(ValueError):
        store.append(event(3), "c")
    assert seen.read().events.count() == 1 and store.snapshot().last_ids()["events"] == 2


def test_faulty_events_leave_the_others(spark, tmp_path):
    """Lines that fit two corners, a document without success and one that can't be read: all other events are stored, then the faults are raised."""
    keys = [f"ufc-{i}" for i in range(1, 6)]
    all_of = {}
    for i, key in enumerate(keys):
        all_of |= card(key, f"202{i}-05-01", [(f"x{i}", f"a{i}-a", f"b{i}-b")], [f"a{i}-a", f"b{i}-b"])
    all_of["stats", "ufc-3"]["success"] = False
    source, store = Documents(all=all_of), TableStore(spark, str(tmp_path / "store"))
    zone = files.LandingZone(spark, str(tmp_path / "zone"), files.CallBudget(500))
    for key in keys:
        runs.run_incremental(store, key, zone, source)
    t = store.read()
    second = t.events.filter("name = 'UFC 2'").first()["id"]
    bout = t.bouts.filter(F.col("event_id") == second).first()["id"]
    none = empty_tables(spark)
    twin = spark.createDataFrame([(1001, "A1 A", "a1 a", D(1999, 1, 1))], "id int, name string, name_normalized string, date_of_birth date")
    store.append(Tables(twin, none.events, none.bouts, spark.createDataFrame([(1001, bout, 1001, "red")], "id int, bout_id int, fighter_id int, corner string"), none.rounds))
    (tmp_path / "zone" / "stats_ufc-4.json").write_text("{not json")
    with pytest.raises(runs.EventsFailed, match="more than one corner is a1 a") as e:
        runs.run_backfill_rounds(store, zone, source)
    faulty = {r["id"] for r in t.events.filter("name in ('UFC 2', 'UFC 3', 'UFC 4')").collect()}
    assert set(e.value.problems) == faulty
    rounds = store.read().rounds.join(store.read().bout_fighters.select(F.col("id").alias("bout_fighter_id"), "bout_id"), "bout_fighter_id").join(t.bouts.select(F.col("id").alias("bout_id"), "event_id"), "bout_id")
    assert rounds.count() == 8 and {r["event_id"] for r in rounds.collect()} == {r["id"] for r in t.events.collect()} - faulty
    with pytest.raises(runs.EventsFailed):
        runs.run_backfill_rounds(store, zone, source)
    assert store.read().rounds.count() == 8


def test_budget(monkeypatch):
    assert files.call_budget().most == 500 and files.call_budget(7).most == 7
    monkeypatch.setenv("CALLS", "12")
    assert files.call_budget(None, "CALLS").most == 12 and files.call_budget(0, "CALLS").most == 0 and files.call_budget(None, "OTHER").most == 500
    monkeypatch.setenv("CALLS", "many")
    with pytest.raises(ValueError):
        files.call_budget(None, "CALLS")


def rows(spark, ids, text):
    return spark.createDataFrame([(i, text, "red", "test") for i in ids], "bout_id long, features string, target_winner_corner string, source string")


def texts(df):
    out = {r["bout_id"]: r["features"] for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_feature_upserts(spark, tmp_path):
    store = feature_store(spark, str(tmp_path / "f"), buckets=8)
    assert store.read().count() == 0 and store.upsert(rows(spark, [], "x")) == 0 and store.log.numbers() == []
    want = dict.fromkeys(range(200), "first")
    assert store.upsert(rows(spark, range(200), "first")) == 200 and texts(store.read()) == want
    before = store.log.state()
    for n in range(9):  # of one bout: one bucket is written each time, and rewritten once it has more than MOST sets
        assert store.upsert(rows(spark, [17], f"again {n}")) == 1
        want[17] = f"again {n}"
        assert texts(store.read()) == want
    touched = {f["bucket"] for p, f in store.log.state().files.items() if p not in before.files}
    assert len(touched) == 1 and max(len(s) for s in store._sets(store.log.state()).values()) <= keyed_store.MOST
    assert {p for p, f in before.files.items() if f["bucket"] not in touched} <= set(store.log.state().files)
    store.upsert(rows(spark, [17, 500], "both"))
    assert texts(store.read()) == want | {17: "both", 500: "both"}
    assert texts(store.read(before)) == dict.fromkeys(range(200), "first")  # who has begun to read goes on
    assert feature_store(spark, str(tmp_path / "f"), buckets=99).upsert(rows(spark, [17], "other number")) == 1
    assert texts(store.read())[17] == "other number" and store.buckets(store.log.state()) == 8


def test_feature_sink_killed_between_steps(spark, tmp_path, monkeypatch):
    store = feature_store(spark, str(tmp_path / "f"), buckets=4)
    store.upsert(rows(spark, range(50), "old"))
    put = CommitLog.put
    monkeypatch.setattr(CommitLog, "put", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # rows are written, but not committed
        store.upsert(rows(spark, range(10), "lost"))
    monkeypatch.setattr(CommitLog, "put", put)
    assert set(texts(store.read()).values()) == {"old"}
    for n in range(keyed_store.MOST - 1):
        store.upsert(rows(spark, [3], f"n{n}"))
    monkeypatch.setattr(CommitLog, "put", lambda self, state, add, drop=(), most=None: (_ for _ in ()).throw(KeyboardInterrupt) if drop else put(self, state, add, drop, most))
    with pytest.raises(KeyboardInterrupt):  # the upsert counts, the rewriting after it doesn't
        store.upsert(rows(spark, [3], "last"))
    assert texts(store.read())[3] == "last" and len(texts(store.read())) == 50
    monkeypatch.setattr(CommitLog, "put", put)
    assert len(store.compact()) == 1 and texts(store.read())[3] == "last"
    assert len(store.vacuum(-1)) >= 2 and len(texts(store.read())) == 50


def test_rewriting_beside_an_upsert(spark, tmp_path, monkeypatch):
    """What is upserted while a bucket is rewritten stays above the rewritten rows."""
    store = feature_store(spark, str(tmp_path / "f"), buckets=1)
    for n in range(4):
        store.upsert(rows(spark, [1, 2], f"n{n}"))
    write = keyed_store.KeyedStore._write

    def write_slowly(self, r, counts):
        added = write(self, r, counts)
        monkeypatch.setattr(keyed_store.KeyedStore, "_write", write)
        feature_store(spark, str(tmp_path / "f")).upsert(rows(spark, [2, 3], "meanwhile"))
        return added

    monkeypatch.setattr(keyed_store.KeyedStore, "_write", write_slowly)
    assert store.compact(most=1) == [0]
    assert texts(store.read()) == {1: "n3", 2: "meanwhile", 3: "meanwhile"} and len(store._sets(store.log.state())[0]) == 2
