"""Sources, parsers, entity resolution and merges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ringside.functions import display, expr
from ringside.functions.names import name_key, normalize_name
from ringside.plans import ingest, reads, runs
from ringside.schema import Tables, empty_tables
from ringside.sources import files
from ringside.sources.scratch import cut
from ringside.sources.store import TableStore

D = dt.date


def test_name_key(spark):
    assert name_key("  José  Aldo Jr. ") == "jose aldo" and name_key("Jr. Łukasz Ø II") == "ukasz" and name_key("ﬁn") == "fin"
    df = spark.createDataFrame([("Ana III",), (None,)], "n string")
    assert [r[0] for r in df.select(normalize_name(F.col("n"))).collect()] == ["ana", None]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_parsers(spark):
    assert tuple(one(spark, expr.parse_stat, "66 of 125")) == (66, 125) and tuple(one(spark, expr.parse_stat, " ")) == (None, None)
    assert one(spark, expr.parse_clock, "7:13") == 433 and one(spark, expr.parse_clock, "--") is None and one(spark, expr.parse_clock, None) is None
    for f, bad in ((expr.parse_stat, "66/125"), (expr.parse_clock, "7:60"), (expr.int_strict, "abc")):
        with pytest.raises(Exception):
            one(spark, f, bad)
    assert [one(spark, expr.int_strict, x) for x in ("182.5", "183.5", "17.0", "", " ")] == [182, 184, 17, None, None]
    assert one(spark, expr.int_lenient, "abc") is None and one(spark, expr.int_lenient, "2.5") == 2
    assert [one(spark, expr.bool_lenient, x) for x in ("1", "0.0", "x", "")] == [True, False, None, None]
    assert one(spark, expr.long_date, "March 4, 2023") == D(2023, 3, 4) and one(spark, expr.short_date, "Mar 14, 2023") == D(2023, 3, 14)
    assert one(spark, lambda x: expr.long_date(x, strict=False), "soon") is None
    assert one(spark, expr.stance_of, " Southpaw ") == "southpaw" and one(spark, expr.stance_of, "Open") is None
    assert one(spark, lambda x: expr.method_of(x, expr.CSV_METHODS), "TKO - Doctor's Stoppage") == "ko_tko" and one(spark, lambda x: expr.method_of(x, expr.JSON_METHODS), None) == "no_contest"
    assert one(spark, expr.event_slug, " ufc 300: A vs B") == "ufc-300" and one(spark, expr.event_slug, "UFC Fight Night") is None and one(spark, expr.event_slug, "UFC 300x") is None


def test_pairs_and_clocks_of_all_forms(spark):
    """Pairs as they are written and in other forms that the pattern allows; clocks as by a format of two digits."""
    forms = {"0 of 0": (0, 0), "007  of 9": (7, 9), " 6 of\t7 ": (6, 7), "3000000000 of 1": (None, 1), "2147483647 of 2": (2147483647, 2)}
    got = spark.createDataFrame([(t,) for t in forms], "x string").select("x", expr.parse_stat(F.col("x")).alias("p")).collect()
    assert {r["x"]: tuple(r["p"]) for r in got} == forms
    for bad in ("-1 of 2", "+1 of 2", "1 of 2 of 3", "1 of", "1.0 of 2", "1 2"):
        with pytest.raises(Exception):
            one(spark, expr.parse_stat, bad)
    clocks = spark.createDataFrame([(i,) for i in (None, 0, 9, 60, 433, 3599, 36000, -5, -70)], "x int").select("x", expr.clock_text(F.col("x")).alias("t"), F.when(F.col("x").isNotNull(), F.format_string("%d:%02d", F.floor(F.col("x") / 60).cast("int"), F.col("x") % 60)).alias("want"))
    assert clocks.filter("not t <=> want").isEmpty()


def test_the_reading_of_lines_is_compiled(spark, tmp_path):
    """The code that Spark makes for a line of statistics has no method of more than 8,000 bytes, which the JVM would interpret."""
    lines = files.event_stats_documents(spark, str(tmp_path), rounds=True)
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(lines._jdf.queryExecution().executedPlan())
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and max(sizes) <= 8000


def test_results(spark):
    df = spark.createDataFrame([(1, 1, "dq"), (2, 1, "no_contest"), (None, 1, "no_contest"), (None, 1, "decision")], "w int, f int, m string")
    assert [r[0] for r in df.select(expr.result_of(F.col("w"), F.col("f"), F.col("m"))).collect()] == ["win", "loss", "no_contest", "draw"]


def test_display(spark):
    df = spark.createDataFrame([(2, 255, 0.425, 3.25, D(2024, 5, 1)), (None, None, None, None, None)], "r int, s int, p double, a double, d date")
    got = df.select(display.ending_time(F.col("r"), F.col("s")), display.percent(F.col("p")), display.average(F.col("a")), display.day(F.col("d")), display.attempts(F.col("r"), F.col("s")), display.probability(F.col("p"))).collect()
    assert tuple(got[0]) == ("R2 4:15", "43%", "3,3", "01/05/2024", "2 de 255", "43%")
    assert tuple(got[1]) == ("—", "sem dado", "—", "—", "—", "0%")
    df = spark.createDataFrame([(True, "decision", 93.0, 62.5, 180, "southpaw"), (False, "no_contest", 70.3, None, None, None), (False, "dq", None, 59.6, 1, "x")], "won boolean, m string, kg double, s double, cm int, st string")
    got = df.select(display.result(F.col("won"), F.col("m")), display.kilograms(F.col("kg")), display.average_control(F.col("s")), display.centimetres(F.col("cm")), display.label(F.col("st"), display.STANCE_LABELS)).collect()
    assert [tuple(r) for r in got] == [("Vitória", "93 kg", "1:03", "180 cm", "Canhota"), ("Sem resultado", "70,3 kg", "—", "—", "—"), ("Derrota", "—", "1:00", "1 cm", "—")]


FIGHTERS = '''id,name,nick_name,wins,losses,draws,height,weight,reach,stance,dob
1,Ana Silva,,10,2,0,170.5,60,172.0,Orthodox,"Jan 2, 1990"
2,ana silva jr.,Two,1,1,1,160,60,,Open,"Jan 2, 1990"
3,Ana Silva,,0,0,0,,,,,
4,Bea Costa,"The ""Rock""",5,5,0,165,60,165,Southpaw,"Feb 3, 1991"
5,Cara Dias,,1,0,0,165,60,165,Switch,"Feb 3, 1992"
'''
EVENTS = """event_id,fight_id,date,location,winner,winner_id
e1,f1,"March 4, 2023","Rio, Brazil",Bea Costa,4
e1,f2,"March 4, 2023",,,
e2,f3,"April 5, 2023",,Cara Dias,5
"""
FIGHTS = """event_name,event_id,fight_id,r_name,b_name,division,method,finish_round,match_time_sec,r_kd,r_sig_str_landed,r_sig_str_atmpted,r_td_landed,r_td_atmpted,r_sub_att,r_ctrl,b_kd,b_sig_str_landed,b_sig_str_atmpted,b_td_landed,b_td_atmpted,b_sub_att,b_ctrl,title_fight,total_rounds,referee,r_head_landed,b_head_landed
Night One,e1,f1,Bea Costa,Cara Dias,fly,KO/TKO,2,100.0,1.0,20.0,30.0,,,,,0,10,20,,,,,1,5,Ref,12.0,x
Night 1,e1,f2,Cara Dias,Bea Costa,fly,Decision - Split,3,300,0,9,9,0,0,0,0,0,8,8,0,0,0,0,0,3,,7,8
Night Two,e2,f3,Ana Silva,Cara Dias,fly,Other,1,50,0,1,1,0,0,0,0,0,2,2,0,0,0,0,0,3,,1,1
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    for name, text in ((files.FIGHTER_FILE, FIGHTERS), (files.EVENT_FILE, EVENTS), (files.FIGHT_FILE, FIGHTS)):
        (d / name).write_text(text)
    return str(d)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    t = empty_tables(spark)
    fights, events = files.fight_details(spark, folder), files.event_details(spark, folder)
    t = Tables(cut(ingest.load_fighters(t.fighters, files.fighter_details(spark, folder))), cut(ingest.load_events(t.events, fights, events)), t.bouts, t.bout_fighters, t.rounds)
    after, rejects = ingest.load_bouts(t, fights, events)
    return Tables(after.fighters, after.events, cut(after.bouts), cut(after.bout_fighters), after.rounds), rejects, fights, events


def test_csv_fighters(loaded):
    t = loaded[0]
    rows = {(r["name"], r["date_of_birth"]): r for r in t.fighters.collect()}
    assert len(rows) == 4
    ana = rows["Ana Silva", D(1990, 1, 2)]
    assert (ana["height_cm"], ana["reach_cm"], ana["stance"], ana["nickname"], ana["wins"]) == (170, 172, "orthodox", None, 10)
    assert rows["Bea Costa", D(1991, 2, 3)]["nickname"] == 'The "Rock"'
    assert sorted(r["id"] for r in rows.values()) == [1, 2, 3, 4]


def test_csv_events_and_bouts(loaded):
    t, rejects, _, _ = loaded
    events = {r["name"]: r for r in t.events.collect()}
    assert set(events) == {"Night 1", "Night Two"} and events["Night 1"]["location"] == "Rio, Brazil"
    # The name of f1's row is not the event's last name, f3's red name has two bearers, f2 has no winner: one bout is left.
    assert {r["fight_id"] for r in rejects.collect()} == {"f1", "f3"}
    bout = t.bouts.collect()
    assert len(bout) == 1 and bout[0]["winner_id"] is None and bout[0]["method"] == "decision" and bout[0]["scheduled_rounds"] == 3
    corners = {r["corner"]: r for r in t.bout_fighters.collect()}
    assert corners["red"]["sig_strikes_landed"] == 9 and corners["blue"]["sig_strikes_landed"] == 8 and corners["red"]["head_landed"] is None


def test_loads_are_idempotent(spark, folder, loaded):
    t, _, fights, events = loaded
    again, _ = ingest.load_bouts(Tables(ingest.load_fighters(t.fighters, files.fighter_details(spark, folder)), ingest.load_events(t.events, fights, events), t.bouts, t.bout_fighters, t.rounds), fights, events)
    assert set(ingest.table_changes(t, again).values()) == {0}


def test_backfill_overwrites(loaded):
    t, _, fights, events = loaded
    after = ingest.backfill_splits(t, fights, events, source="again")
    corners = {r["corner"]: r for r in after.bout_fighters.collect()}
    assert (corners["red"]["head_landed"], corners["blue"]["head_landed"], corners["red"]["body_landed"]) == (7, 8, None)
    assert corners["red"]["source"] == "again" and corners["red"]["sig_strikes_landed"] == 9 and after.bouts.first()["referee"] is None


def test_match_fighters(spark):
    known = spark.createDataFrame([(1, "a", D(1990, 1, 1)), (2, "b", D(1990, 1, 1)), (3, "b", D(1991, 1, 1)), (4, "c", None), (5, "d", D(1990, 1, 1)), (6, "d", D(1990, 1, 1))], "id int, name_normalized string, date_of_birth date")
    cases = [("1", "a", D(1990, 1, 1), "match", 1), ("2", "a", D(1999, 1, 1), "new", None), ("3", "a", None, "match", 1), ("4", "b", None, "ambiguous", None), ("5", "c", D(1990, 1, 1), "ambiguous", None), ("6", "z", None, "new", None), ("7", "d", D(1990, 1, 1), "ambiguous", None), ("8", "b", D(1991, 1, 1), "match", 3)]
    got = ingest.match_fighters(spark.createDataFrame([c[:3] for c in cases], "candidate string, name_normalized string, date_of_birth date"), known)
    assert {r["candidate"]: (r["status"], r["fighter_id"]) for r in got.collect()} == {c[0]: c[3:] for c in cases}
    with pytest.raises(Exception, match="more than one"):
        ingest.no_ambiguous(got).collect()


def test_documents(spark, loaded, tmp_path):
    t = loaded[0]
    (tmp_path / "event.json").write_text(json.dumps({"event_id": "ufc-9", "name": "UFC 9", "date": "2023-05-06", "bouts": [{"bout_id": "x1", "method": "KO/TKO", "finish_round": 1, "finish_time_seconds": 30, "weight_class": "fly", "winner_slug": "dora-luz", "corners": [{"slug": "bea-costa", "name": "Bea Costa"}, {"slug": "dora-luz", "name": "Dora Luz"}]}]}))
    (tmp_path / "f1.json").write_text(json.dumps({"slug": "bea-costa", "name": "Bea Costa", "date_of_birth": "1991-02-03"}))
    (tmp_path / "f2.json").write_text(json.dumps({"slug": "dora-luz", "name": "Dora Luz", "stance": "weird", "wins": 3}))
    (tmp_path / "stats.json").write_text(json.dumps({"bout_id": "x1", "fighters": [{"corner": "red", "fighter_slug": "bea-costa", "knockdowns": 1}, {"corner": "blue", "fighter_slug": "dora-luz", "sig_strikes_landed": 4}]}))
    event, fighters, stats = files.event_documents(spark, f"{tmp_path}/event.json"), files.fighter_documents(spark, f"{tmp_path}/f[12].json"), files.bout_stats_documents(spark, f"{tmp_path}/stats.json")
    after = ingest.take_in_event(t, event, fighters, stats)
    assert ingest.table_changes(t, after) == {"fighters": 1, "events": 1, "bouts": 1, "bout_fighters": 2, "rounds": 0}
    dora = after.fighters.filter("name = 'Dora Luz'").first()
    assert dora["wins"] == 3 and dora["losses"] == 0 and dora["stance"] is None
    assert after.bouts.orderBy(F.desc("id")).first()["winner_id"] == dora["id"]
    after = Tables(*[cut(getattr(after, n)) for n in ("fighters", "events", "bouts", "bout_fighters", "rounds")])
    assert set(ingest.table_changes(after, ingest.take_in_event(after, event, fighters, stats)).values()) == {0}
    # Rounds.
    line = {"boutId": "x1", "corner": "red", "fighterSlug": "bea-costa", "knockdowns": 1, "sigStrikes": "3 of 9", "controlTime": "1:05", "extra": 1}
    (tmp_path / "event_stats.json").write_text(json.dumps({"success": True, "data": {"boutStats": [line], "roundStats": [line | {"round": 1}, line | {"round": 2, "sigStrikes": ""}, line | {"round": 1, "fighterSlug": "no-body"}]}}))
    lines = files.event_stats_documents(spark, f"{tmp_path}/event_stats.json", rounds=True)
    event_id = after.events.filter("name = 'UFC 9'").first()["id"]
    filled = ingest.backfill_rounds(after, event_id, lines)
    rows = {r["round"]: r for r in filled.rounds.collect()}
    assert set(rows) == {1, 2} and (rows[1]["sig_strikes_landed"], rows[1]["sig_strikes_attempted"], rows[1]["control_time_seconds"], rows[2]["sig_strikes_landed"]) == (3, 9, 65, None)
    assert tuple(ingest.coverage(ingest.matched_lines(after, event_id, lines)).first()) == (2, 1, 0.5)
    wire = files.to_wire(lines).filter("round = 1 and fighterSlug = 'bea-costa'").first()
    assert (wire["sigStrikes"], wire["controlTime"], wire["head"]) == ("3 of 9", "1:05", None)
    (tmp_path / "failed.json").write_text(json.dumps({"success": False, "data": {"boutStats": [line]}}))
    with pytest.raises(Exception, match="no success"):
        files.event_stats_documents(spark, f"{tmp_path}/failed.json").collect()
    store = TableStore(spark, f"{tmp_path}/tables")
    assert store.append(after)["bouts"] == 2 and store.read().bouts.count() == 2


def test_store(spark, tmp_path):
    """A batch counts once it is whole; batches can be put together; nothing that was written before is touched."""
    store, none = TableStore(spark, str(tmp_path / "s")), empty_tables(spark)
    assert store.read().events.count() == 0 and store.append(none) == dict.fromkeys(("fighters", "events", "bouts", "bout_fighters", "rounds"), 0) and store.batches() == []
    event = lambda i: Tables(none.fighters, spark.createDataFrame([(i, f"E{i}", D(2020, 1, i))], "id int, name string, date date"), none.bouts, none.bout_fighters, none.rounds)
    assert store.append(event(1), "a")["events"] == 1
    event(9).events.write.parquet(str(tmp_path / "s" / "events" / "half"))  # of a batch that failed
    store.append(event(2), "b")
    assert store.batches() == ["a", "b"] and sorted(r["id"] for r in store.read().events.collect()) == [1, 2]
    name = store.compact()
    assert store.batches() == [name] and sorted(r["id"] for r in store.read().events.collect()) == [1, 2]
    store.append(event(3), "c")
    assert sorted(r["id"] for r in store.read().events.collect()) == [1, 2, 3]


class Documents:
    """A transport that counts its calls."""

    def __init__(self, **texts):
        self.texts, self.calls = texts, 0

    def _get(self, kind, key):
        self.calls += 1
        return files.checked_response(200 if (kind, key) in self.texts["all"] else 404, json.dumps(self.texts["all"].get((kind, key))))

    def event(self, key):
        return self._get("event", key)

    def fighter(self, key):
        return self._get("fighter", key)

    def bout_stats(self, key):
        return self._get("bout", key)

    def event_stats(self, key):
        return self._get("stats", key)


def card(event, day, bouts, fighters):
    docs = {("event", event): {"event_id": event, "name": event.replace("ufc-", "UFC "), "date": day, "bouts": [{"bout_id": b, "method": "KO/TKO", "winner_slug": x, "corners": [{"slug": x, "name": x}, {"slug": y, "name": y}]} for b, x, y in bouts]}}
    docs |= {("bout", b): {"bout_id": b, "fighters": [{"corner": "red", "fighter_slug": x, "knockdowns": 1}, {"corner": "blue", "fighter_slug": y}]} for b, x, y in bouts}
    docs |= {("fighter", f): {"slug": f, "name": f.replace("-", " ").title(), "date_of_birth": f"19{80 + i}-01-01"} for i, f in enumerate(fighters)}
    line = lambda b, c, f: {"boutId": b, "corner": c, "fighterSlug": f, "sigStrikes": "3 of 9"}
    lines = [line(b, c, f) for b, x, y in bouts for c, f in (("red", x), ("blue", y))] + [line("zz", "red", "no-body")]
    docs[("stats", event)] = {"success": True, "data": {"boutStats": lines, "roundStats": [x | {"round": n} for x in lines for n in (1, 2)]}}
    return docs


def test_whole_runs(spark, tmp_path):
    names = ["a-a", "b-b", "c-c", "d-d"]
    source = Documents(all=card("ufc-1", "2020-05-01", [("x1", "a-a", "b-b"), ("x2", "c-c", "d-d")], names) | card("ufc-2", "2021-05-01", [("x3", "b-b", "c-c")], names))
    store = TableStore(spark, str(tmp_path / "store"))
    zone = lambda most: files.LandingZone(spark, str(tmp_path / "zone"), files.CallBudget(most))
    with pytest.raises(runs.NotConfirmed):
        runs.gated(source, False)
    with pytest.raises(files.BudgetSpent):  # seven documents are needed
        runs.run_incremental(store, "ufc-1", zone(4), runs.gated(source, True))
    assert store.batches() == [] and source.calls == 4
    got = runs.run_incremental(store, "ufc-1", zone(500), source)
    assert (got.events, got.fighters, got.bouts, got.bout_fighters, got.calls_used) == (runs.Delta(1, 0), runs.Delta(4, 0), runs.Delta(2, 0), runs.Delta(4, 0), 3)
    again = runs.run_incremental(store, "ufc-1", zone(500), source)
    assert (again.events, again.fighters, again.bouts, again.bout_fighters, again.calls_used) == (runs.Delta(0, 1), runs.Delta(0, 4), runs.Delta(0, 2), runs.Delta(0, 4), 0)
    more = runs.run_incremental(store, "ufc-2", zone(500), source)
    assert (more.fighters, more.bouts, more.bout_fighters) == (runs.Delta(0, 2), runs.Delta(1, 0), runs.Delta(2, 0)) and len(store.batches()) == 2
    with pytest.raises(files.SourceError):
        runs.run_incremental(store, "ufc-3", zone(500), source)

    none = empty_tables(spark)
    store.append(Tables(none.fighters, spark.createDataFrame([(77, "Fight Night", D(2020, 6, 1))], "id int, name string, date date"), none.bouts, none.bout_fighters, none.rounds))
    first = store.read().events.filter("name = 'UFC 1'").first()["id"]
    report = runs.run_match_dry_run(store, first, zone(1), source)
    assert (report.matched, report.total, report.unmatched_slugs, report.coverage) == (4, 5, ("no-body",), 0.8)
    with pytest.raises(ValueError):
        runs.run_match_dry_run(store, 77, zone(1), source)
    pauses = []
    with pytest.raises(files.BudgetSpent):  # the first event's lines are there already, the second's are not
        runs.run_backfill_rounds(store, zone(0), source, pause=lambda: pauses.append(1))
    assert store.read().rounds.count() == 8 and pauses == []
    done = runs.run_backfill_rounds(store, zone(5), source)
    assert (done.events_processed, done.events_skipped, done.rounds_inserted, done.cache_hits, done.calls_used) == (2, 1, 4, 1, 1)
    assert runs.run_backfill_rounds(store, zone(5), source).rounds_inserted == 0
    assert runs.run_backfill_rounds(store, zone(5), source, "2021-01-01", "2021-12-31").events_processed == 1
    rounds = store.read().rounds
    assert rounds.count() == rounds.select("id").distinct().count() == 12 and rounds.filter("sig_strikes_landed = 3 and sig_strikes_attempted = 9").count() == 12


def test_shared_folder():
    from types import SimpleNamespace

    from ringside.sources.scratch import shared_dir

    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k) or d, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    one = session("local[4]")
    assert shared_dir(one) == shared_dir(one)
    for master in ("local-cluster[3,2,1000]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_answers_of_sources():
    assert files.checked_response(200, "{}") == "{}"
    with pytest.raises(files.OverLimit):
        files.checked_response(429, "")
    with pytest.raises(files.SourceError):
        files.checked_response(500, "")


def test_landing_zone(spark, tmp_path):
    asked = []
    zone = files.LandingZone(spark, str(tmp_path), files.CallBudget(1))
    fetch = lambda key: asked.append(key) or "{}"
    assert zone.get_or_fetch("a", fetch) == zone.get_or_fetch("a", fetch) and asked == ["a"]
    with pytest.raises(RuntimeError):
        zone.get_or_fetch("b", fetch)


def test_pages():
    for bad in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            reads.page_bounds(*bad)
    assert reads.page_bounds() == (50, 0)


def test_events_as_they_arrive(spark, tmp_path):
    from ringside.streaming.documents import follow_events

    for d in ("events", "fighters", "stats"):
        (tmp_path / d).mkdir()
    for i, slug in enumerate(("a-a", "b-b", "c-c")):
        (tmp_path / "fighters" / f"{slug}.json").write_text(json.dumps({"slug": slug, "name": slug.replace("-", " "), "date_of_birth": f"199{i}-01-01"}))
    (tmp_path / "stats" / "s.json").write_text(json.dumps({"bout_id": "x1", "fighters": [{"corner": "red", "fighter_slug": "a-a", "knockdowns": 2}]}))

    def arrive(name, day, a, b):
        (tmp_path / "events" / f"{name}.json").write_text(json.dumps({"event_id": name, "name": name, "date": day, "bouts": [{"bout_id": "x1", "method": "KO/TKO", "winner_slug": a, "corners": [{"slug": a, "name": a}, {"slug": b, "name": b}]}]}))
        follow_events(spark, *[str(tmp_path / x) for x in ("events", "fighters", "stats", "tables", "checkpoint")]).awaitTermination()
        return TableStore(spark, str(tmp_path / "tables")).read()

    t = arrive("one", "2024-01-01", "a-a", "b-b")
    assert (t.fighters.count(), t.bouts.count(), t.bout_fighters.filter("knockdowns = 2").count()) == (2, 1, 1)
    t = arrive("two", "2024-02-01", "c-c", "a-a")
    assert (t.fighters.count(), t.events.count(), t.bouts.count(), t.bout_fighters.count()) == (3, 2, 2, 4)
