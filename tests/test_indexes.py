"""Search of names, pages at any offset and running sums against scans."""

import random

import pytest
from pyspark.sql import functions as F

from ringside.operators.name_index import NameIndex, grams_of
from ringside.operators.pages import PagedTable
from ringside.operators.prefix import running_sums
from ringside.plans import reads
from ringside.schema import empty_tables


def test_grams():
    assert grams_of("%silva%") == ["ilv", "lva", "sil"] and grams_of("%a%") == ["a"] and grams_of("%%") == grams_of("%_%") == []
    assert grams_of("%ab_cde%f%") == ["ab", "cde", "f"] and grams_of(r"%a\%b%") == ["a%b"]


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ringside.operators.name_index.RANGE_ROWS", 50)
    r = random.Random(1)
    names = [" ".join("".join(r.choice("abcé'-İ%_") for _ in range(r.randint(1, 9))).capitalize() for _ in range(2)) for _ in range(300)] + ["Ana Silva", "ANA  SILVA", "x", "", None, "100% _b\\c", "Ana Silva"]
    fighters = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    index = NameIndex(spark, str(tmp_path / "names"))
    index.write(fighters)
    files = len(index._files([""]))
    for text in ("silva", "ANA s", "a", "ab", "é", "b_a", "%", "_", "a%b", r"\%", r"100\% \_", "no such", "", None, "x", "abc"):
        want = {(x["id"], x["name"]) for x in fighters.filter("name is not null").filter(F.col("name").ilike(f"%{text or ''}%")).collect()}
        assert {(x["id"], x["name"]) for x in index.search(text).collect()} == want, text
        if text:
            assert {x["id"] for x in reads.named(fighters, text, index).collect()} == {i for i, _ in want}
    every = sum(len(f["parts"]) for f in index.log.state().files.values())
    assert every > 30 and len(index.search("silva").inputFiles()) <= 3 and files < every
    index.write(fighters.filter("id < 3"))  # in place of the others
    assert index.search("").count() == 3


@pytest.mark.parametrize("size", [7, 40, 10_000])
def test_pages_equal_offset_and_limit(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr("ringside.operators.pages.RANGE_ROWS", size)
    rows = spark.range(500).select(F.col("id").cast("int"), F.expr("date_add(date '2020-01-01', cast(id % 37 as int))").alias("date"), F.lit("e").alias("name"))
    t = empty_tables(spark)
    t = type(t)(t.fighters, rows, t.bouts, t.bout_fighters, t.rounds)
    pages = reads.event_pages(spark, str(tmp_path / "pages"))
    with pytest.raises(LookupError):
        pages.page(1, 0)
    assert pages.write(rows) == pages.total() == 500
    for limit, offset in ((24, 0), (24, 13), (100, 401), (50, 480), (10, 500), (10, 5000), (1, 499)):
        plain, paged = reads.list_events(t, limit, offset), reads.list_events(t, limit, offset, pages)
        assert plain.items.collect() == paged.items.select(*rows.columns).collect() and plain.total == paged.total
    assert len(pages.page(1, 250).inputFiles()) == 1
    pages.write(rows.limit(0))
    assert pages.total() == 0 and pages.page(5, 0).count() == 0


def test_running_sums(spark):
    """Also of values that crowd in one place, and with nulls."""
    r = random.Random(2)
    data = [(0.5 + r.random() * 1e-9 if r.random() < 0.9 else r.random(), i, r.choice([None, 1, 2, 5]), r.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "p double, i long, n int, x double").repartition(5)
    got = {x["i"]: x for x in running_sums(df, ["p", "i"], ["n", "x"]).collect()}
    n = x = 0
    for p, i, k, v in sorted(data):
        assert got[i]["n_before"] == n and abs(got[i]["x_before"] - x) < 1e-6 and got[i]["p"] == p
        n, x = n + (k or 0), x + v
    assert running_sums(df.limit(0), ["p"], ["n"]).count() == 0
    down = running_sums(df, [F.col("i").desc()], ["n"]).orderBy(F.col("i").desc()).first()
    assert down["i"] == 2999 and down["n_before"] == 0
