"""The histogram booster against one that goes through all rows for every split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.plans import boosting, model
from ringside.plans.boosting import UNIT, Booster, Options


def table(seed, n=240, integers=False):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a = None if r.random() < 0.3 else float(r.randint(0, 9)) if integers else r.gauss(0, 1)
        b, c = r.choice([None, float("nan"), 1.0, 2.0, 5.0]), float(r.randint(0, 3))
        p = 0.85 if a is None else 0.5 + 0.3 * math.copysign(1, a - (4 if integers else 0)) * (1 if c > 1 else -1)
        rows.append((float(r.random() < p), a, b, c, None))
    return rows


SCHEMA = "label double, a double, b double, c double, never double"
NAMES = ["a", "b", "c", "never"]


def plain_trees(rows, edges, o, start):
    """Trees as nested tuples: (feature, bin, missing left, left, right) or a leaf's value; by rows, not histograms."""
    missing = lambda v: v is None or math.isnan(v)
    bins = [[o.bins if missing(v) else sum(e < v for e in es) for v, es in zip(row[1:], edges)] for row in rows]
    score, trees = [start] * len(rows), []
    unit = lambda x: int(np.rint(x * UNIT))
    for _ in range(o.iterations):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [unit(q - row[0]) for q, row in zip(p, rows)], [unit(q * (1 - q)) for q in p]

        def best(members):
            total = sum(g[i] for i in members), sum(h[i] for i in members)
            worth = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + o.l2)
            found = None
            for f in range(len(edges)):
                lost = [i for i in members if bins[i][f] == o.bins]
                for left_too in (False, True) if lost else (False,):
                    for at in range(o.bins):
                        low = [i for i in members if bins[i][f] <= at and bins[i][f] != o.bins or left_too and bins[i][f] == o.bins]
                        if not o.leaf_rows <= len(low) <= len(members) - o.leaf_rows:
                            continue
                        a = sum(g[i] for i in low), sum(h[i] for i in low)
                        b = total[0] - a[0], total[1] - a[1]
                        if min(a[1], b[1]) < o.leaf_curvature * UNIT:
                            continue
                        gain = worth(*a) + worth(*b) - worth(*total)
                        if gain > 0 and (found is None or gain > found[0]):
                            way = left_too if lost else 2 * len(low) > len(members)
                            found = gain, f, at, way, low
            return found

        # Level by level, best gains first.
        nodes, level, leaves = {0: list(range(len(rows)))}, [0], 1
        made, count = {}, 1
        for _ in range(o.depth):
            ranked = sorted(((b, n) for n in level if (b := best(nodes[n]))), key=lambda x: (-x[0][0], x[1]))[: o.leaves - leaves]
            leaves += len(ranked)
            level = []
            for (_, f, at, way, low), n in ranked:
                inside = set(low)
                made[n] = (f, at, way, count, count + 1)
                nodes[count], nodes[count + 1] = low, [i for i in nodes[n] if i not in inside]
                level += [count, count + 1]
                count += 2
            if not ranked or leaves >= o.leaves:
                break
        value = {n: -o.rate * (sum(g[i] for i in m) / UNIT) / (sum(h[i] for i in m) / UNIT + o.l2) for n, m in nodes.items() if n not in made}
        for n, v in value.items():
            for i in nodes[n]:
                score[i] += v
        shape = lambda n: made[n][:3] + (shape(made[n][3]), shape(made[n][4])) if n in made else value[n]  # noqa: B023, E731
        trees.append(shape(0))
    return trees, score


def shape(tree, n=0):
    if tree.feature[n] < 0:
        return tree.value[n]
    return tree.feature[n], tree.bin[n], tree.missing_left[n], shape(tree, tree.left[n]), shape(tree, tree.right[n])


def same(a, b):
    if isinstance(a, tuple) or isinstance(b, tuple):
        return a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4])
    return abs(a - b) < 1e-9


@pytest.mark.parametrize("seed,integers,o", [
    (1, True, Options(iterations=3, depth=3, leaf_rows=5, bins=12)),
    (2, False, Options(iterations=2, depth=4, leaf_rows=8, bins=16, leaves=6)),
    (3, True, Options(iterations=4, depth=1, leaf_rows=20, bins=10, l2=1.0, rate=0.5)),
])
def test_trees_equal_a_booster_over_rows(spark, seed, integers, o):
    rows = table(seed, integers=integers)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = boosting.fit(df, NAMES, options=o)
    ones = sum(r[0] for r in rows)
    assert got.start == math.log(ones / (len(rows) - ones)) and got.edges[3] == [] and len(got.edges[1]) == 2
    want, score = plain_trees(rows, got.edges, o, got.start)
    assert all(same(shape(t), w) for t, w in zip(got.trees, want, strict=True))
    assert any(t.missing_left[0] or "missing" for t in got.trees)
    p = {tuple(str(v) for v in r[:5]): r["probability"] for r in got.probability(df).collect()}
    for row, s in zip(rows, score):
        assert abs(p[tuple(str(v) for v in row)] - 1 / (1 + math.exp(-s))) < 1e-9


def test_the_way_of_missing_values_is_learned(spark):
    """Missing values mean red here, as large ones do; an imputed median would hide it."""
    rows = [(1.0, None)] * 40 + [(0.0, float(i)) for i in range(40)] + [(1.0, float(100 + i)) for i in range(40)]
    got = boosting.fit(spark.createDataFrame(rows, "label double, x double"), ["x"], options=Options(iterations=30, depth=1))
    assert all(not t.missing_left[0] for t in got.trees)
    scored = got.probability(spark.createDataFrame([(None,), (float("nan"),), (5.0,), (130.0,)], "x double")).collect()
    assert [r["probability"] > 0.5 for r in scored] == [True, True, False, True]
    # Missing rows alone on one side.
    rows = [(1.0, None)] * 40 + [(0.0, float(i)) for i in range(40)]
    t = boosting.fit(spark.createDataFrame(rows, "label double, x double"), ["x"], options=Options(iterations=1, depth=1)).trees[0]
    assert t.feature[0] == 0 and not t.missing_left[0] and t.value[1] < 0 < t.value[2]


def test_models_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(table(9, 600), SCHEMA)
    o = Options(iterations=12, depth=3)  # more trees than are kept apart from the rows' sums
    one, two = boosting.fit(df.repartition(7), NAMES, options=o), boosting.fit(df.coalesce(1), NAMES, options=o)
    assert one.to_json() == two.to_json() and Booster.from_json(one.to_json()) == one
    assert len(one.trees) == 12 and all(len(t.feature) > 1 for t in one.trees)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame(table(4, 50), SCHEMA)
    assert boosting.fit(df.limit(0), NAMES).trees == [] and boosting.fit(df.filter("label = 1"), NAMES).start > 20
    none = boosting.fit(df, ["never"])
    assert none.trees == [] and abs(none.probability(df).first()["probability"] - 1 / (1 + math.exp(-none.start))) < 1e-12
    assert boosting.fit(df, []).probability(df).filter(F.col("probability").between(0, 1)).count() == 50
    for bad in ({"bins": 256}, {"depth": 0}, {"leaf_rows": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_edges(spark):
    """All values of a feature with few, quantiles of others; the largest value ends no bin."""
    df = spark.range(10_000).select((F.col("id") % 7).alias("few"), (F.col("id") * 1.0).alias("many"), F.lit(3).alias("one"), F.lit(None).cast("double").alias("none"))
    few, many, one, none = boosting.edges_of(df, ["few", "many", "one", "none"], 50)
    assert few == [0, 1, 2, 3, 4, 5] and one == none == []
    assert len(many) == 49 and all(abs(e - 200 * (i + 1)) < 10 for i, e in enumerate(many))


def test_facts_are_kept_with_the_model(spark, tmp_path):
    import datetime as dt

    data = spark.createDataFrame([(i, dt.date(2020, 1, 1 + i // 2), float(i % 3 > 0), float(i % 3 > 0)) for i in range(40)], "bout_id int, event_date date, label double, x double")
    result = model.run_training(data, ["x"], iterations=2, depth=2)
    result.winner.save(str(tmp_path / "m"))
    back = model.Winner.load(str(tmp_path / "m"))
    assert back.features == ["x"] and back.facts["n_test"] == 8 and back.facts["metrics"]["model"]["accuracy"] == 1.0 and back.facts["metrics"]["baseline"]["roc_auc"] == 0.5
    again = model.run_training(data, ["x"], iterations=2, depth=2)
    assert (again.model, again.baseline, again.winner.booster) == (result.model, result.baseline, result.winner.booster)


def test_edges_do_not_depend_on_partitions(spark):
    """Quantiles are counted, not estimated: ties, close values, signs and infinite values give the same edges however rows lie."""
    r = random.Random(5)
    rows = [(r.choice([0.5, 0.5, 1 + r.random() * 1e-9, r.gauss(0, 1)]), r.choice([-0.0, 0.0, math.inf, -math.inf, float(r.randint(-90, 90)), None]), 7e9 + r.random()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    one, two = boosting.edges_of(df.repartition(7), ["a", "b", "c"], 16), boosting.edges_of(df.coalesce(1), ["a", "b", "c"], 16)
    assert one == two
    for i, edges in enumerate(one):
        values = sorted(x[i] for x in rows if x[i] is not None)
        want = {values[-(-len(values) * k // 16) - 1] for k in range(1, 16)} - {values[-1]}
        ranks = [sum(v <= e for v in values) for e in edges]
        assert len(edges) == len(want) and all(0 <= got - sum(v <= w for v in values) <= 2 for got, w in zip(ranks, sorted(want)))


def test_rows_of_a_level_are_read_in_blocks(spark, monkeypatch):
    """What a level reads is a row for each block of rows, not one for each row, and sums of pairs of bins are those of single ones."""
    seen = []
    monkeypatch.setattr(boosting, "histograms", lambda state, *a, f=boosting.histograms: seen.append(state.count()) or f(state, *a))
    boosting.fit(spark.createDataFrame(table(3, 3000), SCHEMA).coalesce(1), NAMES, options=Options(iterations=1, depth=2))
    assert set(seen) == {1}
    r = np.random.default_rng(1)
    bins, slot, w = r.integers(0, 65, (5, 20_000)).astype(np.uint8), r.integers(0, 3, 20_000), np.rint(r.normal(0, 1, 20_000) * UNIT)
    got = boosting._sums(bins, slot, 3, 65, [w, None])
    for f in range(5):
        for s in range(3):
            mine = slot == s
            assert (got[0, s, f] == np.bincount(bins[f][mine], w[mine], 65)).all() and (got[1, s, f] == np.bincount(bins[f][mine], minlength=65)).all()
