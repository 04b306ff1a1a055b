"""The size-aware Jaccard join against a brute-force version."""

import random
import re

import pytest

from ringside.llm import jaccard


def brute(rows, words, num, den):
    return sorted(brute_rows(rows, words, num, den), key=str)


def brute_rows(rows, words, num, den):
    """(id, size of the set, smallest id of the component) of each row."""
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "A", "a", "x\x1cy", "n\xa0b"]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = [None, "", " \n\t", "one", "One", "two words", "a b c d", "A B  C\nD"]
    for _ in range(14):
        base = [r.choice(vocab) for _ in range(r.choice([4, 8, 14, 16, 17, 18, 22, 26, 60, 200]))]
        if r.random() < 0.3:
            base[3:3] = passage
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 9)):
            ws = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(ws))
                what = r.random()
                if what < 0.4:
                    ws[k] = r.choice(vocab)
                elif what < 0.7:
                    ws = ws[: max(1, len(ws) - r.randint(1, 4))]
                else:
                    ws.append(r.choice(vocab))
            texts.append(" ".join(ws))
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 3)]  # each is like its neighbours only
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return rows + rows[9:12] + [(None, texts[9]), (None, "a text without an id that is alone here")]


@pytest.mark.parametrize("words,num,den,pivots,most", [(4, 85, 100, 8, 24), (5, 80, 100, 1, 24), (1, 80, 100, 2, 24), (4, 85, 100, 1, 1), (1, 1, 10, 8, 24), (1, 1, 10, 2, 1), (2, 40, 100, 2, 24)])
def test_components_equal_brute_force(spark, monkeypatch, words, num, den, pivots, most):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    if most == 1:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, t: 1)
    rows = corpus(words + pivots)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, v int").repartition(3)
    got = jaccard.link_components(df, words, (num, den)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words, num, den)


@pytest.mark.parametrize("words,num,den,most", [(4, 85, 100, 24), (1, 80, 100, 24), (5, 80, 100, 1)])
def test_links_equal_brute_force(spark, monkeypatch, words, num, den, most):
    """Every pair, also of sets that other links connect."""
    if most == 1:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, t: 1)
    rows = [(i, text) for i, (_, text) in enumerate(corpus(words + 7))]
    members, pairs = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, (num, den))
    of = {r["doc_id"]: r["set_id"] for r in members.collect()}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(of) == len(rows) and len(found) == len(set(found)) and all(a < b for a, b in found)
    linked, want = set(found), set()
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set()))
    for i, a in enumerate(sets):
        assert (of[i] is None) == (not a)
        for j, b in enumerate(sets[:i]):
            if a and b:
                assert (of[i] == of[j]) == (a == b)
                if a != b and den * len(a & b) >= num * len(a | b):
                    want.add((min(of[i], of[j]), max(of[i], of[j])))
    assert linked == want and want


def test_low_threshold_keeps_links(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a"), (3, "z a y x"), (4, "q")]
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, (1, 10))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert all(t.probe_shared(n) <= t.overlap(n, m) for t in (jaccard.Threshold(1, 10), jaccard.Threshold(1, 2), jaccard.Threshold(85, 100)) for n in range(1, 60) for m in range(t.least(n), t.den * n // t.num + 1))


def test_representatives(spark):
    """One row of each component, whether ids are null or repeated; every column stays."""
    rows = [(i, text, i) for i, (_, text) in enumerate(corpus(3))]
    rows += [(None, rows[9][1], -1), (None, "a null id that stands alone here", -2), (None, "a null id that stands alone here", -3), (5, rows[5][1], -4), (5, "another text with id five", -5), (None, None, -6), (None, "", -7)]
    df = spark.createDataFrame([(d, t, n, "x") for d, t, n in rows], "doc_id long, text string, n int, __row1 string").repartition(3)
    kept = jaccard.representatives(df, 5, (80, 100))
    assert kept.columns == df.columns
    kept = kept.collect()
    groups = {}
    for i, (_, size, low) in enumerate(brute_rows([(n, t) for _, t, n in rows], 5, 80, 100)):
        groups.setdefault(("empty", i) if not size else low, []).append(rows[i])
    assert len(kept) == len(groups)
    at = {r["n"] for r in kept}
    for members in groups.values():
        chosen = [m for m in members if m[2] in at]
        ids = [m[0] for m in members if m[0] is not None]
        assert len(chosen) == 1 and chosen[0][0] == (min(ids) if ids else None)


def test_boundary_follows_cost():
    t = jaccard.Threshold(85, 100)
    assert jaccard.boundary({13: 1000}, t) > 13
    assert jaccard.boundary({23: 1000, 22: 1000}, t) <= 22


def test_every_overlap_has_a_subset_size():
    t = jaccard.Threshold(85, 100)
    for n in range(1, 20):
        for m in range(n, 20):
            if 100 * n >= 85 * m:
                s = t.overlap(n, m)
                assert s in t.subset_sizes(n, 20) and s in t.subset_sizes(m, 20)
                assert 100 * s >= 85 * (n + m - s) and 100 * (s - 1) < 85 * (n + m - s + 1)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in list(root) if find(v) != v}
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["v"]: r["root"] for r in got.collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(none).count() == 0
    blank = spark.createDataFrame([(4, None), (5, ""), (6, " ")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.link_components(blank).collect()} == {(4, 0, 4), (5, 0, 5), (6, 0, 6)}
