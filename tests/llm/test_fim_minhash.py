"""Fill-in-the-middle and MinHash near duplicates against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import fim, jaccard, minhash
from tests.llm.test_jaccard import brute, corpus

DOC = "doc_id long, text string"


def by_units(doc_id, text, seed="1"):
    """(n, form, prefix_chars, middle_chars, output) by a list of all units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(5)
    out = [None, "", "a", "7", "<P>", "x<S>y", "almost <P <S", "<", "<S<P", "Ünïcode 日本語 𝒳𝒴 é", "@[`{AZaz", "\x00\n\r\t", "word " * 90_000, "z" * 300_000, "12345" * 60_000]
    for _ in range(300):
        out.append("".join(r.choice(["abc", "Z", " ", "\n", "é", "日", "𝒳", "5", ".", "<", ">", "P", "S", "M", "q" * 9]) for _ in range(r.randint(0, 60))))
    return out


def test_runs_equal_lists_of_units():
    some = [t or "" for t in texts()]
    runs = fim.Runs(some)
    for share in (0, 0.3, 0.5, 1):
        cut = (runs.n * share).astype(np.int64)
        got = runs.chars_before(cut)
        for t, n, c, g in zip(some, runs.n, cut, got, strict=True):
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
            assert n == len(units) and g == sum(map(len, units[:c]))
    assert len(fim.Runs([]).n) == 0 and fim.Runs(["", ""]).chars_before(np.zeros(2, np.int64)).tolist() == [0, 0]


def test_fim(spark):
    rows = [(i * 7, t) for i, t in enumerate(texts())] + [(None, "a text without an id"), (None, None), (7, "a second one with this id"), (7, "a second one with this id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOC + ", form string, __cuts int").repartition(3)
    got = fim.transform(df)
    assert got.columns == ["doc_id", "text", "__cuts", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(found) == len(rows) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_units(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((d, sha(by_units(d, t)[4]), sha(t or "")) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fim.digests(df).collect()), key=str) == want
    assert fim.digests(df.limit(0)).count() == 0


def test_bins_are_densified_alike():
    """Bins of two sets agree as often as the sets are similar, also where most bins are empty."""
    r = np.random.default_rng(3)
    sketcher = minhash.Sketcher()
    for size, shared in ((5, 4), (40, 32), (400, 320), (2, 1), (3000, 1000)):
        agree = []
        for _ in range(60):
            h = r.integers(-(1 << 63), 1 << 63, 2 * size - shared, np.int64)
            agree.append((sketcher.values(h[:size]) == sketcher.values(h[size - shared :])).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.06
    one = np.array([5], np.int64)
    assert (sketcher.values(one) == np.uint64(5)).all() and sketcher.band_hashes(one[:0]) == [] and len(set(sketcher.band_hashes(one))) == minhash.BANDS


@pytest.mark.parametrize("words,num", [(4, 80), (1, 85)])
def test_near_duplicates_equal_brute_force(spark, words, num):
    rows = corpus(words + 20) + [(5000 + i, " ".join(f"u{j}" for j in range(i % 7, i % 7 + 3000))) for i in range(9)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, bands int").repartition(3)
    got = minhash.near_duplicates(df, words, (num, 100)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, words, num, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_bucket_is_searched_to_the_end(spark, monkeypatch):
    """All sets in one bucket: hubs that connect nothing leave, and what is linked beside them is found."""
    monkeypatch.setattr(minhash.Sketcher, "band_hashes", lambda self, h: [1] if len(h) else [])
    rows = corpus(31)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), 4, (80, 100)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 4, 80, 100)


def test_edges_are_stars(spark, monkeypatch):
    """A group of n near copies is verified by a number of pairs in proportion to n."""
    counted = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, t: counted.append(pairs.count()) or verified(pairs, sets, t))
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(200)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), 4, (80, 100)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sum(counted) < 40 * len(rows)


def test_joined_partitions_run_no_python(spark, monkeypatch):
    """A task that takes many partitions keeps a page for each in which a Python function runs: such tables are written partition by partition."""
    joined, seen = [], []
    for module in (jaccard, minhash):

        def write(df, name, rows=None, own=module.materialize):
            seen.append(name)
            if rows is not None and "EvalPython" in df._jdf.queryExecution().optimizedPlan().toString():
                joined.append(name)
            return own(df, name, rows)

        monkeypatch.setattr(module, "materialize", write)
    monkeypatch.setattr(minhash.Sketcher, "band_hashes", lambda self, h: [1] if len(h) else [])
    rows = corpus(31)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), 4, (80, 100)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 4, 80, 100)
    assert "references" in seen and "labelled" in seen and not joined


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], DOC)
    assert minhash.near_duplicates(none).count() == 0
    blank = spark.createDataFrame([(4, None), (5, ""), (6, " "), (None, None)], DOC)
    assert {tuple(r) for r in minhash.near_duplicates(blank).collect()} == {(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, True)}
