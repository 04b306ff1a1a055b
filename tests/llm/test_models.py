"""Toxicity and quality: brute-force parts and held-out accuracy on small made-up corpora."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import quality, toxicity


def maximal_segments(values):
    """All maximal scoring segments by their definition: the best segment, and again left and right of it."""
    if not values:
        return []
    best = max(((sum(values[i:j]), i - j, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return maximal_segments(values[:i]) + [(i, j)] + [(a + j, b + j) for a, b in maximal_segments(values[j:])]


def test_segments_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        scores = {f"t{i}": round(r.uniform(0.1, 2.0), 3) for i in range(40)}
        scanner = toxicity.Scanner(scores)
        words = [f"t{i}" if r.random() < 0.3 else f"c{i}" for i in r.sample(range(40), 30)]
        values = [scores.get(w, -toxicity.DRIFT) for w in words]
        got = scanner.segments(words)
        assert [(a, b) for a, b, _ in got] == maximal_segments(values)
        assert all(math.isclose(s, sum(values[a:b]), abs_tol=1e-9) for a, b, s in got)


def test_segments_with_repeated_words_equal_brute_force():
    r = random.Random(5)
    for _ in range(300):
        scores = {f"t{i}": r.uniform(0.1, 2.0) for i in range(4)}
        scanner = toxicity.Scanner(scores)
        words = [f"t{r.randrange(4)}" if r.random() < 0.3 else f"c{r.randrange(4)}" for _ in range(30)]
        values = [scores.get(w, -toxicity.DRIFT) for w in words]
        got = scanner.segments(words)
        assert [(a, b) for a, b, _ in got] == maximal_segments(values)
        assert all(math.isclose(s, sum(values[a:b]), abs_tol=1e-9) for a, b, s in got)


def test_passages_of_words_seen_before(spark):
    """A passage of one repeated word, and a second one of the same words after early single uses."""
    model = toxicity.Model({"grumbo": 2.0, "snarkel": 2.0}, lam=1.0, log_k=0.0, slope=1.0)
    clean = " plain" * 100
    texts = ["grumbo" + " grumbo" * 5, "grumbo" + clean + " snarkel" + clean + " grumbo snarkel" * 4, "grumbo snarkel" + " grumbo snarkel" * 3 + clean + " grumbo snarkel" * 4]
    got = toxicity.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert [r["n_passages"] for r in got] == [1, 1, 2]
    assert got[0]["passages"][0]["score"] == 12.0 and got[0]["passages"][0]["end"] == len(texts[0])
    assert texts[1][got[1]["passages"][0]["start"] :] == "grumbo snarkel" + " grumbo snarkel" * 3


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        toxic, bad = int(r.random() < 0.2), int(r.random() < 0.25)
        if bad:
            words = [r.choice(words).upper() + "!!" for _ in words]
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["grumbo", "snarkel", "vextor", "vexting", "vexalle"]) for _ in range(r.randint(3, 6))]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1 - bad, toxic))
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, " ", "a"), (None, rows[0][1], "a"), (0, rows[0][1], "a")]
    labels += [(2000, 1, 0), (2001, 1, 1), (5000, 1, 1), (0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, folds, held_out):
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    rows = [(r["score"], truth[r["doc_id"]]) for r in scored.collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % folds == held_out and truth[r["doc_id"]] is not None]
    assert len(rows) > 100
    return sum((s >= 0.7) == y for s, y in rows) / len(rows)


def test_toxicity(corpus, spark):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    scored = toxicity.scan(docs, model).cache()
    assert scored.count() == docs.count() and "text" in scored.columns
    assert accuracy(scored, labels, "toxic", 3, 1) > 0.95
    for r in scored.filter("n_passages > 0").collect():
        for p in r["passages"]:
            assert any(w in r["text"][p["start"] : p["end"]] for w in ("grumbo", "snarkel", "vex"))
    assert scored.filter("text is null or trim(text) = ''").agg(F.max("score"), F.max("n_passages")).first()[1] == 0
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scan(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scan(docs.limit(5), empty).agg(F.max("score")).first()[0] == 0.0


def test_quality(corpus, spark):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == docs.count()
    assert accuracy(scored, labels, "quality", 4, 2) > 0.95
    assert 0 < len(model.rules) < 60
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).agg(F.min("score")).first()[0] == 1.0
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_equal_brute_force(corpus, spark):
    """Every document's passages by their definition, its evidence and its probability."""
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    got = toxicity.scan(docs, model).collect()
    checked = 0
    for r in got:
        words = toxicity._words((r["text"] or "").lower())
        values = [next((model.scores[f] for f in toxicity.features(w) if f in model.scores), -toxicity.DRIFT) for w in words]
        expected = [(sum(values[a:b]), math.exp(model.log_k + math.log(len(words)) - model.lam * sum(values[a:b]))) for a, b in maximal_segments(values)] if len(words) < 60 or r["n_passages"] else []
        passages = [(s, e) for s, e in expected if e < toxicity.SIGNIFICANT]
        if len(words) < 60 or r["n_passages"]:
            checked += 1
            assert r["n_passages"] == len(passages)
            assert all(math.isclose(p["score"], s, abs_tol=1e-9) for p, (s, _) in zip(r["passages"], passages))
            assert math.isclose(r["score"], model.probability(sum(-math.log(e) for _, e in passages)), rel_tol=1e-6, abs_tol=1e-12)
    assert checked > 200


def test_very_long_and_repeated_texts(corpus, spark):
    docs, labels = corpus
    long = " ".join(["plain words of no kind"] * 60_000)
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, long + " grumbo snarkel vextor grumbo", "a")], "doc_id long, text string, __toxic string")
    rows = toxicity.scan(df, toxicity.fit(docs, labels)).collect()
    assert rows[0] == rows[1] and rows[2]["n_passages"] == 1 and rows[0]["__toxic"] == "a"
    scores = quality.score(df.withColumnRenamed("__toxic", "__statistics"), quality.fit(docs, labels)).collect()
    assert scores[0] == scores[1] and scores[0]["__statistics"] == "a"


def test_rules_equal_brute_force(corpus, spark):
    """The paths of trees against the trees' own nodes, and the expression against the rules in Python."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    docs, labels = corpus
    rows = quality.with_statistics(docs.filter("doc_id < 900").dropDuplicates(["doc_id"]).join(labels.filter("quality is not null"), "doc_id"), out="s")
    data = rows.select(F.col("quality").cast("double").alias("label"), array_to_vector(F.array(*[F.col("s")[n] for n in quality.STATISTICS])).alias("features"))
    tree = DecisionTreeClassifier(maxDepth=3, seed=1).fit(data)
    rules = quality.tree_rules(tree)
    # By the text that the library prints: the conditions above each "Predict".
    leaves, above = [], []
    for line in tree.toDebugString.splitlines()[1:]:
        depth, line = len(line) - len(line.lstrip()) - 2, line.strip()
        if line.startswith("Predict"):
            leaves.append([c for d, c in above if d < depth])
            continue
        words = line.replace("(", " ").replace(")", " ").split()  # If feature 3 <= 0.5, Else feature 3 > 0.5
        above = [(d, c) for d, c in above if d < depth] + [(depth, (quality.STATISTICS[int(words[2])], words[3] == "<=", float(words[4])))]
    want = set()
    for leaf in leaves:
        for i in range(1, len(leaf) + 1):
            bounds = {}
            for name, low, t in leaf[:i]:
                bounds[name, low] = min(t, bounds.get((name, low), t)) if low else max(t, bounds.get((name, low), t))
            want.add(tuple(sorted((n, low, t) for (n, low), t in bounds.items())))
    assert {r.terms for r in rules} == want and want

    model = quality.fit(docs, labels)
    for r in quality.score(quality.with_statistics(docs, out="s"), model).collect():
        s = dict(zip(quality.STATISTICS, quality.statistics(r["text"])))
        assert all(r["s"][n] == v for n, v in s.items())
        z = model.intercept + sum(w for rule, w in model.rules if all(s[n] <= t if low else s[n] > t for n, low, t in rule.terms))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_lasso_equals_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(4)
    x = (r.random((600, 12)) < r.random(12)).astype(float)
    x[:, 11], x[:, 10] = x[:, 0], 1.0
    y = (r.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] + x[:, 2] - 0.5)))).astype(float)
    for penalty in (0.002, 0.02, 0.5):
        w, b = quality.lasso(x, y, penalty)
        deviation = x.std(axis=0)

        def loss(w, b):
            z = x @ w + b
            return np.mean(np.logaddexp(0, z) - y * z) + penalty * np.abs(w * deviation).sum()

        fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=500, tol=1e-10).fit(spark.createDataFrame([(t, Vectors.dense(v)) for t, v in zip(y.tolist(), x.tolist())], ["label", "features"]))
        assert loss(w, b) <= loss(fitted.coefficients.toArray(), fitted.intercept) + 1e-6
    assert not np.any(quality.lasso(x, y, 0.5)[0])


def test_statistics():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == (0.0,) * len(quality.STATISTICS)
    s = dict(zip(quality.STATISTICS, quality.statistics("Ab ab ab, x!\n\nAb ab ab, x!"), strict=True))
    assert (s["n_words"], s["lines"], s["distinct_lines"], s["longest_word"]) == (8, 2, 0.5, 3)
    assert s["sign_words"] == 0.25 and s["upper"] == 2 / 14 and s["distinct_words"] == 0.5


def test_labels_of_the_held_out_fold_are_not_read(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert a.rules == b.rules and a.intercept == b.intercept


def test_log_odds_of_features_in_all_or_no_documents():
    assert abs(toxicity.log_odds(10, 20, 10, 20)[0]) < 1
    assert toxicity.log_odds(5, 0, 10, 20)[0] > 2 and toxicity.log_odds(0, 5, 10, 20)[0] < 0
    assert all(map(math.isfinite, toxicity.log_odds(0, 0, 10, 20)))
