"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Training.  For each word and each beginning of a word (3 to 9 letters) the number of toxic and of clean labelled documents
that have it gives a log-odds ratio with an informative Dirichlet prior, the pooled corpus at ``PRIOR`` of its size; the documents of
the most frequent longer feature don't count for a beginning.  Features whose lower confidence bound is above ``LEAST`` score
that bound.  Those whose ratio is below ``CLEAN`` score their upper confidence bound, but no more than -DRIFT.  Of the others too little
is known.  A word scores as the longest of its features that has a score, any other word -DRIFT.
A third of the labelled documents is kept from this and used for calibration: clean tokens among them give lambda and K of the
distribution of the best segment, E(S) = K n exp(-lambda S), and a logistic curve turns a document's evidence into the
probability of its label.

Scoring.  The linear-time scan for all maximal scoring segments (Ruzzo and Tompa) runs over a text's words; every occurrence of
a word has its score, here and in the calibration.  A segment is a toxic passage if its expected number E in as many clean words
is below ``SIGNIFICANT``; the document's evidence is the sum of ln(1 / E) over its passages.

Null and empty texts have no passages and the score of a document without evidence.  With no toxic or no clean training rows
every document scores 0.0.  Rows and other columns stay; columns that the scan adds replace older ones of their names.  Training rows
are bounded by MOST_ROWS, and with them what is learned: a feature is in FEWEST of these texts at least.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import free_name, give_back, kept, materialize, small_batches, spread, with_struct
from ringside.llm.labels import training_rows

#: Labelled rows that are learned from, about; more are sampled by hash of id.
MOST_ROWS = 40_000
#: Fewer toxic documents don't make a feature.
FEWEST = 3
PRIOR, LEAST, CLEAN, DRIFT, CONFIDENCE = 0.05, 0.5, 1.0, 0.25, 1.96
SIGNIFICANT = 0.05
#: Evidence is counted in steps for the logistic curve; beyond MOST_EVIDENCE more makes no difference to it.
STEPS, MOST_EVIDENCE = 32, 4096.0
BEGINNINGS = range(3, 10)
MEMO = 150_000

_words = re.compile(r"\w+").findall


def features(word: str) -> list[str]:
    """A word and its beginnings, which end in a star, from the longest to the shortest."""
    return [word, *[word[:n] + "*" for n in reversed(BEGINNINGS) if len(word) > n]]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 0.0  # of clean words with a score above 0
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -math.inf

    def evidence(self, segments: list[float], n: int) -> float:
        found = [self.lam * s - self.log_k - math.log(n) for s in segments]
        return sum(x for x in found if x > -math.log(SIGNIFICANT))

    def probability(self, evidence: float) -> float:
        z = self.slope * evidence + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Scanner(dict):
    """Scores of words, kept as they are first asked for; scans texts."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = next((s for f in features(word) if (s := self.scores.get(f)) is not None), -DRIFT)
        return found

    def values(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, score) of all maximal scoring segments, in order."""
        return self.segments_of(self.values(words))

    def segments_of(self, values: np.ndarray) -> list[tuple[int, int, float]]:
        # first, after, sum before, sum after, the nearest one below it with a smaller sum before
        stack: list[tuple[int, int, float, float, int]] = []
        sums, at = np.cumsum(values), np.flatnonzero(values > 0)
        for i, low, total in zip(at.tolist(), (sums - values)[at].tolist(), sums[at].tolist(), strict=True):
            first, before = i, i + 1
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= low:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= total:
                    stack.append((first, before, low, total, j))
                    break
                first, _, low, _, below = stack[j]
                del stack[j:]
                j = below
        return [(a, b, high - low) for a, b, low, high, _ in stack]


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): labelled documents that have a feature, of those in FEWEST toxic ones at least; equal toxic texts count once.

    The feature '' counts documents.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, part in batch.groupby("y"):
                found: Counter = Counter()
                for text in part["text"]:
                    found.update({f for w in set(_words(text.lower())) for f in features(w)})
                    found[""] += 1
                yield pd.DataFrame({"feature": list(found), "y": int(y), "n": list(found.values())})
        give_back()

    counted = lambda r: r.mapInPandas(count, "feature string, y int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = counted(rows.filter("y = 1").dropDuplicates(["text"])).filter((F.col("n") >= FEWEST) | (F.col("feature") == "")).withColumnRenamed("n", "toxic")
    clean = counted(rows.filter("y = 0")).withColumnRenamed("n", "clean")
    return toxic.join(clean, "feature", "left").select("feature", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> tuple[float, float]:
    """The log-odds ratio of a feature with the pooled prior, and its standard error."""
    prior = PRIOR * (all_toxic + all_clean)
    a = max(prior * (toxic + clean) / (all_toxic + all_clean), 1e-9)
    odds = lambda n, total: math.log((n + a) / max(total + prior - n - a, 1e-9))  # noqa: E731  a feature may be in all documents
    ratio = odds(toxic, all_toxic) - odds(clean, all_clean)
    return ratio, math.sqrt(1 / (toxic + a) + 1 / (clean + a))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int | None = 3, held_out: int | None = 1, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled documents outside the held-out fold (all, if folds is None)."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, folds, held_out, most_rows, id_col, text_col)
    third = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(3)) == 0
    learn, calibrate = rows.filter(~third).select("text", "y"), rows.filter(third).select("text", "y")
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in _counts(learn).collect()}  # of MOST_ROWS texts
    n_toxic, n_clean = counts.pop("", (0, 0))
    if not counts or not n_clean:
        return Model()
    longer: dict[str, int] = {}
    for f, (n, _) in counts.items():
        for parent in features(f.removesuffix("*"))[1:2]:
            longer[parent] = max(n, longer.get(parent, 0))
    scores: dict[str, float] = {}
    for f in sorted(counts, key=lambda f: (len(f.removesuffix("*")), not f.endswith("*"))):  # shorter ones first
        n, clean = counts[f]
        ratio, error = log_odds(n - longer.get(f, 0), clean, n_toxic, n_clean)
        bound = ratio - CONFIDENCE * error
        if bound > LEAST:
            own = bound
        elif ratio < CLEAN:
            own = min(-DRIFT, ratio + CONFIDENCE * error)
        else:  # too little is known of it, and a shorter beginning decides
            continue
        word = f.removesuffix("*")
        shorter = [word[:k] + "*" for k in reversed(BEGINNINGS) if k < len(word)]
        if own != next((x for g in shorter if (x := scores.get(g)) is not None), -DRIFT):  # else it says nothing that isn't said
            scores[f] = own
    model = Model(scores)
    _calibrate(model, calibrate)
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """lambda, K and the logistic curve, from at most a third of MOST_ROWS documents.

    The driver gets how often each score comes up among clean words, and how many documents of each label have an evidence, in steps.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model.scores)  # of a bounded sample

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shipped.value)
        for batch in batches:
            out, seen = [], Counter()
            for text, y in zip(batch["text"], batch["y"], strict=True):
                values = scanner.values(_words(text.lower()))
                if not y:
                    seen.update(dict(zip(*(a.tolist() for a in np.unique(values, return_counts=True)))))
                out.append((int(y), len(values), [s for *_, s in scanner.segments_of(values)], [], []))
            if out:
                out.append((None, 0, [], list(seen), list(seen.values())))  # of the batch's clean words
            yield pd.DataFrame(out, columns=["y", "n", "segments", "values", "times"])
        give_back()

    scanned = materialize(rows.mapInPandas(scan, "y int, n long, segments array<double>, values array<double>, times array<long>"), "calibration")
    counts = sorted(scanned.filter("y is null").select(F.explode(F.arrays_zip("values", "times")).alias("c")).groupBy("c.values").agg(F.sum("c.times").alias("k")).collect())
    up = sorted(s for s in model.scores.values() if s > 0)
    counts.append((up[len(up) // 2] if up else 1.0, 1))  # a clean word as toxic as that may always come up
    s, k = np.array([c[0] for c in counts]), np.array([c[1] for c in counts], float)
    rate = k[s > 0].sum() / k.sum()
    low, high = 1e-6, 50.0
    for _ in range(100):  # sum of p exp(lambda s) = 1 has one root above 0, as scores are negative on average
        mid = (low + high) / 2
        if float((k * np.minimum(np.exp(np.minimum(mid * s, 600)), 1e250)).sum()) / k.sum() > 1:
            high = mid
        else:
            low = mid
    model.rate, model.lam = float(rate), low
    model.log_k = math.log(rate) + low * float(s[s > 0].min())
    each = lambda x: F.lit(model.lam) * x - F.lit(model.log_k) - F.log(F.col("n").cast("double"))  # noqa: E731  as in Model.evidence
    evidence = F.aggregate("segments", F.lit(0.0), lambda total, x: total + F.when(each(x) > -math.log(SIGNIFICANT), each(x)).otherwise(0.0))
    steps = scanned.filter("n > 0").select("y", F.round(F.least(evidence, F.lit(MOST_EVIDENCE)) * STEPS).alias("x")).groupBy("y", "x").agg(F.count(F.lit(1)).alias("k"))
    found = sorted(tuple(r) for r in steps.collect())  # at most 2 * STEPS * MOST_EVIDENCE rows
    y, x, k = (np.array([r[i] for r in found], float) for i in range(3))
    if not (k * y).sum() or (y * k).sum() == k.sum():
        return
    model.slope, model.intercept = logistic(x / STEPS, y, k)


def logistic(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over points that stand k times each, with targets a little inside 0 and 1 and a weak pull of the
    slope to 0."""
    up, down = (k * y).sum(), (k * (1 - y)).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    order = np.flatnonzero(y > 0)[np.argsort(x[y > 0])]
    middle = x[order][np.searchsorted(np.cumsum(k[order]), up / 2)]
    scale = max(float(middle), 1e-3)
    z, w = np.minimum(x / scale, 3.0), np.zeros(2)
    a = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (k * (p - t)) + np.array([1e-3 * w[0], 0])
        h = (a * (k * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return float(w[0] / scale), float(w[1])


RESULT = "score double, n_passages int, passages array<struct<start:int,end:int,score:double,expected:double>>"


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, n_passages and passages: character offsets, segment score and expected number of each toxic passage."""
    struct = free_name("__toxic", docs)
    return spread(with_scan(docs, model, text_col, struct), struct)


def with_scan(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__toxic") -> DataFrame:
    """``docs`` with what scan() finds in one struct column ``out``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # scores learned from a bounded sample

    def make():
        model = shipped.value
        scanner = kept(("scores", id(model.scores)), lambda: Scanner(model.scores))  # which holds them, so no other has that id

        def one(text):
            low = text.lower() if text else ""
            words = _words(low)
            found = []
            for a, b, s in scanner.segments(words):
                e = math.exp(min(model.log_k + math.log(len(words)) - model.lam * s, 700))
                if e < SIGNIFICANT:
                    found.append((a, b, s, e))
            score = model.probability(model.evidence([s for *_, s, _ in found], len(words)) if found else 0.0)
            if not found:
                return score, 0, []
            spans = [m.span() for m in re.finditer(r"\w+", text)]
            if len(spans) != len(words):  # lower case changed a word's extent
                spans = [m.span() for m in re.finditer(r"\w+", low)]
            return score, len(found), [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "expected": e} for a, b, s, e in found]

        def run(texts):
            rows = [one(t) for t in texts]
            return {"score": [r[0] for r in rows], "n_passages": [r[1] for r in rows], "passages": [r[2] for r in rows]}

        return run

    return with_struct(docs, text_col, out, RESULT, make)
