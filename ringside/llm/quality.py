"""Quality classifier: a sparse ensemble of rules over document statistics.

A forest of shallow trees is grown on the statistics of labelled documents; every path from a root to a node is a conjunctive
rule.  A logistic model with an L1 penalty over the rules keeps the few that matter, and these are compiled into one Spark
column expression over the statistics: scoring needs no model object.

Null and empty texts have statistics of 0 and are scored like any other.  Without training rows, or with one label only, every
document scores the share of label 1 (1.0 without any).  Rows and other columns stay; the score replaces an older column of its
name.  Training rows are bounded by MOST_ROWS.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import free_name, materialize, with_struct
from ringside.llm.labels import training_rows

#: Labelled rows that are learned from, about; more are sampled by hash of id.
MOST_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.002, 7
#: Partitions of the training rows.
PARTS = 8

#: Names of the statistics.
STATISTICS = [
    "n_words",
    "word_length",  # characters of a word on average
    "longest_word",
    "short_words",  # share of words of up to three characters
    "distinct_words",  # over words
    "top_word",  # share of the most frequent word
    "repeated_words",  # share of words equal to the one before
    "sign_words",  # share of words that end in a sign other than a full stop or comma
    "lines",
    "line_words",  # words of a line on average
    "distinct_lines",  # over lines
    "upper",  # share of capitals among ASCII letters
    "digits",  # share among bytes
    "stops",  # full stops and commas, share among bytes
    "signs",  # other ASCII signs, share among bytes
    "high",  # bytes beyond ASCII, share
    "entropy",  # bits of a byte
]

_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = 1
_CLASS[97:123, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[[44, 46], 3] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (44, 46)], 4] = 1
_CLASS[128:, 5] = 1


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS."""
    words = text.split() if text else []
    if not words:
        return (0.0,) * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower, digits, stops, signs, high = (counts @ _CLASS).tolist()
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / size
    ends = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    return (
        float(n),
        float(lengths.mean()),
        float(lengths.max()),
        float((lengths <= 3).mean()),
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        sum(map(eq, words, words[1:])) / n,
        ends / n,
        float(len(lines)),
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        upper / max(1.0, upper + lower),
        digits / size,
        stops / size,
        signs / size,
        high / size,
        float(-(p * np.log2(p)).sum()),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "__statistics") -> DataFrame:
    """``docs`` with the struct column ``out`` of all statistics."""

    def run(texts):
        return dict(zip(STATISTICS, zip(*map(statistics, texts), strict=True), strict=True)) if texts else {s: [] for s in STATISTICS}

    return with_struct(docs, text_col, out, ", ".join(f"{s} double" for s in STATISTICS), lambda: run)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at most, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, struct: Column) -> Column:
        out = F.lit(True)
        for name, at_most, t in self.terms:
            out = out & (struct[name] <= t if at_most else struct[name] > t)
        return out

    def tightened(self, name: str, at_most: bool, t: float) -> Rule:
        """With one more term; of two terms on the same side of a statistic the tighter one stays."""
        rest = [x for x in self.terms if x[:2] != (name, at_most)]
        bounds = [x[2] for x in self.terms if x[:2] == (name, at_most)] + [t]
        return Rule(tuple(sorted([*rest, (name, at_most, min(bounds) if at_most else max(bounds))])))


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self, struct: Column) -> Column:
        """The probability of label 1 as an expression over the struct of statistics."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(struct), float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(tree) -> list[Rule]:
    """The rules of all nodes below the root of one fitted tree."""
    found: list[Rule] = []

    def walk(node, rule: Rule):
        if rule.terms:
            found.append(rule)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, t = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), rule.tightened(name, True, t))
            walk(node.rightChild(), rule.tightened(name, False, t))

    walk(tree._java_obj.rootNode(), Rule(()))
    return found


def lasso(hits: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 3000, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights of the columns of ``hits`` (0 or 1) and the intercept that minimise the mean log loss plus ``penalty`` times the
    sum of the absolute weights, each weight times its column's deviation; by accelerated proximal gradient steps."""
    rows, count = np.unique(np.column_stack([y, hits]).astype(np.uint8), axis=0, return_counts=True)
    y, share = rows[:, 0].astype(float), count / count.sum()
    x = rows[:, 1:].astype(float)
    mean = share @ x
    deviation = np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0))
    use = np.flatnonzero(deviation > 1e-9)
    x = (x[:, use] - mean[use]) / deviation[use]
    w, b = np.zeros(len(use)), math.log(max(share @ y, 1e-9) / max(1 - share @ y, 1e-9))
    rate = 4 / max(1.0, np.linalg.eigvalsh((x * share[:, None]).T @ x)[-1] if len(use) else 1.0)
    ahead, ahead_b, momentum = w, b, 1.0
    for _ in range(steps):
        miss = share * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_b, -500, 500))) - y)
        moved = ahead - rate * (x.T @ miss)
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0), ahead_b - rate * miss.sum()
        follow = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        if (ahead - new) @ (new - w) + (ahead_b - new_b) * (new_b - b) > 0:
            follow = 1.0  # the momentum points uphill
        ahead, ahead_b = new + (momentum - 1) / follow * (new - w) if follow > 1 else new, new_b + (momentum - 1) / follow * (new_b - b) if follow > 1 else new_b
        change = max(np.abs(new - w).max(initial=0), abs(new_b - b))
        w, b, momentum = new, new_b, follow
        if change < tolerance:
            break
    out = np.zeros(hits.shape[1])
    out[use] = w / deviation[use]
    return out, float(b - out @ mean)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int | None = 4, held_out: int | None = 2, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled documents outside the held-out fold (all, if folds is None).

    The statistics are computed where the texts are read; the few numbers of each training row are then put together.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = training_rows(docs, labels, label, folds, held_out, most_rows, id_col, text_col)
    rows = with_statistics(rows).select("doc_id", F.col("y").cast("double").alias("label"), "__statistics")
    rows = materialize(rows.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "__statistics"), "training")  # about MOST_ROWS short rows
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Model([], math.inf if 0.0 not in seen else -math.inf)
    s = F.col("__statistics")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, seed=SEED, maxBins=64)
    trees = forest.fit(rows.select("label", array_to_vector(F.array(*[s[n] for n in STATISTICS])).alias("features"))).trees
    rules = sorted({r for t in trees for r in tree_rules(t)}, key=lambda r: (len(r.terms), r.terms))
    if not rules:
        return Model([], math.log(seen[1.0] / seen[0.0]))
    hits = F.concat(*[F.when(r.column(s), "1").otherwise("0") for r in rules])
    found = rows.select("label", hits.alias("hits")).groupBy("label", "hits").agg(F.count(F.lit(1)).alias("n")).collect()  # at most about MOST_ROWS
    bits = np.frombuffer("".join(r["hits"] for r in found).encode(), np.uint8).reshape(len(found), len(rules)) - 48
    _, first = np.unique(bits, axis=1, return_index=True)  # of rules that hold for the same rows, the shortest
    bits, rules, times = bits[:, np.sort(first)], [rules[i] for i in np.sort(first)], [r["n"] for r in found]
    weights, intercept = lasso(np.repeat(bits, times, axis=0), np.repeat([r["label"] for r in found], times))
    return Model([(r, w) for r, w in zip(rules, weights.tolist(), strict=True) if w], intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    struct = free_name("__statistics", docs)
    return with_statistics(docs, text_col, struct).withColumn(out, model.column(F.col(struct))).drop(struct)
