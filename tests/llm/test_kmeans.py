"""Yinyang k-means against a plain one over Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from ringside.llm import kmeans

ROW = "vec_id long, embedding array<float>, cluster string, x int"


def plain(rows, k, rounds, dim, scale=256, seed="2"):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha) by all distances in every round."""
    kept = [(i, [max(-kmeans.LIMIT, min(kmeans.LIMIT, math.floor(scale * float(e)))) for e in v]) for i, v in rows if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centre = [list(x) for _, x in order[:k]]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for i in range(rounds + 1):
        at = [min(range(len(centre)), key=lambda c: (distance(x, centre[c]), c)) for _, x in kept]
        if i == rounds:
            break
        for c in range(len(centre)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == c]
            if own:
                centre[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    far = [distance(x, centre[a]) for (_, x), a in zip(kept, at, strict=True)]
    per = [sum(d for d, a in zip(far, at, strict=True) if a == c) for c in range(len(centre))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, a, d, per[a], sum(per), sha[a]) for (i, _), a, d in zip(kept, at, far, strict=True)), key=str)


def vectors(seed, n, dim, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(7, dim))
    out = [(i, (middle[i % 7] + spread * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    return out + [(n, [0.0] * dim), (n + 1, [0.0] * dim), (n + 1, [0.0] * dim), (None, out[3][1])]  # ties and repeated rows


@pytest.mark.parametrize("n,dim,k,spread", [(300, 8, 12, 0.5), (200, 2, 40, 0.01), (150, 3, 23, 2.0), (30, 4, 40, 0.3)])
def test_equals_plain_kmeans(spark, n, dim, k, spread):
    rows = vectors(n, n, dim, spread)
    bad = [(9001, None), (9002, [1.0] * (dim - 1)), (9003, [1.0] * (dim + 1)), (9004, [float("nan")] + [0.0] * (dim - 1)), (9005, [float("-inf")] * dim), (9006, [None] + [0.0] * (dim - 1)), (9007, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], ROW).repartition(3)
    found, centre = kmeans.cluster(df, k=k, dim=dim)
    got = sorted(map(tuple, kmeans.report(found, centre).collect()), key=str)
    assert got == plain(rows, k, 5, dim)


def test_large_components_are_kept_within_bounds(spark):
    rows = [(i, [v, -v]) for i, v in enumerate([0.0, 1e3, 3e38, 2e5, -3e38, 1e20, -1e-30])]
    found, centre = kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, dim=2)
    assert sorted(map(tuple, kmeans.report(found, centre).collect()), key=str) == plain([(i, list(np.float32(v).tolist())) for i, v in rows], 3, 5, 2)


def test_nothing_to_cluster(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    found = kmeans.report(*kmeans.cluster(none))
    assert found.count() == 0 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filters_leave_most_distances_out(monkeypatch):
    r = np.random.default_rng(1)
    x = (np.repeat(r.normal(size=(40, 64)) * 2000, 50, axis=0) + r.normal(size=(2000, 64)) * 30).astype(np.int64)
    c = x[::50].copy()
    first = kmeans.Yinyang(c, kmeans.group_centroids(c, 4))
    state = first.first(x)
    moved = np.stack([x[state[0] == i].sum(0) // (state[0] == i).sum() for i in range(40)])
    measured = []
    squared = kmeans.squared
    monkeypatch.setattr(kmeans, "squared", lambda a, b: measured.append(len(a) * len(b)) or squared(a, b))
    own, upper, lower = kmeans.Yinyang(moved, first.group, c).next(x, *state)
    d = squared(x, moved)
    assert (own == d.argmin(1)).all() and sum(measured) < 0.1 * d.size
    assert (upper >= np.sqrt(d.min(1))).all()
    for g in range(lower.shape[1]):
        other = np.where((first.group[None, :] == g) & (np.arange(40)[None, :] != own[:, None]), d, 1 << 62)
        assert (lower[:, g] <= np.sqrt(other.min(1))).all()
