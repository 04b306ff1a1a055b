"""Exact k-means over integer vectors with Yinyang bounds.

Centroids are put into groups once.  Of each vector the table of a round holds its cluster, an upper bound of the distance to that
cluster's centroid, and for each group a lower bound of the distance to any other centroid of the group.  When centroids have moved,
the upper bound grows by the own centroid's way and each lower bound shrinks by the longest way in its group.

* Global filter: a vector whose upper bound is below all its lower bounds keeps its cluster; if it isn't, the upper bound is
  replaced by the exact distance and tested again.
* Group filter: of the vectors that are left, only groups with a lower bound not above the upper bound are looked at.
* All centroids of those groups are then measured exactly, and the group's bound is that of the nearest one that isn't chosen.

Distances are sums of squares of integers and compared as such; bounds are their roots, rounded away from the safe side, and filters
are strict, so ties always reach the exact comparison, where the smaller number wins.  A round is one pass over the vectors without
a shuffle, then an aggregation by cluster that moves one row per cluster and partition.  Centroids (k vectors) are all that passes
through the driver.  A round's table is deleted when the next one is whole.

Vectors with another number of components, a null or a non-finite one, and null vectors are left out.  Components are multiplied,
floored and kept within +-2**27, so that distances fit 64 bits.  With fewer than k vectors there are as many clusters as vectors;
without any the result is empty.  Rows are vectors: rows with equal ids or vectors are clustered each by itself; a null id comes last
in the order of the seeds, and equal hashes are ordered by the vectors.  Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import give_back, materialize

LIMIT = 1 << 27
#: Below this, sums of products of so many components are exact as 64-bit floats too.
FLOAT_BITS = 52
#: Bounds are rounded by this share, far more than the roots' and sums' own errors.
SLACK = 1e-12
GROUP_OF = 10


def kept_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): vectors of ``dim`` finite components as integers floor(scale * x)."""
    v = F.col(f"`{vector_col}`")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    number = lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * float(scale)))).cast("int")
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, number).alias("x"))


def seeds(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in found], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << FLOAT_BITS:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        out[:, j] = ((x - one) ** 2).sum(1)
    return out


def up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 + SLACK)


def down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 - SLACK)


def group_centroids(c: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves, which a parameter bounds."""
    groups = max(1, min(groups, len(c)))
    centre = c[np.linspace(0, len(c) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(rounds):
        of = ((c[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                centre[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]  # groups without a centroid are left out


class Yinyang:
    """Assignment of a batch of vectors to centroids, first without and then with bounds."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.c, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        way = np.zeros(len(centroids)) if before is None else up(((centroids - before) ** 2).sum(1))
        self.way, self.group_way = way, np.array([way[m].max() for m in self.members])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper bound, lower bounds) by distances to all centroids."""
        d = squared(x, self.c)
        own, all_rows = d.argmin(1), np.arange(len(x))  # the first of equal ones
        upper = up(d[all_rows, own])
        d = d.astype(np.float64)
        d[all_rows, own] = np.inf
        return own, upper, np.stack([down(d[:, m].min(1)) for m in self.members], axis=1)

    def next(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, upper, lower = own.copy(), upper * (1 + SLACK) + self.way[own], lower * (1 - SLACK) - self.group_way[None, :] * (1 + SLACK)
        at = np.flatnonzero(lower.min(1) <= upper)
        upper[at] = up(((x[at] - self.c[own[at]]) ** 2).sum(1))
        at = at[lower[at].min(1) <= upper[at]]
        if not len(at):
            return own, upper, lower
        old = own[at]
        old_d = ((x[at] - self.c[old]) ** 2).sum(1)
        best, best_d = old.copy(), old_d.copy()
        look = lower[at] <= upper[at][:, None]  # those that the group filter leaves
        measured = {}
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(look[:, g])
            if not len(rows):
                continue
            d = squared(x[at[rows]], self.c[m])
            measured[g] = (rows, d)
            k = d.argmin(1)
            low, which = d[np.arange(len(rows)), k], m[k]
            better = (low < best_d[rows]) | ((low == best_d[rows]) & (which < best[rows]))
            best[rows[better]], best_d[rows[better]] = which[better], low[better]
        for g, (rows, d) in measured.items():
            d = np.where(self.members[g][None, :] == best[rows][:, None], np.inf, d.astype(np.float64))
            lower[at[rows], g] = down(d.min(1))
        # The former centroid is another one of its group now; a group that was measured has it already.
        moved = np.flatnonzero(best != old)
        g = self.group[old[moved]]
        lower[at[moved], g] = np.minimum(lower[at[moved], g], down(old_d[moved]))
        own[at], upper[at] = best, up(best_d)
        return own, upper, lower


STATE = "vec_id {id}, x array<int>, cluster int, upper double, lower array<double>"


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _round(rows: DataFrame, step: Yinyang, dim: int, known: bool) -> DataFrame:
    """The rows with their cluster and bounds, as they are or from those of the round before."""
    groups = len(step.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), dim, np.int64)
            if known:
                own, upper, lower = step.next(x, b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy(), _matrix(b.column("lower"), groups, np.float64))
            else:
                own, upper, lower = step.first(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(own, pa.int32()), pa.array(upper, pa.float64()), _lists(lower, pa.float64())], ["vec_id", "x", "cluster", "upper", "lower"])
        give_back()

    return rows.mapInArrow(run, STATE.format(id=rows.schema["vec_id"].dataType.simpleString()))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after the floor of each cluster's mean; empty clusters keep theirs."""
    out, dim = centroids.copy(), centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dim)])
    for r in sums.collect():  # k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(here, True)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that is kept, the final centroids); distances are squared."""
    rows = kept_vectors(vectors, dim, scale, id_col, vector_col)
    c = seeds(rows, k, seed)
    if not len(c):
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), np.zeros((0, dim), np.int64)
    group, before, state = group_centroids(c, -(-len(c) // GROUP_OF)), None, rows
    for i in range(rounds + 1):
        older, state = state, materialize(_round(state, Yinyang(c, group, before), dim, known=i > 0), "clusters")
        if i:
            _delete(older)
        if i < rounds:
            before, c = c, _means(state, c)
    centre = F.element_at(F.lit(c.tolist()), F.col("cluster") + 1)
    way = F.aggregate(F.zip_with("x", centre, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return state.select("vec_id", "cluster", way.alias("distance")), c


def report(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of cluster() with the inertia of their cluster and of all, and the SHA-256 of their centroid."""
    sums = {r["cluster"]: r["d"] for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    own = [sums.get(i, 0) for i in range(len(centroids))] or [0]
    sha = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in centroids.tolist()] or [""]
    at = F.col("cluster") + 1
    return clustered.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(x).cast("long") for x in own]), at).alias("cluster_inertia"),
        F.lit(sum(own)).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(x) for x in sha]), at).alias("centroid_sha256"),
    )


def sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2") -> str:
    """The same without bounds: all distances in every round."""
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"d{i} AS MATERIALIZED (SELECT rid, vec_id, v.x AS x, c, CAST(list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i})")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY rid)")
        if i < rounds:
            ctes.append(f"s{i} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({dim})) AS i FROM a{i}) GROUP BY c, i)")
            ctes.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY c)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c{rounds}.x, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    return f"WITH {', '.join(ctes)} {last}"
