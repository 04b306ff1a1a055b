"""Histogram gradient boosting of a binary outcome, with a learned direction for missing values at each split.

Values become bins once, at quantiles of each feature; a missing value (null or NaN) has a bin of its own.  Rows are kept in blocks, feature
by feature: their values, read once from the columns, and then their bins, one byte a feature, are tables in the shared folder.  A level
of a tree is one job: every task adds up gradients, curvatures and rows by node, feature and bin, sums meet by key, and the driver gets
the histograms of the level's nodes, whose size is set by parameters and not by rows.  Of two siblings only the one with fewer rows is
counted; the other is what their parent has more.

Gradients are rounded to integers before they are added, so a model does not depend on the order of rows, on partitions or on tasks that
ran twice.  For each split both directions of the missing rows are tried; where a node has none, later ones go with the larger
child.  Missing rows alone on one side are a split too.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.sources.scratch import stored

#: Gradients are counted in units of 2**-30; a node may hold 8e9 rows.
UNIT = float(1 << 30)
#: After so many trees their sum is written beside the rows; until then tasks add it up themselves.
REFRESH = 10
#: Error of ranks in the quantiles, as 1 / accuracy.
ACCURACY = 10_000
#: Rows of a block of values and of one of bins; sums over a block are exact in doubles.
VALUES, BINS = 1 << 13, 1 << 16


@dataclass(frozen=True)
class Options:
    """iterations: trees; bins: of values, without that of missing ones (255 at most); leaf_rows: the fewest rows of a leaf."""

    iterations: int = 40
    rate: float = 0.3
    depth: int = 4
    leaves: int = 31
    leaf_rows: int = 10
    leaf_curvature: float = 1e-3
    l2: float = 0.0
    bins: int = 64

    def __post_init__(self):
        if not (1 <= self.bins <= 255 and self.depth >= 1 and self.leaves >= 2 and self.leaf_rows >= 1 and self.iterations >= 0):
            raise ValueError("options out of range")


@dataclass
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 at leaves.  Rows in bins up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, at, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def place(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of each row of bins by feature: of both children's leaves each row takes one, by masks."""
        kind = np.int16 if len(self.feature) < 1 << 15 else np.int32

        def below(node: int):
            if self.feature[node] < 0:
                return kind(node)
            own = bins[self.feature[node]]
            right = own > self.bin[node]
            if self.missing_left[node]:
                right &= own != missing
            left, other = below(self.left[node]), below(self.right[node])
            return left ^ ((left ^ other) & -right.astype(kind))

        return np.broadcast_to(below(0), bins.shape[1])

    def values(self, bins: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.value).take(self.place(bins, missing))


@dataclass
class Booster:
    """Bins of each feature, what is added to the log-odds ``start`` by each tree, and names in order."""

    features: list[str]
    edges: list[list[float]]
    bins: int
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Values as bins, by feature: how many edges are below; missing ones have the last bin."""
        out = np.empty((len(columns), len(columns[0]) if len(columns) else 0), np.uint8)
        for own, v, e in zip(out, columns, self.edges, strict=True):
            own[:] = np.searchsorted(np.array(e), v, side="left")
            own[np.isnan(v)] = self.bins
        return out

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.values(bins, self.bins) for t in self.trees), np.full(bins.shape[1], self.start))

    def probability(self, rows: DataFrame) -> DataFrame:
        """rows with probability, from their columns of the features' names."""
        booster = self

        @F.arrow_udf("double")
        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array(sigmoid(booster.log_odds(booster.binned([_doubles(c) for c in b.flatten()]))))

        values = F.struct(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(self.features)])
        return rows.withColumn("probability", apply(values) if self.features else F.lit(float(sigmoid(np.array(self.start)))))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges, "bins": self.bins, "start": self.start, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(d["features"], d["edges"], d["bins"], d["start"], [Tree(**t) for t in d["trees"]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gradients(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss, in units."""
    p = sigmoid(score)
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def _doubles(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls as NaN


# ---------------------------------------------------------------- blocks of rows

Columns = tuple[np.ndarray, np.ndarray]  # of each row a number, and a matrix by feature


def _blocks(parts: Iterator[Columns], rows: int) -> Iterator[Columns]:
    """The parts, joined or cut to blocks of so many rows, the last one of fewer."""
    held, count = [], 0
    for part in parts:
        while part[0].size:
            now = rows - count
            held.append((part[0][:now], part[1][:, :now]))
            count += len(held[-1][0])
            part = part[0][now:], part[1][:, now:]
            if count == rows:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
                held, count = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)


def _table(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """A table of blocks, eight of which are read at a time."""
    return stored(rows, name, **{"parquet.block.row.count.limit": "8"}, **options)


def _packed(**arrays: np.ndarray) -> pa.RecordBatch:
    """One row, a block, with arrays as bytes."""
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays.values()], list(arrays))


def _values(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Labels and values in blocks, NaN for what is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column(0).to_numpy().astype(np.uint8), np.stack([_doubles(c) for c in b.columns[1:]])) for b in batches if b.num_rows)
        for y, values in _blocks(parts, VALUES):
            yield _packed(y=y, data=values + 0.0)  # no negative zeros

    return rows.select(F.col(label).cast("int").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]).mapInArrow(run, "y binary, data binary")


def _read_values(b: pa.RecordBatch, width: int) -> Iterator[Columns]:
    for y, data in zip(b.column("y"), b.column("data")):
        yield np.frombuffer(y.as_buffer(), np.uint8), np.frombuffer(data.as_buffer(), np.float64).reshape(width, -1)


# ---------------------------------------------------------------- edges


def _key(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _value(key: int) -> float:
    return float(np.array([key ^ ((key >> 63) & ((1 << 63) - 1))], np.int64).view(np.float64)[0])


#: Bits of a key by which values are counted first, and how many more each further pass looks at.
FIRST, MORE = 16, 8


def _counted(blocks: DataFrame, width: int, run) -> dict[str, np.ndarray]:
    found = blocks.mapInArrow(run, "feature int, kind int, key long, n long").groupBy("feature", "kind", "key").agg(F.sum("n").alias("n")).orderBy("feature", "kind", "key").toArrow()  # sizes are set by the number of bins
    return {c: found[c].to_numpy() for c in found.column_names}


def _long_rows(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(p[2]) for p in parts]
    many = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), sizes)
    join = lambda i: np.concatenate([np.asarray(p[i], np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(many(0, np.int32)), pa.array(many(1, np.int32)), pa.array(join(2)), pa.array(join(3))], ["feature", "kind", "key", "n"])


def _first_counts(blocks: DataFrame, width: int, bins: int):
    """Of each feature: its values' keys, if it has few, else None; the largest key; numbers of rows by the first bits of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, few = np.zeros((width, 1 << FIRST), np.int64), [np.zeros(0, np.int64)] * width
        top: list[int | None] = [None] * width
        for _, values in _blocks((part for b in batches for part in _read_values(b, width)), BINS):
            for i, v in enumerate(values):
                key = _key(v[~np.isnan(v)])
                if not key.size:
                    continue
                total[i] += np.bincount((key >> (64 - FIRST)) + (1 << (FIRST - 1)), minlength=1 << FIRST)
                top[i] = max(int(key.max()), int(key[0]) if top[i] is None else top[i])
                if len(few[i]) <= bins:
                    few[i] = np.union1d(few[i], key)[: bins + 1]  # one more says that there are many
        parts = []
        for i in range(width):
            at = np.flatnonzero(total[i])
            parts += [(i, 0, at, total[i][at]), (i, 1, few[i], np.ones(len(few[i]))), (i, 2, [] if top[i] is None else [top[i]], [] if top[i] is None else [1])]
        yield _long_rows(parts)

    found = _counted(blocks, width, run)
    out = []
    for i in range(width):
        pick = lambda kind: (found["feature"] == i) & (found["kind"] == kind)  # noqa: B023, E731
        few, top = found["key"][pick(1)], found["key"][pick(2)]
        out.append((few if len(few) <= bins else None, int(top.max()) if len(top) else None, found["key"][pick(0)] - (1 << (FIRST - 1)), found["n"][pick(0)]))
    return out


def _finer_counts(blocks: DataFrame, width: int, cells: dict[int, np.ndarray], bits: int) -> dict[str, np.ndarray]:
    """In some of the cells of the first ``bits``: rows by the next bits of the key (kind 0), and how many have one key that a task found there
    (kind 1), which are all if the cell has one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((len(c), 1 << MORE), np.int64) for i, c in cells.items()}
        first, like = {i: np.zeros(len(c), np.int64) for i, c in cells.items()}, {i: np.zeros(len(c), np.int64) for i, c in cells.items()}
        for _, values in _blocks((part for b in batches for part in _read_values(b, width)), BINS):
            for i, own in cells.items():
                key = _key(values[i][~np.isnan(values[i])])
                cell = key >> (64 - bits)
                at = np.searchsorted(own, cell)
                mine = np.flatnonzero(own.take(at, mode="clip") == cell)
                at, key = at.take(mine), key.take(mine)
                seen = total[i].any(axis=1)
                new = first[i].copy()
                new[at] = key
                first[i] = np.where(seen, first[i], new)
                like[i] += np.bincount(at[key == first[i].take(at)], minlength=len(own))
                total[i] += np.bincount((at << MORE) + ((key >> (64 - bits - MORE)) & ((1 << MORE) - 1)), minlength=total[i].size).reshape(total[i].shape)
        parts = []
        for i, own in cells.items():
            cell, low = np.nonzero(total[i])
            parts += [(i, 0, (own[cell] << MORE) + low, total[i][cell, low]), (i, 1, first[i][like[i] > 0], like[i][like[i] > 0])]
        yield _long_rows(parts)

    return _counted(blocks, width, run)


def _edges(blocks: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Where the bins of each feature end: every value but the last if there are few, else quantiles.

    Rows are counted by the first bits of their values as whole numbers in the same order, then, where a quantile's cell has more than one
    of ACCURACY rows and more than one value, by further bits of that cell.  Counts are exact, so edges don't depend on partitions; an
    edge is the largest number of its cell.
    """
    out: list[list[float]] = [[] for _ in range(width)]
    totals, top, ends, pending = {}, {}, {}, {}

    def settle(i: int, cell: np.ndarray, rank: np.ndarray, n: np.ndarray, bits: int) -> None:
        """Ends of the cells that need no more bits; ``pending`` gets the others, with the quantiles' ranks in them."""
        fine = (n * ACCURACY <= totals[i]) | (bits == 64)
        ends[i] |= {(int(c) << (64 - bits)) + (1 << (64 - bits)) - 1 for c in cell[fine]}
        if not fine.all():
            pending[i] = cell[~fine], rank[~fine], n[~fine]

    for i, (few, last, key, n) in enumerate(_first_counts(blocks, width, bins)):
        if few is not None:
            out[i] = [_value(int(k)) for k in few[:-1]]
        else:
            totals[i], top[i], ends[i] = int(n.sum()), last, set()
            ranks = np.array([-(-totals[i] * k // bins) for k in range(1, bins)], np.int64)
            upto = np.cumsum(n)
            at = np.searchsorted(upto, ranks)
            settle(i, key[at], ranks - (upto - n)[at], n[at], FIRST)
    bits = FIRST
    while pending:
        asked, pending = pending, {}
        found = _finer_counts(blocks, width, {i: np.unique(cell) for i, (cell, _, _) in asked.items()}, bits)
        for i, (cell, rank, rows) in asked.items():
            pick = lambda kind: (found["feature"] == i) & (found["kind"] == kind)  # noqa: B023, E731
            alone = {int(k) >> (64 - bits): (int(k), int(n)) for k, n in zip(found["key"][pick(1)], found["n"][pick(1)])}
            single = np.array([alone[int(c)][1] == n for c, n in zip(cell, rows)], bool)
            ends[i] |= {alone[int(c)][0] for c in cell[single]}
            cell, rank = cell[~single], rank[~single]
            key, n = found["key"][pick(0)], found["n"][pick(0)]
            upto = np.cumsum(n)
            before = (upto - n)[np.searchsorted(key >> MORE, cell)]  # of the first part of each cell
            at = np.searchsorted(upto, before + rank)
            settle(i, key[at], rank + before - (upto - n)[at], n[at], bits + MORE)
        bits += MORE
    for i, keys in ends.items():
        out[i] = [_value(k) for k in sorted(keys) if k < top[i]]
    return out


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Where the bins of the features of some rows end."""
    if not features:
        return []
    return _edges(_table(_values(rows.withColumn("__y", F.lit(0)), "__y", features), "values"), len(features), bins)


# ---------------------------------------------------------------- binned rows and trees

BINNED = "y binary, score binary, bins binary"


def _read_bins(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for y, score, bins in zip(b.column("y"), b.column("score"), b.column("bins")):
        yield np.frombuffer(y.as_buffer(), np.uint8), np.frombuffer(score.as_buffer(), np.float64), np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, -1)


def _binned(blocks: DataFrame, booster: Booster) -> DataFrame:
    width = len(booster.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((y, booster.binned(values)) for b in batches for y, values in _read_values(b, width))
        for y, bins in _blocks(parts, BINS):
            yield _packed(y=y, score=np.full(len(y), booster.start), bins=bins)

    return blocks.mapInArrow(run, BINNED)


def _scored(state: DataFrame, trees: list[Tree], width: int, missing: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, score, bins in _read_bins(b, width):
                yield _packed(y=y, score=sum((t.values(bins, missing) for t in trees), score), bins=bins)

    return state.mapInArrow(run, BINNED)


def _sums(bins: np.ndarray, slot: np.ndarray, slots: int, every: int, weights: list[np.ndarray | None]) -> np.ndarray:
    """Sums of the weights by slot, feature and bin.  Two features are counted at a time, by both bins, where that is a small table."""
    width = len(bins)
    out = np.empty((len(weights), slots, width, every), np.int64)
    by = 2 if slots * every * every <= 1 << 15 and 8 * len(slot) > slots * every * every else 1
    base = slot * every**by if slots > 1 else 0
    for i in range(0, width, by):
        two = by == 2 and i + 1 < width
        cell = bins[i].astype(np.intp)
        if two:
            cell *= every
            cell += bins[i + 1]
        cell += base if two or by == 1 else slot * every
        for k, w in enumerate(weights):
            sums = np.bincount(cell, w, slots * every ** (1 + two))
            if two:
                sums = sums.reshape(slots, every, every)
                out[k, :, i], out[k, :, i + 1] = sums.sum(axis=2), sums.sum(axis=1)
            else:
                out[k, :, i] = sums.reshape(slots, every)
    return out


def histograms(state: DataFrame, trees: list[Tree], tree: Tree, nodes: list[int], width: int, bins: int) -> dict[int, np.ndarray]:
    """For each of the nodes: gradient, curvature and rows by feature and bin, of the rows that ``tree`` places there."""
    every = bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes), width, every), np.int64)
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        for b in batches:
            for y, score, rows in _read_bins(b, width):
                slot = slot_of.take(tree.place(rows, bins))
                if len(tree.feature) > 1:
                    mine = np.flatnonzero(slot >= 0)
                    y, score, rows, slot = y.take(mine), score.take(mine), rows.take(mine, axis=1), slot.take(mine)
                g, h = gradients(y, sum((t.values(rows, bins) for t in trees), score))
                total += _sums(rows, slot, len(nodes), every, [g, h, None])
        total = total.reshape(3, -1)
        key = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(t[key], pa.int64()) for t in total]], ["key", "g", "h", "n"])

    parts = state.mapInArrow(run, "key long, g long, h long, n long")
    sums = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()  # a row for each node, feature and bin
    out = np.zeros((3, len(nodes) * width * every), np.int64)
    out[:, sums["key"].to_numpy()] = [sums[c].to_numpy() for c in ("g", "h", "n")]
    out = out.reshape(3, len(nodes), width, every)
    return {node: out[:, i] for i, node in enumerate(nodes)}


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray  # gradient, curvature and rows of the left child
    right: np.ndarray


def best_split(hist: np.ndarray, o: Options) -> Split | None:
    """The split with the largest gain; of equal ones that of the first feature, with missing rows right, at the lowest bin."""
    total, missing = hist[:, 0].sum(axis=1), hist[:, :, -1]
    low = hist[:, :, :-1].cumsum(axis=2)  # gradient, curvature and rows up to each bin
    left = np.stack([low, low + missing[:, :, None]], axis=2)  # of each feature with missing rows right, and left
    right = total[:, None, None, None] - left
    fits = (left[2] >= o.leaf_rows) & (right[2] >= o.leaf_rows) & (left[1] >= o.leaf_curvature * UNIT) & (right[1] >= o.leaf_curvature * UNIT)
    fits[:, 1] &= (missing[2] > 0)[:, None]
    if not fits.any():
        return None
    worth = lambda s: (s[0] / UNIT) ** 2 / (s[1] / UNIT + o.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, worth(left) + worth(right) - worth(total), -np.inf)
    f, side, b = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[f, side, b] > 0:
        return None
    a, z = left[:, f, side, b], right[:, f, side, b]
    return Split(float(gain[f, side, b]), int(f), int(b), bool(side) if missing[2, f] else bool(a[2] > z[2]), a, z)


def grow(state: DataFrame, trees: list[Tree], width: int, o: Options) -> Tree:
    """One tree, level by level; in a level the best splits go first until there are as many leaves as allowed."""
    tree, totals = Tree(), {}
    hists = histograms(state, trees, tree, [0], width, o.bins)
    totals[0] = hists[0][:, 0].sum(axis=1)
    leaves = 1
    for level in range(o.depth):
        found = sorted(((s, node) for node, h in hists.items() if (s := best_split(h, o)) is not None), key=lambda x: (-x[0].gain, x[1]))[: o.leaves - leaves]
        leaves += len(found)
        pairs = []
        for s, node in found:
            a, z = tree.split(node, s.feature, s.bin, s.missing_left)
            totals[a], totals[z] = s.left, s.right
            pairs.append((node, a, z) if s.left[2] <= s.right[2] else (node, z, a))  # the smaller child is counted
        if not pairs or leaves >= o.leaves or level + 1 == o.depth:
            break
        counted = histograms(state, trees, tree, [few for _, few, _ in pairs], width, o.bins)
        hists = counted | {many: hists[node] - counted[few] for node, few, many in pairs}
    for node, (g, h, _) in totals.items():
        if tree.feature[node] < 0:
            tree.value[node] = float(-o.rate * (g / UNIT) / (h / UNIT + o.l2)) if h else 0.0
    return tree


def fit(rows: DataFrame, features: list[str], label: str = "label", options: Options = Options()) -> Booster:
    """Boosted trees for a label of 0 or 1.  Rows without a label are left out; without rows of both labels there is no tree."""
    rows = rows.filter(F.col(label).isNotNull())
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    known = features and _table(_values(rows, label, features), "values")
    edges = _edges(known, len(features), options.bins) if features else []
    if not n or ones in (0, n) or not any(edges):
        share = min(max(ones / n if n else 0.5, 1e-15), 1 - 1e-15)
        return Booster(features, edges, options.bins, math.log(share / (1 - share)))
    booster = Booster(features, edges, options.bins, math.log(ones / (n - ones)))
    state, since = _table(_binned(known, booster), "binned", compression="none"), 0  # bins hardly get smaller, and are read for each level
    for i in range(options.iterations):
        recent = booster.trees[since:]
        if len(recent) == REFRESH:
            state, since, recent = _table(_scored(state, recent, len(features), options.bins), "binned", compression="none"), i, []
        tree = grow(state, recent, len(features), options)
        booster.trees.append(tree)
        if len(tree.feature) == 1:  # no split gains anything any more
            break
    return booster
