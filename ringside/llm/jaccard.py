"""Exact n-gram Jaccard join: which documents are linked by word-shingle sets of at least a given Jaccard similarity.

The join is size-aware.  With a threshold t, sets of n and m members are similar when they share at least
``o(n, m) = ceil(t / (1 + t) * (n + m))`` members.

* Sets below the size boundary are *small*: each enumerates its subsets of every size o(n, m) that a small partner can ask for.
  Two small sets are similar only if they have such a subset in common, so equal subset hashes give all candidates.
* All others are *large*, and sets just below the boundary take part as their possible partners: they scan inverted lists.
  First, of each set the lowest members by hash (a few more than the prefix filter needs) are counted over the corpus; a set
  stays only if enough of these are held by another set as well, which a similar pair guarantees.  For those that stay,
  members are ordered by document frequency, rarest first, and each set enters the lists of its prefix.
* The boundary is chosen by cost, from the number of sets of each small size: the subsets that all sets below it emit against
  the list entries that all others read and write.

Lists are scanned in rounds.  In each round every list takes a few of its sets as pivots, which are compared with all sets of
the list that are not yet known to be in the same component; then the pivots leave the list.  A list ends when all that is in
it is connected, so a group of many near copies costs a few comparisons for each copy instead of all pairs, and every pair in
different components is compared.  Each candidate pair is verified on the full sets, so hashes decide nothing but candidates
(shingles are 64-bit hashes; two different shingles of one pair of documents are taken for one with odds of about 1e-13).

Exact copies of a set are one vertex throughout.  Connected components come from alternating large-star and small-star rounds.
All steps are joins and aggregations keyed by hash, list or vertex; intermediate tables are written to the shared folder.  What is
looked up by token or vertex is such a table, never an aggregation in the task of the join: Spark broadcasts small ones, and splits the
hot tokens and vertices of the other side when it joins large ones.

``link_components`` gives components only; ``links`` compares all candidates, without the shortcuts by component, and gives every
verified pair of distinct sets and the set of each document.  ``representatives`` keeps one row of each component.

Null, empty and white-space-only texts have an empty set and are linked with nothing; texts shorter than a shingle are one
shingle as a whole.  Rows are documents: repeated rows are exact copies.  A null id takes part but never is a component's id,
unless all ids in it are null.  Of the input, only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import WORD, free_name, give_back, materialize, with_fields

#: Sets of more members are never small, whatever their number.
SMALL_MOST = 24
#: So much of a set is counted beyond what the prefix filter needs.
EXTRA = 0.05
#: Pivots of a list in the first round, and by how much they grow each round.
PIVOTS, GROWTH = 8, 8
#: Up to so many ids the search for the texts that stay is a broadcast join (some 16 MB); beyond, a shuffle join.
BROADCAST_IDS = 1_000_000
MEMO = 100_000


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int
    den: int

    def least(self, n: int) -> int:
        """The fewest members that a set of n shares with any similar set; also the size of its smallest partner."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """o(n, m); for numbers or columns."""
        if isinstance(n, Column):
            return F.ceil(F.lit(self.num) * (n + m) / F.lit(self.num + self.den))
        return -(-self.num * (n + m) // (self.num + self.den))

    def subset_sizes(self, n: int, below: int) -> list[int]:
        """Sizes of the subsets that a set of n has to enumerate for partners of fewer than ``below`` members."""
        sizes = {self.overlap(n, m) for m in range(self.least(n), min(below - 1, self.den * n // self.num) + 1)}
        return sorted(s for s in sizes if s <= n)

    def subset_cost(self, n: int, below: int) -> int:
        return sum(math.comb(n, s) for s in self.subset_sizes(n, below))

    def probe(self, n: int) -> int:
        return min(n, n - self.least(n) + 1 + math.ceil(EXTRA * n))

    def probe_shared(self, n: int) -> int:
        """How many of a set's probe members another set must hold, whichever partner it has; no more than they share at least."""
        return min(self.least(n), 1 + math.ceil(EXTRA * self.least(n)))


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII letters and white space
        if not found:
            return np.zeros(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(a))
        h = np.zeros(len(a) - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ a[i : len(a) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h.view(np.int64))


def _pack(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _summaries(docs: DataFrame, words: int, t: Threshold) -> DataFrame:
    """docs with n_shingles, sig (of the whole set), probe (its lowest hashes, six bytes each) and small (all of a small set)."""

    def make():
        shingler = Shingler(words)

        def run(texts):
            sets = [shingler.hashes(x) for x in texts]
            return {
                "n_shingles": [len(h) for h in sets],
                "sig": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets],
                "probe": [_pack(h[: t.probe(len(h))]) for h in sets],
                "small": [h if len(h) <= SMALL_MOST else None for h in sets],
            }

        return run

    return with_fields(docs, "text", "n_shingles long, sig binary, probe binary, small array<long>", make)


def boundary(sizes: dict[int, int], t: Threshold) -> int:
    """The size from which on sets are large, by cost.  sizes: the number of sets of each size up to SMALL_MOST."""

    def cost(x: int) -> int:
        subsets = sum(k * t.subset_cost(n, x) for n, k in sizes.items() if n < x)
        lists = sum(k * (2 * t.probe(n) + n) for n, k in sizes.items() if n >= t.least(x))
        return subsets + lists

    return min(range(1, SMALL_MOST + 2), key=lambda x: (cost(x), x))


def _small_pairs(classes: DataFrame, x: int, t: Threshold, every: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of small sets: enough of those with a subset in common to connect all of them, or every one."""
    sizes = {n: t.subset_sizes(n, x) for n in range(1, x)}

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, n, s, key = [], [], [], []
            for own, members in zip(batch["v"].tolist(), batch["small"].tolist(), strict=True):
                members = np.asarray(members, "<i8")
                for size in sizes[len(members)]:
                    for c in combinations(members.tolist(), size):
                        v.append(own)
                        n.append(len(members))
                        s.append(size)
                        key.append(xxhash.xxh3_64_intdigest(np.array(c, "<i8").tobytes(), seed=size) - (1 << 63))
            yield pd.DataFrame({"v": np.array(v, np.int64), "n": np.array(n, np.int32), "s": np.array(s, np.int32), "key": np.array(key, np.int64)})
        give_back()

    small = classes.filter((F.col("n") > 0) & (F.col("n") < x)).select("v", "small")
    rows = small.mapInPandas(subsets, "v long, n int, s int, key long")
    if every:
        other = rows.select("key", "s", F.col("n").alias("m"), F.col("v").alias("b"))
        return _ordered(rows.join(other, ["key", "s"]).filter((F.col("s") == t.overlap(F.col("n"), F.col("m"))) & (F.col("v") < F.col("b"))), "v", "b")
    firsts = rows.groupBy("key", "s", "n").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    more = firsts.groupBy("key", "s").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).filter("lo < hi").select("key", "s")
    firsts = firsts.join(more, ["key", "s"]).select("key", "s", F.col("n").alias("m"), F.col("first").alias("b"))  # at most a row for each small size
    fits = (F.col("s") >= t.overlap(F.col("n"), F.col("m"))) & (F.col("v") != F.col("b"))
    return _ordered(rows.join(firsts, ["key", "s"]).filter(fits), "v", "b")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    a = sets.select(F.col("v").alias("a"), F.col("members").alias("x"))
    b = sets.select(F.col("v").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").filter(F.lit(t.den) * both >= F.lit(t.num) * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b) but the roots; the root is the smallest vertex of the component.

    Alternates large-star and small-star rounds until nothing changes.  Minima are pre-aggregated before they are moved, and no
    neighbourhood is ever gathered.  Loops (a = b) are left out; no edges give no rows.
    """

    def star(e: DataFrame, large: bool, rows: int) -> DataFrame:
        out = e.select(F.col("a").alias("u"), F.col("b").alias("w"))
        back = e.select(F.col("b").alias("u"), F.col("a").alias("w"))
        near = out.union(back) if large else out.union(back).filter("w < u")
        low = near.groupBy("u").agg(F.min("w").alias("m"))
        # What has no smaller neighbour keeps its edges: of stars that are done nothing is looked up.
        low = materialize(low.filter("m < u") if large else low, "lowest", rows)
        moved = near.filter("w > u") if large else near
        moved = moved.join(low, "u", "left").select(F.col("w").alias("a"), F.coalesce("m", "u").alias("b"))
        if not large:
            moved = moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = materialize(_ordered(edges.filter("a <> b"), "a", "b").select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
    before, found = None, mark(now)
    while found != before and found[0]:
        now = materialize(star(star(now, True, found[0]), False, found[0]), "stars", found[0])
        before, found = found, mark(now)
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _survivors(probes: DataFrame, t: Threshold) -> DataFrame:
    """(v, n) of the large sets of which enough probe members are held by another set."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [_unpack(b) for b in batch["probe"]]
            count = [len(p) for p in parts]
            need = [t.probe_shared(n) for n in batch["n"].tolist()]
            yield pd.DataFrame({"token": np.concatenate(parts), "v": np.repeat(batch["v"].to_numpy(np.int64), count), "n": np.repeat(batch["n"].to_numpy(np.int32), count), "need": np.repeat(np.array(need, np.int32), count)})
        give_back()

    tokens = probes.mapInPandas(rows, "token long, v long, n int, need int")
    shared = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token"), "shared")
    return tokens.join(shared, "token").groupBy("v", "n", "need").agg(F.count(F.lit(1)).alias("held")).filter("held >= need").select("v", "n")


def _lists(sets: DataFrame, t: Threshold) -> DataFrame:
    """(token, v, n, rest): the inverted lists of the prefixes, rarest members first; members that one set has alone head each prefix.

    rest counts the members of the set from this one on.
    """
    rows = sets.select("v", "n", F.explode("members").alias("token"))
    df = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequencies")
    shared = rows.join(df, "token").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # bounded by one set
    prefix = F.col("n") - F.ceil(F.lit(t.num) * F.col("n") / F.lit(t.den)) + 1
    entries = prefix - (F.col("n") - F.size("shared"))
    each = shared.filter(entries > 0).select("v", "n", F.size("shared").alias("k"), F.posexplode(F.slice("shared", 1, entries.cast("int"))).alias("i", "e"))
    lists = materialize(each.select(F.col("e.token").alias("token"), "v", "n", (F.col("k") - F.col("i")).alias("rest")), "entries")
    # An entry needs a partner no smaller than the list's smallest set, with enough members left for it.
    smallest = materialize(lists.groupBy("token").agg(F.min("n").alias("smallest"), F.count(F.lit(1)).alias("entries")).filter("entries > 1").drop("entries"), "smallest")
    enough = F.lit(t.num + t.den) * F.col("rest") >= F.lit(t.num) * (F.col("n") + F.greatest(F.col("smallest"), F.ceil(F.lit(t.num) * F.col("n") / F.lit(t.den))))
    return lists.join(smallest, "token").filter(enough).drop("smallest")


def scan(lists: DataFrame, sets: DataFrame, edges: DataFrame, t: Threshold, pivots: int | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The edges, with those that scanning the lists adds to them, as stars (v, root).

    narrow: leaves out, after the first round, entries of which it knows that no other set of their lists is similar.  It may give
    each entry ``tokens``, all lists of its set: then two sets that are in several lists together are compared in one of them.  And it
    may give ``bits`` and ``outside``: which members of a set of the list, the same for all entries, the entry has, and how many others it
    can have in common with any; then only pairs are candidates that can have enough members in common by that.
    """
    comp, k, n = components(edges), pivots or PIVOTS, lists.count()
    tested = None
    while True:
        columns = lists.columns
        labelled = materialize(lists.join(comp, "v", "left").select(*columns, F.coalesce("root", "v").alias("root")), "labelled", n)
        live = materialize(labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token"), "live", n)
        lists = materialize(labelled.join(live, "token").select(*columns, "root"), "lists", n)
        n = lists.count()
        if not n:
            return comp
        order = F.row_number().over(_by_token())
        heads = materialize(lists.withColumn("k", order).filter(F.col("k") <= k).drop("k"), "pivots", n)
        other = lists.select("token", F.col("v").alias("w"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("root").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("tokens", "bits", "outside") if c in columns])
        # By size; and at the first member that both have, which is in both prefixes, what is left of either must be enough.
        fits = (F.col("root") != F.col("other")) & (F.lit(t.den) * F.least("n", "m") >= F.lit(t.num) * F.greatest("n", "m")) & (F.lit(t.num + t.den) * F.least("rest", "left") >= F.lit(t.num) * (F.col("n") + F.col("m")))
        if "bits" in columns:
            both = F.aggregate(F.zip_with("bits", "other_bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, k: n + k)
            fits = fits & (F.lit(t.num + t.den) * (both + F.least("outside", "other_outside")) >= F.lit(t.num) * (F.col("n") + F.col("m")))
        own = heads
        if "tokens" in columns:
            mine = materialize(heads.groupBy("v").agg(F.collect_set("token").alias("mine")), "pivots-lists", n)  # of the lists of one set
            own, fits = heads.drop("tokens").join(mine, "v"), fits & (F.array_min(F.array_intersect("mine", "other_tokens")) == F.col("token"))
        pairs = _ordered(own.join(other, "token").filter(fits), "v", "w")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = materialize(_verified(pairs, sets, t), "links")
        if not links.isEmpty():
            comp = components(links.union(comp.select(F.col("v").alias("a"), F.col("root").alias("b"))))
        lists = lists.join(heads.select("token", "v"), ["token", "v"], "left_anti").select(*columns)
        if narrow:
            lists = narrow(materialize(lists, "rest", n))
        k *= GROWTH


def _list_pairs(lists: DataFrame, t: Threshold) -> DataFrame:
    """All candidate pairs (a, b) of sets that are in a list together."""
    other = lists.select("token", F.col("v").alias("w"), F.col("n").alias("m"), F.col("rest").alias("left"))
    fits = (F.col("v") < F.col("w")) & (F.lit(t.den) * F.least("n", "m") >= F.lit(t.num) * F.greatest("n", "m")) & (F.lit(t.num + t.den) * F.least("rest", "left") >= F.lit(t.num) * (F.col("n") + F.col("m")))
    return _ordered(lists.join(other, "token").filter(fits), "v", "w")


def _by_token():
    from pyspark.sql import Window

    return Window.partitionBy("token").orderBy(F.xxhash64("v"), "v")


def _prepared(docs: DataFrame, words: int, t: Threshold) -> tuple[DataFrame, DataFrame, int]:
    """(documents with their summaries, classes of equal sets, the boundary)."""
    own = materialize(_summaries(docs, words, t).drop("text"), "summaries")
    filled = own.filter("n_shingles > 0")
    classes = filled.groupBy("sig").agg(F.min("doc_id").alias("low"), F.first("n_shingles").cast("int").alias("n"), F.first("small").alias("small"))
    classes = materialize(classes.withColumn("v", F.monotonically_increasing_id()), "classes")

    sizes = {r["n"]: r["k"] for r in classes.filter(F.col("n") <= SMALL_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    return own, classes, boundary(sizes, t)


def _large_sets(docs: DataFrame, own: DataFrame, classes: DataFrame, x: int, words: int, t: Threshold) -> DataFrame:
    """(v, n, members) of the large sets and their possible partners that may have links."""
    large = classes.filter(F.col("n") >= t.least(x)).select("sig", "low", "v", "n")
    probes = own.filter("n_shingles > 0").select("doc_id", "sig", "probe").join(large, "sig").filter(F.col("doc_id").eqNullSafe(F.col("low"))).select("v", "n", "probe")
    stay = materialize(_survivors(probes, t).join(large.select("v", "sig", "low"), "v").select("v", "n", "sig", "low"), "survivors")
    return materialize(full_sets(docs, stay, words), "sets")


def links(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id, n_shingles and set_id of every document, and (a, b), a < b, of all similar pairs of distinct sets.

    Documents with equal sets have one set_id and are linked with each other; documents without shingles have none.  All pairs
    of a group of many distinct near copies are compared and given, which is quadratic in the group.
    """
    t = Threshold(*threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own, classes, x = _prepared(docs, words, t)
    small_sets = classes.filter(F.col("n") < x).select("v", F.col("small").alias("members"))
    small = _verified(_small_pairs(classes, x, t, every=True), small_sets, t)
    sets = _large_sets(docs, own, classes, x, words, t)
    large = _verified(materialize(_list_pairs(materialize(_lists(sets, t), "lists"), t), "pairs"), sets, t)
    members = own.select("doc_id", "n_shingles", "sig").join(classes.select("sig", F.col("v").alias("set_id")), "sig", "left")
    return members.select("doc_id", "n_shingles", "set_id"), small.union(large).distinct()


def link_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that its links reach, its own included)."""
    t = Threshold(*threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own, classes, roots = _rooted(docs, words, t)
    return documents(own, classes, roots)


def documents(own: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    found = classes.select("sig", "v", "low").join(roots, "v", "left").select("sig", "low", F.coalesce("root", "v").alias("root"))
    lows = found.groupBy("root").agg(F.min("low").alias("component_id"))
    found = found.join(lows, "root").select("sig", "component_id")
    out = own.select("doc_id", "n_shingles", "sig").join(found, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component, and all without shingles.

    That with the smallest id stays, null being the largest; of rows with one id, that whose text has the smallest hash; of
    rows equal in both, any one.  Columns stay as they are.
    """
    t = Threshold(*threshold)
    text, names = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), [free_name(f"__row{i}", docs) for i in range(3)]
    key = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    own, classes, roots = _rooted(docs.select(key[0].alias("doc_id"), F.col(f"`{text_col}`").alias("text"), key[1].alias("k1"), key[2].alias("k2")), words, t)
    rooted = classes.select("sig", "v").join(roots, "v", "left").select("sig", F.coalesce("root", "v").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")
    firsts = own.filter("n_shingles > 0").groupBy("sig").agg(F.min(order).alias("first"))
    firsts = firsts.join(rooted, "sig").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.k1", "first.k2")
    copies = own.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    chosen = firsts.alias("f").join(copies.alias("c"), F.col("f.k1").eqNullSafe(F.col("c.k1")) & (F.col("f.k2") == F.col("c.k2")) & F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")))
    chosen = materialize(chosen.select(*[F.col(f"f.{c}").alias(n) for c, n in zip(("doc_id", "k1", "k2"), names)], "c.copies"), "chosen")

    worded = text.rlike(WORD)
    keyed = docs.filter(worded).withColumns(dict(zip(names, key)))
    same = lambda x: [keyed[names[0]].eqNullSafe(x[names[0]]), *(keyed[n] == x[n] for n in names[1:])]
    one, more = chosen.filter("copies = 1"), chosen.filter("copies > 1")
    kept = keyed.join(one, same(one), "left_semi").union(keyed.join(more, same(more), "left_semi").dropDuplicates(names))
    return kept.drop(*names).union(docs.filter(~worded))


def _rooted(docs: DataFrame, words: int, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their summaries, classes of equal sets, (v, root) of classes with links)."""
    own, classes, x = _prepared(docs, words, t)
    # Small sets.
    small_sets = classes.filter(F.col("n") < x).select("v", F.col("small").alias("members"))
    edges = materialize(_verified(_small_pairs(classes, x, t), small_sets, t), "small-links")
    # Large sets and their possible partners.
    sets = _large_sets(docs.select("doc_id", "text"), own, classes, x, words, t)
    return own, classes, scan(materialize(_lists(sets, t), "lists"), sets, edges, t)


def full_sets(docs: DataFrame, stay: DataFrame, words: int) -> DataFrame:
    """(v, n, members) of the classes that stay, from the texts of their first documents."""
    ids = stay.select(F.col("low").alias("doc_id")).distinct()
    if stay.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").union(docs.filter("doc_id is null"))

    def make():
        shingler = Shingler(words)

        def run(batch):
            sets = [shingler.hashes(x) for x in batch]
            return {"sig": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], "members": sets}

        return run

    full = with_fields(texts, "text", "sig binary, members array<long>", make).drop("text")
    matched = full.join(stay, "sig").filter(F.col("doc_id").eqNullSafe(F.col("low")))
    return matched.groupBy("v", "n").agg(F.first("members").alias("members"))
