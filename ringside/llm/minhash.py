"""Near duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each distinct word shingle of a text is hashed once.  The upper bits of its hash say its bin, and a bin keeps its smallest hash; an
empty bin takes the value of another one, which it finds by hashing its own number with 1, 2, 3, ... until that bin is not empty.
All sets ask in the same order, so two sets agree in a bin with a probability equal to their similarity, empty bins included.

Bins are grouped into bands; sets that are equal in a whole band share a bucket.  Sets of a similarity of 0.8 miss each other in all
of 32 bands of 5 bins with a probability of 3e-6, and more similar ones far less.  A bucket gives edges of a star: its hub and every
other set of it that is not yet known to be connected with the hub.  Edges are confirmed on the full sets.  What a hub can't connect
is not dropped: the hub leaves the bucket, and further hubs follow (8 times as many in each round) until all that is left of a bucket
is connected, so buckets of copies cost one edge a copy and any others are searched to the end, without a cap.

Before further hubs, the members that the sets left in buckets have in common with any other of them are counted.  Two sets can't share
more members than either of them shares with all, which is exact and ends most of these searches: a text with a passage that many have,
or one that was changed too much to be a near copy, has too many members of its own.  Two sets that are in several buckets together
are compared in one of them.  Of each bucket one set is the reference, of whose members every other set has a bitmap: two bitmaps and what
the sets hold beside it bound what two sets can have in common, exactly again, so that few pairs but the similar ones are fetched.

Exact copies of a set are one vertex throughout.  Hubs, confirmation and components are those of the exact join (jaccard.py); all
steps are joins and aggregations by bucket or vertex, over tables in the shared folder.

Null, empty and white-space-only texts have an empty set and are linked with nothing; texts shorter than a shingle are one shingle as
a whole.  Rows are documents: repeated rows are exact copies.  A null id takes part, but is never a component's id unless all ids in it
are null, and is not kept beside others.  Only the id and the text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.llm import jaccard
from ringside.llm.common import materialize, small_batches, with_fields

BANDS, ROWS = 32, 5
#: Bins that an empty bin asks at once.
ASKED = 64


class Sketcher:
    """Values of the bins of a set of 64-bit hashes, and the hashes of its bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.asked = np.zeros((self.bins, 0), np.int64)

    def _ask(self, upto: int) -> np.ndarray:
        """Of every bin the first bins that it asks when it is empty; the table grows as it is needed."""
        have = self.asked.shape[1]
        if have < upto:
            more = [[xxhash.xxh3_64_intdigest(f"{b}:{t}".encode()) % self.bins for t in range(have, upto)] for b in range(self.bins)]
            self.asked = np.concatenate([self.asked, np.array(more, np.int64)], axis=1)
        return self.asked

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: distinct and not empty."""
        h = np.sort(hashes.view(np.uint64))
        of = ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)  # grows with the hash
        full, first = np.unique(of, return_index=True)
        out, have = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[full], have[full] = h[first], True
        if len(full) == 1:
            return np.full(self.bins, h[0])
        source, left, begin = np.arange(self.bins), np.flatnonzero(~have), 0
        while len(left):
            asked = self._ask(begin + ASKED)[left, begin : begin + ASKED]
            hit = have[asked]
            found = hit.any(axis=1)
            source[left[found]] = asked[found, hit[found].argmax(axis=1)]
            left, begin = left[~found], begin + ASKED
        return out[source]

    def band_hashes(self, hashes: np.ndarray) -> list[int]:
        """One 64-bit hash of each band's number and values; none of an empty set."""
        if not len(hashes):
            return []
        rows = self.values(hashes).reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(rows)]


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with n_shingles, sig (of the whole set) and bands in place of their texts."""

    def make():
        shingler, sketcher = jaccard.Shingler(words), Sketcher(bands, rows)

        def run(texts):
            sets = [shingler.hashes(x) for x in texts]
            return {"n_shingles": [len(h) for h in sets], "sig": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], "bands": [sketcher.band_hashes(h) for h in sets]}

        return run

    return with_fields(docs, "text", "n_shingles long, sig binary, bands array<long>", make).drop("text")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bits(reference: pd.Series, members: pd.Series) -> pd.Series:
    """Which members of the reference a set has, 64 in a number."""
    out = []
    for r, m in zip(reference, members, strict=True):
        packed = np.packbits(np.isin(r, m, assume_unique=True))
        out.append(np.pad(packed, (0, -len(packed) % 8)).view(np.int64))
    return pd.Series(out)


def _narrowed(lists: DataFrame, sets: DataFrame, t: jaccard.Threshold) -> DataFrame:
    """The entries of sets that hold enough members that another set of any list holds too; rest is how many these are, tokens the set's lists.

    At first, one set of each list is its reference: bits are the members that an entry has of it, and outside is how many of its
    others another set holds.
    """
    here = materialize(lists.groupBy("v").agg(F.collect_list("token").alias("tokens")), "left")  # of the bands of one set
    members = sets.join(here.select("v"), "v", "left_semi").select("v", F.explode("members").alias("member"))
    common = materialize(members.groupBy("member").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("member"), "common")
    shared = materialize(members.join(common, "member").groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("shared")), "shared-members")
    left = materialize(here.join(shared, "v"), "narrowed")
    first = "bits" not in lists.columns
    enough = F.lit(t.den) * F.col("shared") >= F.lit(t.num) * F.col("n")
    rows = lists.select("token", "v", "n", *[] if first else ["bits", "outside"]).join(left, "v").filter(enough)
    if first:
        rows = materialize(rows, "narrowed-lists")
        own = sets.select("v", "members")
        reference = materialize(rows.groupBy("token").agg(F.min("v").alias("v")).join(own, "v").select("token", F.col("members").alias("reference")), "references")
        rows = rows.join(own, "v").join(reference, "token").withColumn("bits", _bits.asNondeterministic()("reference", "members")).drop("reference", "members")
        # What an entry has of the reference is held by both; the reference has all of its own members.
        rows = rows.withColumn("outside", F.greatest(F.lit(0), F.col("shared") - F.aggregate("bits", F.lit(0), lambda n, b: n + F.bit_count(b))))
        rows = materialize(rows, "narrowed-bits")  # by itself: what follows joins partitions in tasks
    return rows.select("token", "v", "n", F.col("shared").alias("rest"), "tokens", "bits", "outside")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that its links reach, its own included), kept."""
    t = jaccard.Threshold(*threshold)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = materialize(sketches(docs, words, bands, rows), "sketches")
    classes = own.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("low"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    entries = classes.select("v", "n", F.explode("bands").alias("token"))
    shared = materialize(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"), "shared")
    buckets = materialize(entries.join(shared, "token").select("token", "v", "n", F.col("n").alias("rest")), "buckets")
    stay = classes.join(buckets.select("v").distinct(), "v", "left_semi").select("v", "n", "sig", "low")
    sets = materialize(jaccard.full_sets(docs, materialize(stay, "shared-classes"), words), "sets")
    small_batches(docs.sparkSession)
    none = buckets.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    roots = jaccard.scan(buckets, sets, none, t, pivots=1, narrow=lambda lists: _narrowed(lists, sets, t))
    found = jaccard.documents(own, classes, roots)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
