"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles.  The sketch of a whole is the
bottom k of the union of its parts' sketches, so sketches merge.  Two sketches estimate resemblance (the share of the bottom
k of the union that both hold), containment and, by the k-th hash, the number of distinct shingles.  With fewer than k
shingles on both sides all of these are exact.

Everything is made of SQL functions on columns.  Null and empty texts, and texts of white space only, have an empty sketch; a
text with fewer words than a shingle is one shingle as a whole.  Two empty sketches are alike (1.0), an empty one and any
other are not (0.0).  Equal texts have equal sketches; repeated rows and other columns are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import materialize

#: Hashes in a sketch; the error of a resemblance is about sqrt(r * (1 - r) / K), at most 0.045.
K = 128
WORDS = 5
#: Rows in a bucket of neighbours, about, and the most buckets by quantiles of the ids; with more rows buckets grow instead.
BUCKET_ROWS, MOST_BUCKETS = 1000, 8192


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """array<long>: the hash of each shingle, in order and with repeats."""

    def many(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)]))

    def hashes(ws: Column) -> Column:
        return F.when(F.size(ws) >= size, many(ws)).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<long>"))

    return F.element_at(F.transform(F.array(words(text)), hashes), 1)  # the words are split once


def sketch(text: Column, k: int = K, size: int = WORDS) -> Column:
    return bottom(shingle_hashes(text, size), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both, shared = merged(a, b, k), F.array_intersect(a, b)
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(both, shared)) / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, k) / F.lit(2.0**64)) + 0.5  # of the k-th hash among all hashes
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """How much of a's shingles b has: resemblance * |union| / |a|; 1.0 for an empty a."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_parts(parts: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """(key, sketch_col): the sketch of all parts with the same key.

    Each task first cuts its own parts to k hashes of a key, so a key with any number of parts moves k rows from each.
    """
    rows = parts.select(key, F.explode(sketch_col).alias("h")).distinct()
    best = rows.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("i") <= k)
    found = best.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))  # at most k a key
    keys = parts.select(key).distinct().withColumnRenamed(key, "__key")
    empty = F.array().cast("array<long>")
    joined = keys.join(found, keys["__key"].eqNullSafe(found[key]), "left")
    return joined.select(F.col("__key").alias(key), F.coalesce(sketch_col, empty).alias(sketch_col))


def _order() -> Column:
    """The order of documents: ids fall, null ids come last; equal ids stand by a hash of their texts."""
    return F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.col("tie"))


def _at(bounds: list[int]) -> Column:
    """How many of the sorted bounds are no larger than doc_id, by binary search."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(table, n + step - 1) <= F.col("doc_id"), n + step).otherwise(n))


def _bucket(ids: DataFrame) -> Column:
    """A number for each (doc_id, tie) that doesn't fall in their order; about BUCKET_ROWS rows, or n / MOST_BUCKETS, have the same one.

    Buckets lie between quantiles of the ids.  An id that fills more than one of these, and null, is divided by its hashes.
    """
    n, filled = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    each = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    q = -(-filled // each)
    found = ids.agg(F.percentile_approx("doc_id", [i / q for i in range(q)], max(10_000, 20 * q))).first()[0] if q else []
    bounds = sorted(set(found))
    parts = {b: k for b in bounds if (k := found.count(b)) > 1}
    nulls = max(1, -(-(n - filled) // each))
    most = max([nulls, *parts.values()]) + 1

    def part(k: Column) -> Column:
        return F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * k).cast("long"), k - 1)

    own = F.lit(0).cast("long")
    if parts:
        k = F.element_at(F.create_map(*[F.lit(x).cast("long") for b in parts.items() for x in b]), F.col("doc_id"))
        own = F.coalesce(part(k) + 1, own)  # after the larger ids below the next bound
    place = (F.lit(len(bounds)) - F.greatest(_at(bounds), F.lit(1))).cast("long") if bounds else F.lit(0).cast("long")
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) * most).cast("long") + part(F.lit(nulls).cast("long"))).otherwise(place * most + own)


def with_next(docs: DataFrame, finish) -> DataFrame:
    """Documents in descending order of id with columns of the next one; after the last comes the first.

    docs has doc_id and text.  ``finish(frame, following)`` gets the frame with doc_id, text and next_text, and a function that
    gives the value of an expression on ``text`` for the next document; it returns the columns to select.  Equal ids are ordered
    by a hash of the text and the text, null ids come last.

    The texts move once, to buckets of neighbouring ids; what follows a bucket is looked up in the table of the buckets' first
    documents, of which there are no more than about twice MOST_BUCKETS.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    bucket = _bucket(docs.select("doc_id"))
    docs = docs.withColumn("bucket", bucket)
    # The first document of each bucket, without its text, then its text.
    tops = materialize(docs.groupBy("bucket").agg(F.min(_order()).alias("top")), "tops")
    heads = docs.withColumn("top", _order()).join(F.broadcast(tops), ["bucket", "top"])
    heads = heads.groupBy("bucket").agg(F.min("text").alias("head"))
    after = F.lead("bucket").over(Window.orderBy("bucket"))
    follows = tops.select("bucket", F.coalesce(after, F.min("bucket").over(Window.partitionBy())).alias("following"))
    heads = follows.join(heads.withColumnRenamed("bucket", "following"), "following").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie", "text")
    frame = docs.withColumn("is_last", F.lead(F.lit(False), 1, True).over(w)).withColumn("next_text", F.lead("text").over(w))
    frame = frame.join(heads, "bucket").withColumn("next_text", F.when(F.col("is_last"), F.col("head")).otherwise(F.col("next_text")))
    return finish(frame, w)


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) characters replaced by as many first ones (or all) of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles and in_edited (containment of the text in the edited one) per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def finish(frame: DataFrame, w) -> DataFrame:
        frame = frame.withColumn("edited", edited(F.col("text"), F.col("next_text")))
        sketched = frame.select("bucket", "doc_id", "tie", "text", "is_last", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("a"), sketch(F.col("edited"), k).alias("e"), F.when(F.col("is_last"), sketch(F.col("head"), k)).alias("h"))
        sketched = sketched.withColumn("n", F.when(F.col("is_last"), F.col("h")).otherwise(F.lead("a").over(w)))
        return sketched.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("e"), k).alias("near_edited"), resemblance(F.col("a"), F.col("n"), k).alias("near_next"), distinct_shingles(F.col("a"), k).alias("distinct_shingles"), containment(F.col("a"), F.col("e"), k).alias("in_edited"))

    return with_next(docs, finish)
