"""Fill-in-the-middle: a text's prefix, middle and suffix in the order prefix-suffix-middle (psm) or suffix-prefix-middle (spm).

A text is cut between units: a run of ASCII letters is one unit, any other code point is one by itself.  Units are never listed.
The texts of a batch are encoded as maximal runs of the two classes, with the units and the code points before each run; a cut
after so many units is found by a binary search for its run and the rest of it, which is so many code points into a run of
others, and none into a run of letters.  Cuts, form and order are drawn from a hash of the document's id, so reruns agree.

Only the three numbers of a document come back from Python: output and restored text are made of column expressions.

Null texts count as empty.  Empty texts, texts that hold a marker, and a share of all others stay plain.  Rows are documents: those
with equal ids draw the same numbers; a null id has no digits, so its draws are those of the seed alone.  Other columns stay, but
for older ones of the names made here, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import free_name, give_back, slices, small_batches

#: Prefix, suffix and middle begin with these; no text that holds one of them is cut.
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many may be cut, and of those so many are spm.
CUT_SHARE, SPM_SHARE = 90, 20
CUTS = "n long, prefix_chars long, middle_chars long"


class Runs:
    """Texts, one after the other, as runs of letters and of other code points."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (points | 32) - np.uint32(97) < 26  # of ASCII; others wrap around or are too large
        begins = np.cumsum(size) - size
        first = np.ones(len(points), bool)
        np.not_equal(letter[1:], letter[:-1], out=first[1:])
        first[begins[size > 0]] = True
        self.chars = np.append(np.flatnonzero(first), len(points))  # code points before each run, and before the end
        self.letters = np.append(letter[self.chars[:-1]], True)
        units = np.where(self.letters[:-1], 1, np.diff(self.chars))
        self.units = np.append(0, np.cumsum(units))  # units before each run, and before the end
        run = np.searchsorted(self.chars, np.append(begins, len(points)))
        self.begins, self.unit_begins = begins, self.units[run[:-1]]
        self.n = self.units[run[1:]] - self.unit_begins

    def chars_before(self, cut: np.ndarray) -> np.ndarray:
        """Code points in the first ``cut`` units of each text."""
        at = self.unit_begins + cut
        run = np.searchsorted(self.units, at, side="right") - 1  # all units of the runs before it are in
        return self.chars[run] + np.where(self.letters[run], 0, at - self.units[run]) - self.begins


def with_cuts(docs: DataFrame, first: Column, second: Column, text: Column, out: str) -> DataFrame:
    """``docs`` with the struct ``out``: n units, code points of the prefix and of the middle; cuts after first % (n + 1) and second % (n + 1) units."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(CUTS)
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for one, two, text in batches:
            done, parts = 0, []
            for part in slices(text.tolist()):
                runs, at = Runs(part), slice(done, done + len(part))
                a, b = one.to_numpy(np.int64)[at] % (runs.n + 1), two.to_numpy(np.int64)[at] % (runs.n + 1)
                low, high = runs.chars_before(np.minimum(a, b)), runs.chars_before(np.maximum(a, b))
                parts.append(np.stack([runs.n, low, high - low], axis=1))
                done += len(part)
            rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            yield pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"])
        give_back()

    return docs.withColumn(out, find.asNondeterministic()(first, second, text))


def _number(digest: Column, group: int) -> Column:
    """The group-th eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    cuts, text, digest, form = (free_name(n, docs) for n in ("__cuts", "__text", "__digest", "__form"))
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    rows = docs.select("*", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256).alias(digest))
    rows = with_cuts(rows, _number(F.col(digest), 0), _number(F.col(digest), 1), F.col(text), cuts)
    marked = F.lit(False)
    for x in MARKERS:
        marked = marked | F.contains(F.col(text), F.lit(x))
    plain = (F.col(text) == "") | marked | (_number(F.col(digest), 2) % 100 >= CUT_SHARE)
    rows = rows.withColumn(form, F.when(plain, "plain").when(_number(F.col(digest), 3) % 100 < SPM_SHARE, "spm").otherwise("psm"))
    p, m = F.col(f"{cuts}.prefix_chars").cast("int"), F.col(f"{cuts}.middle_chars").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    begin, then, last = map(F.lit, MARKERS)
    output = F.when(F.col(form) == "psm", F.concat(begin, prefix, then, suffix, last, middle)).when(F.col(form) == "spm", F.concat(then, suffix, begin, prefix, last, middle)).otherwise(F.col(text))
    chars = [F.when(F.col(form) != "plain", F.col(f"{cuts}.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select(*keep, F.col(f"{cuts}.n").alias("n"), F.col(form).alias("form"), *chars, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made of."""
    part = F.split(output, "|".join(MARKERS))  # nothing, then the three parts in their order; of texts without markers only
    first, second, third = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def digests(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it."""
    rows = transform(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), seed)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by lists of units.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR {' OR '.join(f"contains(text, '{m}')" for m in MARKERS)} OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
