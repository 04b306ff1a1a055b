"""Column expressions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringside.schema import CORNERS, FINISHES, METHODS, STANCES

# Methods by the tokens of the CSV files and of the JSON documents.
CSV_METHODS = {
    "Decision - Unanimous": "decision",
    "Decision - Split": "decision",
    "Decision - Majority": "decision",
    "KO/TKO": "ko_tko",
    "TKO - Doctor's Stoppage": "ko_tko",
    "Submission": "submission",
    "DQ": "dq",
    "Overturned": "no_contest",
    "Could Not Continue": "no_contest",
    "Other": "no_contest",
}
JSON_METHODS = {
    "KO/TKO": "ko_tko",
    "TKO": "ko_tko",
    "Submission": "submission",
    "Decision - Unanimous": "decision",
    "Decision - Split": "decision",
    "Decision - Majority": "decision",
    "DQ": "dq",
    "No Contest": "no_contest",
    "Overturned": "no_contest",
}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def corner_order(corner: Column) -> Column:
    """Red before blue."""
    return F.when(corner == CORNERS[0], 0).otherwise(1)


def method_order(method: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), method)


def is_finish(method: Column) -> Column:
    return method.isin(*FINISHES)


def result_of(winner: Column, fighter: Column, method: Column) -> Column:
    """win or loss if there is a winner, else no_contest or draw by the method."""
    return F.when(winner.isNotNull(), F.when(winner == fighter, "win").otherwise("loss")).when(method == "no_contest", "no_contest").otherwise("draw")


def fight_seconds(rnd: Column, ending: Column) -> Column:
    """Length of a bout of five-minute rounds; null if the round or the time is."""
    return (rnd - 1) * 300 + ending


def age_years(on: Column, born: Column) -> Column:
    """Calendar age."""
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.dayofmonth(on) < F.dayofmonth(born)))
    return F.year(on) - F.year(born) - F.when(before, 1).otherwise(0)


def pair_key(event: Column, a: Column, b: Column) -> list[Column]:
    """The key of a bout, whichever corner its fighters have."""
    return [event.alias("event_id"), F.least(a, b).alias("low_id"), F.greatest(a, b).alias("high_id")]


def text_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def int_strict(x: Column) -> Column:
    """Text such as '17.0' as a number, halves to even; empty is null, anything else raises."""
    return F.bround(text_or_null(x).cast("double")).cast("int")


def int_lenient(x: Column) -> Column:
    """As int_strict, but anything else is null."""
    return F.bround(text_or_null(x).try_cast("double")).try_cast("int")


def bool_lenient(x: Column) -> Column:
    return F.when(F.trim(x).isin("1", "1.0"), True).when(F.trim(x).isin("0", "0.0"), False)


def long_date(x: Column, strict: bool = True) -> Column:
    """'March 4, 2023'; empty is null, anything else raises unless lenient."""
    return F.to_date(text_or_null(x), "MMMM d, yyyy") if strict else F.try_to_date(text_or_null(x), "MMMM d, yyyy")


def short_date(x: Column) -> Column:
    """'Mar 4, 2023'; empty is null, anything else raises."""
    return F.to_date(text_or_null(x), "MMM d, yyyy")


def stance_of(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).isin(*STANCES), F.lower(F.trim(x)))


def method_of(token: Column, methods: dict[str, str]) -> Column:
    """By token; an unknown or missing one is a no contest."""
    table = F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.trim(token), F.lit(""))), F.lit("no_contest"))


def _checked(x: Column, pattern: str, value: Column, what: str) -> Column:
    return F.when(x.isNull(), None).when(~x.rlike(pattern), F.raise_error(F.concat(F.lit(f"not {what}: "), x)).cast("int")).otherwise(value)


def parse_stat(x: Column) -> Column:
    """'66 of 125' as struct(landed, attempted); blank gives nulls, anything else raises."""
    t, p = text_or_null(x), r"^(\d+)\s+of\s+(\d+)$"
    part = lambda i: _checked(t, p, F.regexp_extract(t, p, i).try_cast("int"), "landed of attempted")
    pair = lambda a, b: F.struct(a.alias("landed"), b.alias("attempted"))
    # Texts as stat_text() writes them take no pattern.  One conditional gives both numbers, so generated code has it once for each pair and
    # stays small enough to be compiled.
    a, b = (F.substring_index(x, " ", i).try_cast("int") for i in (1, -1))
    return F.when((a >= 0) & (b >= 0) & (stat_text(a, b) == x), pair(a, b)).otherwise(pair(part(1), part(2)))


def parse_clock(x: Column) -> Column:
    """'7:13' as seconds; blank and '--' are null, anything else raises."""
    t, p = F.nullif(text_or_null(x), F.lit("--")), r"^(\d+):([0-5]\d)$"
    return _checked(t, p, F.regexp_extract(t, p, 1).try_cast("int") * 60 + F.regexp_extract(t, p, 2).try_cast("int"), "minutes and seconds")


def stat_text(landed: Column, attempted: Column) -> Column:
    """The inverse of parse_stat; null unless both are known."""
    return F.when(landed.isNotNull() & attempted.isNotNull(), F.concat(landed.cast("string"), F.lit(" of "), attempted.cast("string")))


def clock_text(seconds: Column) -> Column:
    """The inverse of parse_clock."""
    rest = (seconds % 60).cast("int")
    two = F.concat(F.when((rest >= 0) & (rest < 10), F.lit("0")).otherwise(F.lit("")), rest.cast("string"))
    return F.concat(F.floor(seconds / 60).cast("int").cast("string"), F.lit(":"), two)


def event_slug(name: Column) -> Column:
    """'ufc-300' for a numbered event, else null."""
    n = F.regexp_extract(name, r"(?i)^\s*UFC\s+(\d+)\b", 1)
    return F.when(n != "", F.concat(F.lit("ufc-"), n))


def share(part: Column, parts: list[Column]) -> Column:
    """A part over the sum of all; a null part counts as 0, and so does a sum of 0 give null."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return ratio(part, total)
