"""Texts for display.  A dash or 'sem dado' stands for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH, NO_DATA = "—", "sem dado"
#: Labels of methods, stances and results.
METHOD_LABELS = {"ko_tko": "KO/TKO", "submission": "Finalização", "decision": "Decisão", "dq": "Desqualificação", "no_contest": "No contest"}
STANCE_LABELS = {"orthodox": "Ortodoxa", "southpaw": "Canhota", "switch": "Alternada"}
WON, LOST, WITHOUT_RESULT = "Vitória", "Derrota", "Sem resultado"


def label(x: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), x), F.lit(DASH))


def duration(seconds: Column) -> Column:
    return F.when(seconds.isNull(), DASH).otherwise(F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int")))


def ending_time(rnd: Column, seconds: Column) -> Column:
    text = F.format_string("R%d %d:%02d", rnd, F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))
    return F.when(rnd.isNull() | seconds.isNull(), DASH).otherwise(text)


def day(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "dd/MM/yyyy"), F.lit(DASH))


def half_up(x: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def average(x: Column) -> Column:
    """One decimal, after a comma; a dash for none."""
    shown = F.replace(half_up(x, 1).cast("decimal(20,1)").cast("string"), F.lit("."), F.lit(","))
    return F.when(x.isNull() | F.isnan(x), DASH).otherwise(shown)


def percent(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), NO_DATA).otherwise(F.concat(half_up(x * 100).cast("long").cast("string"), F.lit("%")))


def record(wins: Column, losses: Column, draws: Column) -> Column:
    return F.concat_ws("-", wins, losses, draws)


def attempts(landed: Column, attempted: Column) -> Column:
    text = F.concat(F.coalesce(landed.cast("string"), F.lit(DASH)), F.lit(" de "), F.coalesce(attempted.cast("string"), F.lit(DASH)))
    return F.when(landed.isNull() & attempted.isNull(), DASH).otherwise(text)


def probability(p: Column) -> Column:
    """A percentage of a number put between 0 and 1; what is no number is 0."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0))))
    return F.concat(half_up(inside * 100).cast("long").cast("string"), F.lit("%"))


def result(won: Column, method: Column) -> Column:
    return F.when(won, WON).when(method == "no_contest", WITHOUT_RESULT).otherwise(LOST)


def centimetres(x: Column) -> Column:
    return F.coalesce(F.concat(x.cast("string"), F.lit(" cm")), F.lit(DASH))


def kilograms(x: Column) -> Column:
    """One decimal after a comma, none for a whole number."""
    rounded = half_up(x, 1)
    shown = F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(F.replace(rounded.cast("decimal(20,1)").cast("string"), F.lit("."), F.lit(",")))
    return F.coalesce(F.concat(shown, F.lit(" kg")), F.lit(DASH))


def average_control(seconds: Column) -> Column:
    """Minutes and seconds of an average, to the whole second."""
    return duration(half_up(seconds).cast("long"))
