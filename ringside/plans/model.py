"""Winner model: dataset, temporal split, training, metrics and prediction.

The model is a histogram booster that learns where missing values go (boosting.py).  It grows by level, in fewer and larger steps and with
fewer bins than is usual on one machine, so predictions are not expected to be equal to those of any other library.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.functions.expr import ratio
from ringside.operators.prefix import running_sums
from ringside.plans import boosting
from ringside.plans.boosting import Booster
from ringside.plans.features import add_features
from ringside.plans.longframe import long_frame, round_rows
from ringside.plans.matchup import TARGET, Matrix, add_differentials, pivot_corners
from ringside.schema import Tables
from ringside.sources.scratch import cut, stored

log = logging.getLogger(__name__)

TEST_SHARE = 0.2
#: Probabilities are kept this far from 0 and 1 in the log-loss.
CLIP = 2.220446049250313e-16


def dataset(frame: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """(bout_id, event_date, label, features as doubles), and the features left: numbers with at least one value.

    One aggregation over all columns finds those without any, whose names are logged.
    """
    kinds = {f.name: f.dataType for f in frame.schema}
    numeric = [c for c in features if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    label = F.when(F.col(TARGET) == "R", 1.0).when(F.col(TARGET) == "B", 0.0).otherwise(F.raise_error(F.lit("unknown winner")).cast("double"))
    rows = frame.filter(F.col(TARGET).isNotNull()).select("bout_id", F.col("event_date_a").alias("event_date"), label.alias("label"), *[F.col(c).cast("double").alias(c) for c in numeric])
    counts = rows.agg(*[F.count(c).alias(c) for c in numeric]).first()
    kept = [c for c in numeric if counts[c]]
    if dropped := [c for c in numeric if not counts[c]]:
        log.warning("features without any value are left out: %s", ", ".join(dropped))
    return rows.select("bout_id", "event_date", "label", *kept), kept


def live_dataset(m: Matrix) -> tuple[DataFrame, list[str]]:
    """dataset() of a matrix, whose numbers of both corners are written to the shared folder once; differences are made as they are read."""
    kinds = {f.name: f.dataType for f in m.frame.schema}
    sides = [c for c in m.features if not c.endswith("_diff") and isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    frame = add_differentials(cut(m.frame.select("bout_id", "event_date_a", TARGET, *sides)))
    return dataset(frame, [c for c in m.features if c in frame.columns])


def read_bout_features(stored: DataFrame, bouts: DataFrame, events: DataFrame) -> DataFrame:
    """(bout_id, event_date, target_winner_corner, features): stored features, as text, of known bouts with their events' dates."""
    return with_dates(stored, bouts, events).select("bout_id", "event_date", "target_winner_corner", "features")


def with_dates(rows: DataFrame, bouts: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of known bouts with event_date.  All columns of the rows move by bout, so texts are better read before."""
    dates = bouts.select(F.col("id").alias("bout_id"), "event_id").join(events.select(F.col("id").alias("event_id"), F.col("date").alias("event_date")), "event_id")
    return rows.join(dates, "bout_id")


def expand(raw: DataFrame, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """The features as columns beside the other ones, read by their schema (or that of some of them), or by what one pass over the texts finds in
    them: numbers, truth values, texts."""
    if schema is None:
        kinds = F.explode(F.map_entries(F.from_json("features", "map<string,string>"))).alias("e")
        number = F.col("e.value").isNull() | F.col("e.value").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")
        truth = F.col("e.value").isNull() | F.col("e.value").isin("true", "false")
        found = raw.select(kinds).groupBy("e.key").agg(F.bool_and(number).alias("number"), F.bool_and(truth & F.col("e.value").isNotNull()).alias("truth")).orderBy("key").collect()  # a row per feature
        schema = T.StructType([T.StructField(r["key"], T.BooleanType() if r["truth"] else T.DoubleType() if r["number"] else T.StringType()) for r in found])
    names = [f.name for f in schema]
    rows = raw.withColumn("__f", F.from_json("features", schema))
    return rows.select(*[c for c in ("bout_id", "event_date", "target_winner_corner") if c in raw.columns], *[F.col(f"__f.`{n}`").alias(n) for n in names]), names


def stored_dataset(raw: DataFrame, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """dataset() of stored features: decided bouts, numbers only, without features that are always missing."""
    rows, names = expand(raw.filter("target_winner_corner is not null"), schema)
    winner = F.when(F.col("target_winner_corner") == "red", "R").when(F.col("target_winner_corner") == "blue", "B").otherwise(F.raise_error(F.lit("unknown corner")))
    return dataset(rows.withColumnRenamed("event_date", "event_date_a").withColumn(TARGET, winner), names)


def half_even(x: float) -> int:
    return round(x)


#: Ranges of ids that are counted at a time, and rows that may be put in order in one place.
RANGES, FEW = 1024, 100_000


def _nth_id(ids: DataFrame, n: int) -> int:
    """The n-th smallest bout_id: counted by ranges, and the range that has it by finer ones, until it has few rows or one id."""
    low, high = ids.agg(F.min("bout_id"), F.max("bout_id")).first()
    while True:
        width = max(1, -(-(high - low + 1) // RANGES))
        part = F.floor((F.col("bout_id") - F.lit(low)) / width)
        counts = sorted((r["part"], r["n"]) for r in ids.filter(F.col("bout_id").between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most RANGES rows
        for k, size in counts:
            if n <= size:
                break
            n -= size
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        if low == high:
            return low
        if size <= FEW:
            found = ids.filter(F.col("bout_id").between(low, high)).orderBy("bout_id").limit(n).agg(F.max("bout_id")).first()
            return found[0]


@dataclass(frozen=True)
class Cut:
    """Where the later rows begin: after this date and id."""

    event_date: object
    bout_id: int

    def is_later(self) -> Column:
        day = F.lit(self.event_date)
        return (F.col("event_date") > day) | ((F.col("event_date") == day) & (F.col("bout_id") > F.lit(self.bout_id)))


def temporal_cut(rows: DataFrame, share: float = TEST_SHARE) -> Cut:
    """The last of the earlier rows by date and bout id; the later ones are ``share`` of all, one at least.

    The boundary row is found from counts per date and, within that date, per range of ids, so no task sorts all rows.
    """
    if not 0 < share < 1:
        raise ValueError("the share of test rows is between 0 and 1")
    days = sorted((r["event_date"], r["n"]) for r in rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per date
    total = sum(n for _, n in days)
    n_train = total - max(1, half_even(total * share))
    if n_train <= 0:
        raise ValueError("too few rows to split")
    before, boundary = 0, days[0][0]
    for day, n in days:
        boundary = day
        if before + n >= n_train:
            break
        before += n
    return Cut(boundary, _nth_id(rows.filter(F.col("event_date") == F.lit(boundary)).select("bout_id"), n_train - before))


def temporal_split(rows: DataFrame, share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """The earlier and the later rows; those of the boundary date can be on both sides."""
    later = temporal_cut(rows, share).is_later()
    return rows.filter(~later), rows.filter(later)


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def metrics(scored: DataFrame, label: str = "label", p: str = "probability", prediction: str = "prediction") -> DataFrame:
    """(n, accuracy, log_loss, roc_auc) of binary predictions.

    The area is exact: ranks of equal probabilities are averaged.  Rows are read once and counted per distinct probability; running
    counts over those are made in ranges between sampled quantiles, so tasks are even however probabilities crowd.
    """
    y, q = F.col(label), clipped(F.col(p))
    loss, hit = -(y * F.log(q) + (1 - y) * F.log(1 - q)), (F.col(prediction) == y).cast("long")
    per = scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum(loss).alias("loss"))
    total = running_sums(per, ["p"], ["neg"]).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n", "hits", "loss")], F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("area"))
    return total.select(F.coalesce("n", F.lit(0)).alias("n"), ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(F.col("loss"), F.col("n")).alias("log_loss"), ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("roc_auc"))


def baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics of always saying red, with red's share of the training rows as probability."""
    share = train.agg(F.avg("label").alias("probability"))
    return metrics(test.select("label").crossJoin(F.broadcast(share)).withColumn("prediction", F.lit(1.0)))  # one row


@dataclass(frozen=True)
class Metrics:
    n: int
    accuracy: float
    log_loss: float
    roc_auc: float | None


#: The recorded metrics of the model before the present features, which later ones are compared with.
RECORDED = Metrics(1634, 0.6009791921664627, 0.6860892556792704, 0.6180559786979942)


@dataclass(frozen=True)
class MetricsDelta:
    """Current less reference; of accuracy and area more is better, of log-loss less."""

    accuracy: float
    log_loss: float
    roc_auc: float | None

    @property
    def improves_accuracy(self) -> bool:
        """Only if it is truly above."""
        return self.accuracy > 0.0


def measured(scored: DataFrame) -> Metrics:
    return Metrics(**metrics(scored).first().asDict())


def metrics_delta(current: Metrics, reference: Metrics) -> MetricsDelta:
    area = None if None in (current.roc_auc, reference.roc_auc) else current.roc_auc - reference.roc_auc
    return MetricsDelta(current.accuracy - reference.accuracy, current.log_loss - reference.log_loss, area)


@dataclass
class Winner:
    """A fitted model; what was found when it was trained is kept with it."""

    booster: Booster
    facts: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.booster.features

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with probability (of red) and prediction; features that rows don't have are missing."""
        aligned = rows.select(*[c for c in rows.columns if c not in self.features], *[(F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in self.features])
        return self.booster.probability(aligned).withColumn("prediction", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))

    def save(self, path: str) -> None:
        """One line of text in a folder, which is replaced."""
        text = json.dumps({"model": self.booster.to_json(), "facts": self.facts}, default=str)
        _session().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Winner:
        from pyspark.errors import AnalysisException

        try:
            found = json.loads(_session().read.text(path).first()["value"])
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
        return cls(Booster.from_json(found["model"]), found["facts"])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def train(rows: DataFrame, features: list[str], **options) -> Winner:
    """Boosted trees over the features as they are, missing values included; options are those of boosting.Options."""
    return Winner(boosting.fit(rows, features, "label", boosting.Options(**options)))


@dataclass
class TrainingResult:
    """A trained model, its scored later bouts, and how it does on these beside always saying red."""

    winner: Winner
    scored: DataFrame
    model: Metrics
    baseline: Metrics
    boundary: object
    n_samples: int
    n_train: int
    n_test: int


def run_training(rows: DataFrame, features: list[str], share: float = TEST_SHARE, written: bool = False, **options) -> TrainingResult:
    """Train on the earlier bouts of a dataset and measure on the later ones.  Rows are written to the shared folder once; ``written`` says
    that they come from a table already."""
    rows = rows if written else cut(rows)
    if rows.isEmpty():
        raise ValueError("no decided bouts to learn from")
    where = temporal_cut(rows, share)
    earlier, later = rows.filter(~where.is_later()), rows.filter(where.is_later())
    winner = train(earlier, features, **options)
    scored = stored(winner.score(later).select("bout_id", "event_date", "label", "probability", "prediction"), "scored")
    n_train, n_test = earlier.count(), scored.count()
    model, base = measured(scored), measured_baseline(earlier, later)
    winner.facts = {"metrics": {"model": asdict(model), "baseline": asdict(base)}, "trained_at": datetime.now(UTC).isoformat(), "boundary": str(where.event_date), "n_samples": n_train + n_test, "n_train": n_train, "n_test": n_test, "test_fraction": share}
    return TrainingResult(winner, scored, model, base, where.event_date, n_train + n_test, n_train, n_test)


def measured_baseline(earlier: DataFrame, later: DataFrame) -> Metrics:
    return Metrics(**baseline(earlier, later).first().asDict())


@dataclass(frozen=True)
class TrainingComparison:
    vs_baseline: MetricsDelta
    vs_recorded: MetricsDelta


def compare_training(result: TrainingResult, recorded: Metrics = RECORDED) -> TrainingComparison:
    return TrainingComparison(metrics_delta(result.model, result.baseline), metrics_delta(result.model, recorded))


# ---------------------------------------------------------------- prediction

SYNTHETIC = -1


def hypothetical(t: Tables, a, b, on: str) -> DataFrame:
    """One matchup row for each orientation (red = a, red = b) of a bout that two fighters might have on a day.

    Only the bouts of the two fighters, with all their corners, are read.  The synthetic bout comes after all real bouts of a
    fighter for form and shares; for layoff, experience and rounds it stands by its date, after the real bouts of that day.
    """
    if a == b:
        raise ValueError("two different fighters are needed")
    both = cut(t.bout_fighters.filter(F.col("fighter_id").isin(a, b)).select("bout_id").distinct())
    own = Tables(t.fighters, t.events, t.bouts, cut(t.bout_fighters.join(both, "bout_id", "left_semi")), t.rounds)  # tables of known, small sizes
    frame = long_frame(own)
    pair = t.fighters.filter(F.col("id").isin(a, b)).select(F.col("id").alias("fighter_id"), F.col("name").alias("fighter_name"))
    made = pair.select("fighter_id", "fighter_name", F.lit(SYNTHETIC).cast(frame.schema["bout_id"].dataType).alias("bout_id"), F.lit(on).cast("date").alias("event_date"), F.when(F.col("fighter_id") == a, "red").otherwise("blue").alias("corner"))
    synthetic = F.col("bout_id") == SYNTHETIC
    rows = frame.unionByName(made, allowMissingColumns=True)
    last = [synthetic, F.col("event_date"), F.col("bout_id")]
    dated = [F.col("event_date"), synthetic, F.col("bout_id")]
    enriched = add_features(rows, t.fighters, round_rows(own), order=last, trajectory_order=dated).filter(synthetic)
    swapped = enriched.withColumn("corner", F.when(F.col("corner") == "red", "blue").otherwise("red")).withColumn("bout_id", F.col("bout_id") - 1)
    return add_differentials(pivot_corners(enriched.unionByName(swapped))).withColumn("red_is", F.when(F.col("bout_id") == SYNTHETIC, "a").otherwise("b"))


class UnknownFighter(LookupError):
    """A fighter that isn't in the tables."""


def require_fighters(t: Tables, *fighter_ids) -> None:
    have = {r["id"] for r in t.fighters.filter(F.col("id").isin(*fighter_ids)).select("id").collect()}
    if missing := [f for f in fighter_ids if f not in have]:
        raise UnknownFighter(f"no fighters {missing}")


def require_history(t: Tables, *fighter_ids) -> None:
    have = {r["fighter_id"] for r in t.bout_fighters.filter(F.col("fighter_id").isin(*fighter_ids)).select("fighter_id").distinct().collect()}
    if missing := [f for f in fighter_ids if f not in have]:
        raise ValueError(f"no bouts of {missing}")


def neutral(scored: DataFrame, a, b) -> DataFrame:
    """(fighter_a, fighter_b, probability_a, winner_id): the mean of both orientations; a tie goes to the lower id."""
    p = F.avg(F.when(F.col("red_is") == "a", F.col("probability")).otherwise(1 - F.col("probability")))
    out = scored.agg(p.alias("probability_a")).select(F.lit(a).alias("fighter_a"), F.lit(b).alias("fighter_b"), "probability_a")
    return out.withColumn("winner_id", F.when(F.col("probability_a") > 0.5, F.lit(a)).when(F.col("probability_a") < 0.5, F.lit(b)).otherwise(F.lit(min(a, b))))


def predict_matchup(t: Tables, path: str, a, b, on: str) -> DataFrame:
    """The neutral prediction of the model stored at ``path``.

    Checked in this order: the fighters differ (ValueError), they are known (UnknownFighter), there is a model
    (FileNotFoundError), both have bouts (ValueError).
    """
    if a == b:
        raise ValueError("two different fighters are needed")
    require_fighters(t, a, b)
    return predict(t, Winner.load(path), a, b, on)


def predict(t: Tables, winner: Winner, a, b, on: str) -> DataFrame:
    require_history(t, a, b)
    return neutral(winner.score(hypothetical(t, a, b, on)), a, b)
