"""What is predicted, and the job that trains all of it: eligibility, selection, hold-out, calibration, champions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning


@dataclass(frozen=True)
class Target:
    """kind: probability, count or regression; predictions stay within [low, high]."""

    kind: str
    metric: str
    low: float = 0.0
    high: float | None = None


# The targets' names, kinds, metrics and bounds.
TARGETS: dict[str, Target] = {
    "start_probability": Target("probability", "log_loss", 0, 1),
    "appearance_probability": Target("probability", "log_loss", 0, 1),
    "expected_minutes": Target("regression", "mae", 0, 130),
    "goal_probability": Target("probability", "log_loss", 0, 1),
    "expected_goals": Target("count", "poisson_deviance", 0),
    "assist_probability": Target("probability", "log_loss", 0, 1),
    "expected_assists": Target("count", "poisson_deviance", 0),
    "team_goals": Target("count", "poisson_deviance", 0),
    "team_goals_conceded": Target("count", "poisson_deviance", 0),
    "clean_sheet_probability": Target("probability", "log_loss", 0, 1),
    "goalkeeper_saves": Target("count", "poisson_deviance", 0),
    "goalkeeper_goals_conceded": Target("count", "poisson_deviance", 0),
    "yellow_card_probability": Target("probability", "log_loss", 0, 1),
    "red_card_probability": Target("probability", "log_loss", 0, 1),
    "penalty_involvement": Target("probability", "log_loss", 0, 1),
    "base_rating": Target("regression", "mae", 0, 10),
}

REPORT = "target string, kind string, state string, reason string, rows bigint, features array<string>, candidate string, metric string, loss double, baseline_loss double"


@dataclass(frozen=True)
class Trained:
    target: str
    definition: Target
    features: list[str]
    selection: learning.Selection


def train_all(examples: DataFrame, features: Sequence[str], period: str, labels: Mapping[str, str], group: str | None = None, least_rows: int = 100, least_periods: int = 4, least_coverage: float = 0.05, targets: Mapping[str, Target] = TARGETS, **arena) -> tuple[list[Trained], DataFrame]:
    """The models of all targets that have enough labelled rows, and a report with a row for each target.

    labels: target to label column.  A target's features are those that are
    known often enough in its own rows; one that cannot be trained says why and
    stops nothing.  The loop over targets runs on the driver, all work on rows
    in Spark.
    """
    done, said = [], []
    for name, label in labels.items():
        target = targets[name]
        kept, why = learning.trainable(examples, features, label, period, least_rows, least_periods, least_coverage, target.kind == "probability")
        rows = examples.filter(F.col(label).isNotNull())
        n = rows.count()
        if why is not None:
            said.append((name, target.kind, "skipped", why, n, kept, None, target.metric, None, None))
            continue
        if target.kind == "probability":
            found = learning.promote_classifier(rows, kept, label, period, group=group, **arena)
        else:
            found = learning.select_regressor(rows, kept, label, period, target.kind == "count", group=group, low=target.low, high=target.high, **arena)
        done.append(Trained(name, target, kept, found))
        said.append((name, target.kind, "champion" if found.promoted else "baseline", None, n, kept, found.name, target.metric, float(found.holdout["selected"]), float(found.holdout["baseline"])))
    return done, examples.sparkSession.createDataFrame(said, REPORT)


def predictor(trained: Trained) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the target's column, within its bounds."""
    column = "p" if trained.definition.kind == "probability" else "prediction"

    def predict(df: DataFrame) -> DataFrame:
        value = F.greatest(F.col(column), F.lit(float(trained.definition.low)))
        bounded = value if trained.definition.high is None else F.least(value, F.lit(float(trained.definition.high)))
        return trained.selection.predict(df).withColumn(trained.target, bounded).select(*df.columns, trained.target)

    return predict
