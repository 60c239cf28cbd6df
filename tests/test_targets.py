"""The training job over targets, calibration on rows of its own, and lenient numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.functions import scalars
from kairoframe.operators import learning, targets


@pytest.fixture(scope="module")
def examples(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(1000):
        x, z = draw.normal(), draw.normal()
        rows.append((i, 2018 + i % 5, float(x), None if i % 9 == 0 else float(z), int(draw.random() < 1 / (1 + np.exp(-2 * x))), float(draw.poisson(np.exp(0.3 + 0.7 * x))), float(20 + 20 * z + draw.normal()), None, 1 if i < 50 else None, "g" + str(i % 2)))
    return spark.createDataFrame(rows, "id int, season int, x double, z double, start int, goals double, minutes double, nothing double, few int, side string")


def test_all_targets_are_trained_or_say_why(examples):
    """Bounds hold, features are those that are known, and what cannot be trained says why; a value below zero is no count.

    The logistic model's penalty shrinks so strong a signal: it is sharper than the prior but worse calibrated, and refused.
    """
    sides = ({"start_probability": "start", "base_rating": "nothing", "red_card_probability": "few"}, ("logistic",)), ({"expected_goals": "goals", "expected_minutes": "minutes"}, ("linear", "poisson"))
    runs = [targets.train_all(examples, ["x", "z", "nothing"], "season", labels, "side", kinds=kinds) for labels, kinds in sides]
    said = {r.target: r for _, report in runs for r in report.collect()}
    assert {t: r.state for t, r in said.items()} == {"start_probability": "baseline", "expected_goals": "champion", "expected_minutes": "champion", "base_rating": "skipped", "red_card_probability": "skipped"}
    assert said["base_rating"].reason and said["red_card_probability"].reason == "too few rows" and said["expected_minutes"].candidate == "linear"
    assert all(said[t].loss < said[t].baseline_loss and said[t].features == ["x", "z"] for t in ("expected_goals", "expected_minutes"))
    assert said["start_probability"].loss == said["start_probability"].baseline_loss and runs[0][0][0].selection.scores["logistic"] < runs[0][0][0].selection.scores["baseline"]
    for trained in [t for done, _ in runs for t in done]:
        out = targets.predictor(trained)(examples)
        low, high = out.agg(F.min(trained.target), F.max(trained.target)).first()
        assert low >= trained.definition.low and (trained.definition.high is None or high <= trained.definition.high)
        assert out.count() == 1000 and out.columns == [*examples.columns, trained.target]


def test_the_bending_calibrator_has_no_edge(spark):
    """Well calibrated probabilities: an isotonic curve fits its own rows better, but is not chosen."""
    draw = np.random.default_rng(5)
    p = draw.uniform(0.02, 0.98, 1200)
    df = spark.createDataFrame([(int(i), float(q), int(draw.random() < q)) for i, q in enumerate(p)], "id int, p double, y int")
    kind, apply = learning.calibrate(df, "y", order=F.col("id"))
    assert kind in ("identity", "platt")
    bent = df.withColumn("p", F.col("p") * F.col("p") * F.col("p"))
    kind, apply = learning.calibrate(bent, "y", order=F.col("id"))
    assert kind != "identity" and apply(bent).agg(F.avg(F.abs(F.col("calibrated") - F.pow("p", F.lit(1 / 3))))).first()[0] < 0.08


def test_a_regressor_without_labels_says_so(spark):
    with pytest.raises(ValueError, match="no row has the label y"):
        learning.fit_regressor(spark.createDataFrame([(1.0, None)], "x double, y double"), ["x"], "y")


def test_numbers_with_marks_of_thousands(spark):
    texts = ["1.234,5", "1,234.5", "55%", " 7 ", "3,5", "1.5", "-1.234.567,25", "x", "", None, "1,2,3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.number(F.col("t"))).collect()]
    assert got == [1234.5, 1234.5, 55.0, 7.0, 3.5, 1.5, -1234567.25, None, None, None, None]
