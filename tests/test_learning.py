"""Learning on small made-up rows, calibration, and the registry of models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import learning as L
from kairoframe.operators import metrics as M
from kairoframe.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    out = []
    for season in range(4):
        for _ in range(2500):
            x = float(rng.normal())
            out.append((season, x if rng.random() > 0.1 else None, "n/a" if rng.random() < 0.1 else str(round(rng.normal(), 3)), int(rng.random() < 1 / (1 + np.exp(-2 * x)))))
    return spark.createDataFrame(out, "season int, x double, noise string, label int")


def test_a_real_signal_beats_the_prior_and_noise_does_not(rows):
    best, scores = L.select_classifier(rows, ["x", "noise"], "label", "season", kinds=("logistic",))
    assert best == "logistic" and scores["logistic"]["log_loss"] < scores["baseline"]["log_loss"]
    best, _ = L.select_classifier(rows, ["noise"], "label", "season", kinds=("logistic",))
    assert best == "baseline"


def test_calibration_does_not_worsen_the_loss(rows):
    skewed = rows.filter("x IS NOT NULL").withColumn("p", 1 / (1 + F.exp(-6 * F.col("x"))))
    kind, apply = L.calibrate(skewed, "label")
    y = F.col("label").cast("double")
    before, after = skewed.agg(M.log_loss(y, F.col("p"))).first()[0], apply(skewed).agg(M.log_loss(y, F.col("calibrated"))).first()[0]
    assert kind in ("platt", "isotonic") and after < before


def test_champion_round_trip(spark, rows, tmp_path):
    model = L.fit_classifier(rows, ["x"], "label")
    folder = f"file://{tmp_path}"
    sinks.register_model(model, spark, folder, "starts", {"log_loss": 0.5}, champion=True)
    again = sinks.load_champion(spark, folder, "starts")
    one, two = (L.probabilities(m, rows, ["x"]).agg(F.sum("p")).first()[0] for m in (model, again))
    assert one == pytest.approx(two)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1)], "y int, p double")
    assert M.calibration_error(df, "y", "p").first()[0] == pytest.approx((2 * abs(0.9 - 0.5) + abs(0.1 - 1)) / 3)
    assert M.average_precision(df, "y", "p").first()[0] == pytest.approx((1 * 0.5 + 1 * 2 / 3) / 2)
    e = spark.createDataFrame([(float(i),) for i in range(1, 11)], "e double")
    assert M.conformal_radius(e, F.col("e")).first()["radius"] == 10.0  # level 0.9 of ten: index ceil(8.1) = 9
    assert M.bootstrap_mean(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "w int, v double"), "w", "v", 200).first()["mean"] == 4.0
