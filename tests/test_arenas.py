"""Selection of count and regression models, hurdles, several roles, archives and runs against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import decision as D
from kairoframe.operators import learning as L
from kairoframe.plans import modelling
from kairoframe.sources import sinks


def counts(spark, zeros, n=1600):
    """Counts of mean 1 or 4 by a feature, all zero in a share of the rows; five seasons; a useless feature."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, n)
    y = np.where(rng.random(n) < zeros, 0, rng.poisson(np.where(x == 1, 4.0, 1.0)))
    return spark.createDataFrame([(2000 + i % 5, "ab"[i % 2], float(a), float(i % 7), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "season int, g string, x double, z double, n double")


@pytest.mark.parametrize("zeros", [0.0, 0.5])
def test_hurdle_predicts_the_mean_of_each_group(spark, zeros):
    rows = counts(spark, zeros)
    found = L.fit_regressor(rows, ["x"], "n", "hurdle")(rows).groupBy("x").agg(F.avg("n").alias("y"), F.avg("prediction").alias("p"), F.count_distinct("prediction").alias("k")).collect()
    assert len(found) == 2
    for r in found:
        assert r["k"] == 1 and r["p"] == pytest.approx(r["y"], rel=0.06)


def test_hurdle_of_zeros_and_ones(spark):
    rows = counts(spark, 0.0)
    assert L.fit_hurdle(rows.withColumn("n", F.lit(0.0)), ["x"], "n")(rows).agg(F.max("prediction")).first()[0] == 0
    ones = rows.withColumn("n", (F.col("z") < 1).cast("double"))
    p = L.fit_hurdle(ones, ["x"], "n", least_excess=-1.0)(ones).agg(F.avg("prediction")).first()[0]
    assert p == pytest.approx(ones.agg(F.avg("n")).first()[0], rel=0.05)


def test_a_count_model_wins_where_a_feature_tells(spark):
    rows = counts(spark, 0.0)
    found = L.select_regressor(rows, ["x", "z"], "n", "season", count=True, kinds=("linear", "poisson"), group="g")
    assert found.promoted and found.name in ("linear", "poisson") and found.holdout["selected"] < found.holdout["baseline"]
    assert found.predict(rows).agg(F.min("prediction")).first()[0] >= 0 and found.radius > 0
    nothing = L.select_regressor(rows.withColumn("x", F.lit(1.0)), ["x", "z"], "n", "season", count=True, kinds=("poisson",))
    assert (nothing.name, nothing.promoted) == ("baseline", False)


def test_hold_out_and_groups_stop_a_winner(spark):
    rows = counts(spark, 0.0)
    turned = rows.withColumn("x", F.when(F.col("season") == 2004, 1 - F.col("x")).otherwise(F.col("x")))
    assert L.select_regressor(turned, ["x"], "n", "season", kinds=("linear",)).name == "baseline"
    one_group = rows.withColumn("x", F.when((F.col("season") == 2004) & (F.col("g") == "a"), 1 - F.col("x")).otherwise(F.col("x")))
    found = L.select_regressor(one_group, ["x"], "n", "season", kinds=("linear",), group="g", most_loss=9.0)
    assert found.name == "baseline" and not found.subgroups_passed


def test_classifier_is_held_to_the_last_period(spark):
    rows = counts(spark, 0.0).withColumn("label", (F.col("n") >= 3).cast("int"))
    found = L.promote_classifier(rows, ["x"], "label", "season", kinds=("logistic",), group="g")
    assert found.promoted and found.predict(rows).filter("p < 0 OR p > 1 OR p IS NULL").isEmpty()
    turned = rows.withColumn("label", F.when(F.col("season") == 2004, 1 - F.col("label")).otherwise(F.col("label")))
    assert L.promote_classifier(turned, ["x"], "label", "season", kinds=("logistic",)).name == "baseline"


def test_what_can_be_learned(spark):
    rows = counts(spark, 0.0).withColumn("none", F.lit(None).cast("double"))
    assert L.trainable(rows, ["x", "none"], "n", "season") == (["x"], None)
    assert L.trainable(rows.limit(50), ["x"], "n", "season")[1] == "too few rows"
    assert L.trainable(rows.filter("season < 2003"), ["x"], "n", "season")[1] == "too few periods"
    assert L.trainable(rows.withColumn("n", F.lit(1)), ["x"], "n", "season", binary=True)[1] == "one class"
    assert L.trainable(rows, ["none"], "n", "season")[1] == "no feature with values"


def fits(roles, slots):
    """Whether all can be placed, by trying every arrangement."""
    return any(all(s in r for s, r in zip(order, roles, strict=True)) for order in permutations(slots, len(roles))) if len(roles) <= len(slots) else False


def brute(points, appeared, roles, starters, bench, formations, limit):
    out = []
    for p, a in zip(points, appeared, strict=True):
        on = [i for i in starters if a[i]]
        best = None
        for slots in formations:
            if not fits([roles[i] for i in on], slots):
                continue
            added = []
            for place, i in enumerate(bench):
                if a[i] and len(added) < limit and fits([roles[j] for j in (*on, *(bench[k] for k in added), i)], slots):
                    added.append(place)
            rank = (-len(added), tuple(added))
            if best is None or rank < best[0]:
                best = (rank, sum(p[i] for i in on) + sum(p[bench[k]] for k in added))
        out.append(best[1] if best else 0.0)
    return np.array(out)


def test_several_roles_against_every_arrangement():
    rng = np.random.default_rng(8)
    names = np.array(["A", "B", "C"])
    for _ in range(25):
        roles = [tuple(rng.choice([*names, "X"], size=rng.integers(1, 3), replace=False)) for _ in range(8)]
        points, appeared = rng.normal(6, 2, (30, 8)).round(1), rng.random((30, 8)) < 0.7
        formations = [tuple(rng.choice(names, 4)) for _ in range(3)]
        for limit in (0, 1, 5):
            got = D.multirole_points(points, appeared, roles, [0, 1, 2, 3], [4, 5, 6, 7], formations, limit)
            assert got == pytest.approx(brute(points, appeared, roles, [0, 1, 2, 3], [4, 5, 6, 7], formations, limit))


def test_one_role_is_a_case_of_several(spark):
    rng = np.random.default_rng(9)
    roles = ["A", "A", "B", "B", "A", "B"]
    points, appeared = rng.normal(6, 2, (60, 6)), rng.random((60, 6)) < 0.7
    one = D.scenario_points(points, appeared, roles, [0, 1, 2], [3, 4, 5], [{"A": 2, "B": 1}])
    assert D.multirole_points(points, appeared, [(r,) for r in roles], [0, 1, 2], [3, 4, 5], [("A", "A", "B")]) == pytest.approx(one)


def test_archive_keys_and_damaged_batches(spark, sf, tmp_path):
    fixtures, players = modelling.squads(spark, sf)
    place = str(tmp_path / "archive")
    n = fixtures.count()
    ask = lambda **k: sinks.archived_samples(spark, place, fixtures, players, **({"runs": 20, "block": 10, "seed": 1} | k))
    first, made = ask()
    rows = first.count()
    assert made == n and ask()[1] == 0
    assert ask(seed=2)[1] == n and ask(runs=30)[1] == n
    again, made = ask()
    assert made == 0 and again.count() == rows and again.drop("batch").exceptAll(first.drop("batch")).isEmpty()
    other = players.withColumn("goal_weight", F.when(F.col("match_id") == "match-0", F.col("goal_weight") + 1).otherwise(F.col("goal_weight")))
    assert sinks.archived_samples(spark, place, fixtures, other, 20, 10, 1)[1] == 1
    keys = sinks.forecast_keys(fixtures, players, 20, 10, 9).select("key", F.lit("lost").alias("batch"), F.lit(3).cast("bigint").alias("rows"))
    keys.write.mode("append").parquet(f"{place}/entries")
    assert ask(seed=9)[1] == n


def test_runs_and_jobs(spark, tmp_path):
    place, log = str(tmp_path / "runs"), str(tmp_path / "jobs")
    rows = spark.range(5)
    assert sinks.run_job(spark, log, "a", lambda: sinks.append_run(rows, place, "a"))
    assert sinks.run_job(spark, log, "b", lambda: sinks.append_run(rows, place, "b"))
    assert not sinks.run_job(spark, log, "c", lambda: rows.select("missing").count())
    sinks.append_run(rows.limit(2), place, "b")
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(place).groupBy("run_id").count().collect()} == {("a", 5), ("b", 2)}
    assert [(r.run_id, r.status, r.error is None) for r in spark.read.parquet(log).orderBy("run_id").collect()] == [("a", "succeeded", True), ("b", "succeeded", True), ("c", "failed", False)]
