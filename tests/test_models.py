"""Decisions against brute force, simulation against its laws, sinks there and back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import decision as D
from kairoframe.operators import quality as Q
from kairoframe.operators import relational as R
from kairoframe.operators import simulation as X
from kairoframe.operators.learning import fit_negative_binomial
from kairoframe.plans import modelling
from kairoframe.sources import sinks, tables


def test_assignment_is_the_best(spark):
    rng = np.random.default_rng(1)
    slots = ("GK", "DEF", "MID")
    for _ in range(20):
        points = rng.normal(size=6).round(2)
        roles = [tuple(rng.choice(slots, size=rng.integers(1, 3), replace=False)) for _ in range(6)]
        found = D.best_lineup(points, roles, {"x": slots})
        brute = D.exhaustive(points, roles, slots)
        assert (found is None) == (brute < D.FORBIDDEN / 2)
        if found:
            assert found[2] == pytest.approx(brute)


def test_substitutions_respect_order_and_limit():
    points = np.array([[5.0, 6.0, 7.0, 8.0]])
    appeared = np.array([[False, True, True, True]])
    roles = ["MID", "MID", "MID", "FWD"]
    assert D.scenario_points(points, appeared, roles, [0, 1], [2, 3], [{"MID": 2}]) == 13.0
    assert D.scenario_points(points, appeared, roles, [0, 1], [2, 3], [{"MID": 2}], limit=0) == 6.0
    assert D.scenario_points(points, appeared, roles, [0, 1], [3, 2], [{"MID": 1, "FWD": 1}, {"MID": 2}]) == 14.0


def test_shared_minutes_add_up():
    rng = np.random.default_rng(2)
    raw, mask = rng.normal(60, 30, (200, 16)).clip(1, 90), np.zeros((200, 16), bool)
    mask[:, :13] = True
    m = X.shared_minutes(raw, mask)
    assert (m.sum(axis=1) == 900).all() and (m[:, 13:] == 0).all() and m[mask].min() >= 1 and m.max() <= 90


def test_simulation_keeps_its_laws(spark, sf):
    for row in modelling.simulation_conservation(spark, sf).collect():
        assert (row["wrong_minutes"], row["wrong_keepers"], row["wrong_goals"], row["runs"]) == (0, 0, 0, 1000)


def test_simulation_repeats_and_means_are_right(spark, sf):
    fixtures, players = modelling.squads(spark, sf)
    one = X.simulate(fixtures, players, 400, 100, 7).groupBy("side").agg(F.sum("goals").alias("g"), F.sum("own_goals").alias("o")).orderBy("side").collect()
    assert one == X.simulate(fixtures, players, 400, 100, 7).groupBy("side").agg(F.sum("goals").alias("g"), F.sum("own_goals").alias("o")).orderBy("side").collect()
    runs = 400 * fixtures.count()
    away, home = one
    assert (home["g"] + away["o"]) / runs == pytest.approx(1.5, abs=0.15)
    assert X.problems(players).count() == 0


def test_negative_binomial_recovers_a_slope():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 1))
    mu = np.exp(0.5 + 0.7 * x[:, 0])
    y = rng.poisson(mu * rng.gamma(1 / 0.4, 0.4, 4000))
    w, alpha = fit_negative_binomial(x, y.astype(float), l2=1e-6)
    assert w == pytest.approx([0.7, 0.5], abs=0.08) and alpha == pytest.approx(0.4, abs=0.15)


def test_legal_rosters_equal_trying_all_placements(spark):
    from itertools import product

    rng = np.random.default_rng(6)
    slots, rows, want = {"A": 1, "B": 2, "C": 1}, [], {}
    for team in range(120):
        players = [sorted(rng.choice(list("ABCD"), rng.integers(0, 3), replace=False)) for _ in range(rng.integers(1, 6))]
        rows += [(team, [str(r) for r in roles]) for roles in players]
        want[team] = any(all(p.count(r) <= n for r, n in slots.items()) for p in product(*players))
    got = {r.team: r.legal for r in Q.legal_rosters(spark.createDataFrame(rows, "team int, roles array<string>"), slots).collect()}
    assert got == want and 10 < sum(want.values()) < 110


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    m = sinks.write_snapshot(df, f"file://{tmp_path}", "s", "1")
    assert sinks.write_snapshot(df.orderBy(F.desc("id")), f"file://{tmp_path}", "s", "1")["digest"] == m["digest"]
    assert sinks.read_snapshot(spark, m).count() == 2
    df.limit(1).write.mode("overwrite").parquet(m["path"])
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_snapshot(spark, m)


def test_merge_guard_delete_and_raw(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    sinks.merge_into(spark, folder, spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, at int, v string"), ["k"], "at")
    sinks.merge_into(spark, folder, spark.createDataFrame([(1, 4, "late"), (2, 6, "new"), (3, 1, "new")], "k int, at int, v string"), ["k"], "at")
    assert sorted((r.k, r.v) for r in sinks.current(spark, folder).collect()) == [(1, "old"), (2, "new"), (3, "new")]
    sinks.delete_where(spark, folder, F.col("k") == 2)
    assert sorted(r.k for r in sinks.current(spark, folder).collect()) == [1, 3]
    raw = spark.createDataFrame([("p", "9596", "x"), ("p", "9596", "x"), ("q", "9596", "x")], "provider string, season string, content string")
    assert sinks.write_raw(raw, f"file://{tmp_path}/raw").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Home,Away,Score\nx,y,1\n,z,2\n", encoding="utf-8")
    assert [tuple(r) for r in tables.results_csv(spark, f"file://{tmp_path}/a.csv", ["Home"], {"Score": "score"}).collect()] == [("x", "y", "1")]
    (tmp_path / "r.txt").write_text("name;role;team\nAnna;P;T\nBo\tD\tU\n\nCy,A\n")
    assert [tuple(r) for r in tables.delimited_text(spark, f"file://{tmp_path}/r.txt", ["name", "role", "team"]).collect()] == [("Anna", "P", "T"), ("Bo", "D", "U"), ("Cy", "A", None)]
    (tmp_path / "n.json").write_text(json.dumps({"rows": [{"id": 1, "odds": [{"v": 2.5}, {"v": 3.5}]}, {"id": 2, "odds": []}]}))
    nested = tables.nested_json(spark, f"file://{tmp_path}/n.json", "rows array<struct<id: int, odds: array<struct<v: double>>>>", ["rows", "odds"])
    assert nested.count() == 3
    with pytest.raises(ValueError, match="missing columns: zz"):
        tables.require(nested, ["zz"])


def test_upsert_and_pages(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    assert sorted(tuple(r) for r in R.upsert(a, spark.createDataFrame([(2, 9), (3, 3)], "k int, v int"), ["k"]).collect()) == [(1, 1), (2, 9), (3, 3)]
    assert [tuple(r) for r in R.page(a, [F.col("k")], 1, 5).collect()] == [(2, 2, 2)]
    assert R.evenly_spaced(spark.range(100).toDF("k"), [F.col("k")], 3).orderBy("k").collect()[1][0] in (49, 50)


def test_many_line_ups_are_valued_as_one_by_one():
    rng = np.random.default_rng(12)
    roles = [str(r) for r in rng.choice(["GK", "DEF", "MID", "XX"], 9)]
    points, appeared = rng.integers(-4, 20, (60, 9)) / 2, rng.random((60, 9)) < 0.7
    formations = [{"GK": 1, "DEF": 2, "MID": 2}, {"DEF": 3, "MID": 2}, {"GK": 1, "DEF": 1, "MID": 3}]
    lineups = np.array([sorted(rng.choice(9, 5, replace=False)) for _ in range(40)])
    benches = np.array([rng.permutation([i for i in range(9) if i not in x]) for x in lineups])
    for limit in (0, 2, 5):
        got = D.lineups_points(points, appeared, roles, lineups, benches, formations, limit)
        assert (got == [D.scenario_points(points, appeared, roles, list(x), list(b), formations, limit) for x, b in zip(lineups, benches, strict=True)]).all()


def test_minutes_are_those_of_a_bisection():
    rng = np.random.default_rng(13)
    raw, mask = rng.normal(60, 30, (300, 16)).clip(1, 90), rng.random((300, 16)) < 0.8
    mask[:, :10] = True
    down, up = np.full(300, -200.0), np.full(300, 200.0)
    for _ in range(60):
        mid = (down + up) / 2
        over = np.where(mask, np.clip(raw + mid[:, None], 1, 90), 0).sum(axis=1) > 900
        up, down = np.where(over, mid, up), np.where(over, down, mid)
    exact = np.where(mask, np.clip(raw + down[:, None], 1, 90), 0)
    m = X.shared_minutes(raw, mask)
    assert (m.sum(axis=1) == 900).all() and (abs(m - exact) < 1 + 1e-9).all()
    mask[:] = False
    mask[:, 3:13] = True
    assert (X.shared_minutes(raw, mask)[:, 3:13] == 90).all()


def test_summaries_of_blocks_are_those_of_the_samples(spark, sf):
    fixtures, players = modelling.squads(spark, sf)
    samples = X.simulate(fixtures, players, 90, 40, 7)
    want = sorted(map(tuple, X.summarize(samples).collect()))
    blocks = X.simulate_summaries(fixtures, players, 90, 40, 7)
    assert sorted(map(tuple, blocks.collect())) == want
    rows = X.team_samples(fixtures, players, lambda mine: mine["goals"] * 1.0, 90, 40, 7)
    assert rows.count() == 3 * players.count()  # blocks, not runs
    assert sum(sum(r.points) for r in rows.collect()) == samples.agg(F.sum("goals")).first()[0]
