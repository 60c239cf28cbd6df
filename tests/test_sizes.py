"""Queries against their SQL on tables that are made for the case, and the plans that let them grow."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.functions import scalars
from kairoframe.operators import market, quality, ranks
from kairoframe.plans import catalog
from kairoframe.sources import replay, versions
from kairoframe.sources import tables as tables_source

SOURCE = "/root/testdata/sf0.001"


def tables(folder, **made):
    """A folder with the given tables as SQL over those of sf0.001."""
    db = duckdb.connect()
    for path in Path(SOURCE).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    for name, sql in made.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def same_as_sql(spark, name, folder):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = catalog.queries()[name](spark, folder)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)
    want, got = plain(want.fetchall()), plain(map(tuple, found.select(*columns).collect()))
    assert got == want
    return got


def test_of_a_days_orders_the_one_with_an_unknown_value_is_the_greatest(spark, tmp_path):
    # 7 and 187 agree in all that comes before the assists, which 7 does not have
    folder = tables(tmp_path, customer="SELECT * FROM customer", orders="SELECT * REPLACE (k AS o_orderkey, 3 AS o_custkey, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * d AS o_orderdate) FROM (SELECT * FROM orders LIMIT 1), (VALUES (7, 0), (187, 0), (500, 60), (901, 90)) t(k, d)")
    rows = same_as_sql(spark, "snapshot_players", folder)
    assert len(rows) == 4


def plan(spark, name):
    return catalog.queries()[name](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 9])
def test_asks_meet_the_dearest_offers_only(spark, ranges):
    draw = random.Random(3)
    asks = [(draw.choice([1, 1, 2, None]), draw.choice([None, float(draw.randrange(30)), -0.0]), i) for i in range(200)]
    offers = [(draw.choice([1, 1, 2, 3, None]), draw.choice([None, float(draw.randrange(5, 30)), 0.0]), i) for i in range(150)]
    found = ranks.last_below(spark.createDataFrame(asks, "k int, at double, ask int"), spark.createDataFrame(offers, "k int, v double, offer int"), ["k"], "at", "v", "ask", "offer", 3, ranges)
    want = set()
    for k, at, i in asks:
        held = [(-v, o) for key, v, o in offers if None not in (k, at, v) and key == k and v <= at]
        want |= {(i, o, -v) for v, o in sorted(held)[:3]}
    assert {(r.ask, r.offer, r.v) for r in found.collect()} == want


def test_budget_swaps_pair_nothing_by_price(spark):
    assert "<= c_acctbal" not in plan(spark, "theta_budget_swap")


@pytest.mark.parametrize("ranges", [1, 9])
def test_the_best_so_far(spark, ranges):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([None, draw.randrange(1000)])) for i in range(300)]
    found = ranks.best_so_far(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], [F.desc("i")], F.col("v"), "least", ranges).collect()
    assert {(r.i, r.least) for r in found} == {(i, min((v for key, j, v in rows if key == k and j >= i and v is not None), default=None)) for k, i, _ in rows}


def test_transfers_pair_nothing_by_price(spark):
    assert "<= c_acctbal" not in plan(spark, "transfer_ranking")


@pytest.mark.parametrize("ranges", [1, 9])
def test_corroborated_pairs_are_counted_without_pairing(spark, ranges):
    draw = random.Random(5)
    names = ["a b", "ann b", "a", "ann", "anna b c", "a b c", "bo b", None, ""]
    rows = [(draw.choice(["x", "x", "y", None]), draw.randrange(60), draw.choice(names), draw.choice(names)) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, i int, name string, short string")
    left, right = df.select("k", "i", "name"), df.select("k", F.col("i").alias("j"), "short")
    pairs = left.join(right, "k").filter("i < j").groupBy("k").agg(F.count("*").alias("pairs"), F.count_if(scalars.corroborated(F.col("name"), F.col("short"))).alias("corroborated"))
    found = quality.corroborated_pairs(left, right, ["k"], "i", "j", "name", "short", ranges)
    assert sorted(map(tuple, found.filter("pairs > 0").collect())) == sorted(map(tuple, pairs.collect()))


def test_name_corroboration_pairs_nothing(spark):
    assert "< other" not in plan(spark, "name_corroboration")


@pytest.mark.parametrize("seed", range(12))
def test_exchanges_of_all_fixtures_at_once_are_those_one_by_one(seed):
    draw = np.random.default_rng(seed)
    formations = {"a": "DDMF", "b": "DMMF", "c": "DDMM"}
    sets = [frozenset("D"), frozenset("M"), frozenset("F"), frozenset("DM"), frozenset("MF")]
    n = int(draw.integers(3, 9))
    points, own = draw.integers(-5, 20, (6, n)) / 4, draw.random((6, n)) < 0.9
    roles = [sets[k] for k in draw.integers(0, 5, n)]
    before, without, rest = market.exchange_arrays(points, own, roles, list(formations.values()), sets)
    for f in range(6):
        held = np.flatnonzero(own[f])
        if not len(held):
            assert np.isnan(before[f])
            continue
        first, *others = market.exchange_values(held.tolist(), points[f, held], [roles[i] for i in held], formations, sets)
        assert before[f] == first[2]
        assert {(d, r) for d in range(n) for r in range(5) if not np.isnan(rest[f, d, r])} == {(d, sets.index(r)) for d, r, _, _ in others}
        assert all((without[f, d], rest[f, d, sets.index(r)]) == (a, b) for d, r, a, b in others)


def test_exchanges_are_no_rows_of_a_join(spark):
    text = plan(spark, "market_exchanges")
    assert "<= (budget" not in text and "FlatMapGroupsInPandas" not in text


def test_the_archive_is_dealt_once_and_kept_without_digests(spark, tmp_path, monkeypatch):
    made = []
    keep = replay.staged
    monkeypatch.setattr(replay, "staged", lambda df, name: made.append((name, df.columns)) or keep(df, name))
    runs = spark.createDataFrame([("a", "s", "x", "succeeded", 1, None), ("b", "s", "x", "succeeded", 2, None)], "run_id string, source string, scope string, status string, started_at int, replay_of string")
    rows = [("a", "player", "1", "bad", 5), ("b", "player", "1", "new", 5), ("a", "player", "2", "one", 5), ("b", "player", "2", "one", 5)]
    observations = spark.createDataFrame(rows, "run_id string, kind string, object_id string, content string, available_at int").withColumn("sha256", F.sha2("content", 256))
    planned = replay.plan(runs, observations, valid=F.col("content") != "bad")
    assert [name for name, _ in made] == ["replay-plan"] and not {"sha256", "identity"} & set(made[0][1])
    assert sorted((r.run_id, r.object_id, r.content) for r in planned.observations.collect()) == [("a", "2", "one"), ("b", "1", "new")]
    identity = {(r.object_id, r.content): r.identity for r in planned.observations.collect()}
    report = {(r.reason, r.run_id): (r.identity, r.replacement) for r in planned.report.collect()}
    assert report[("superseded payload", "a")][1] == identity[("1", "new")] and report[("repeated observation", "a")][0] == identity[("2", "one")]
    store = versions.Store(spark, f"file://{tmp_path}/store")
    target = replay.Target("t", ("player",), ("object_id",), lambda df: df)
    assert replay.replay(store, planned, [target]) == {"batch 0": 2}
    assert not [p for p in tables_source._staged[spark.sparkContext.applicationId] if "replay-batch" in p]
    assert {r.object_id for r in store.read("t").collect()} == {"1", "2"}


def test_few_choices_are_valued_together_and_found_as_by_the_search(monkeypatch):
    draw = np.random.default_rng(5)
    sets = [frozenset("A"), frozenset("B"), frozenset("AB"), frozenset("C")]
    for n in (3, 6, 8):
        for _ in range(25):
            points, theirs = draw.integers(0, 9, (n, 6)) * 50, draw.integers(4, 30, 6) * 50
            roles = [sets[i] for i in draw.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])]
            formations = {"x": "AABB", "y": "AAAB", "z": "AB"}
            monkeypatch.setattr(market, "FEW_CHOICES", 2000)
            together = market.best_against(points, roles, formations, theirs)
            monkeypatch.setattr(market, "FEW_CHOICES", 0)
            assert together == market.best_against(points, roles, formations, theirs)


def test_forecast_inputs_keep_no_row_for_each_target(spark):
    text = plan(spark, "forecast_inputs")
    assert "pivotfirst" not in text and "target" not in "".join(line.split("keys=")[1].split("]")[0] for line in text.splitlines() if "keys=" in line)
