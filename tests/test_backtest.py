"""Drafts and replayed cases against plain lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import backtest

SIZES, FORMATIONS = {"A": 2, "B": 1}, {"x": "AB", "y": "AA"}


def players(cases=6, seed=1):
    draw = random.Random(seed)
    return [(c, f"p{c}-{i}", draw.choice("AAB"), float(draw.randrange(9))) for c in range(cases) for i in range(draw.randrange(6, 18))]


def test_draft_by_role(spark):
    rows = players(30)
    found = {}
    for r in backtest.draft(spark.createDataFrame(rows, "case_id int, player string, role string, minutes double"), "s", SIZES).collect():
        found.setdefault(r.case_id, []).append((r.player, r.side))
    want = {}
    for c in {r[0] for r in rows}:
        dealt = []
        for role, n in SIZES.items():
            mine = sorted((r for r in rows if r[0] == c and r[2] == role), key=lambda r: (-r[3], r[1]))
            if len(mine) < 2 * n + 1:
                break
            order = sorted((r[1] for r in mine[: 4 * n + 1]), key=lambda p: (hashlib.md5(f"s:{c}:{p}".encode()).hexdigest(), p))
            dealt += [(p, "first" if i < n else "second" if i < 2 * n else "market") for i, p in enumerate(order[: 2 * n + 1])]
        else:
            want[c] = sorted(dealt)
    assert {c: sorted(x) for c, x in found.items()} == want and 5 < len(want) < 30


def test_cases_row_by_row(spark):
    rows = players(40, 2)
    draw = random.Random(3)
    table = spark.createDataFrame(rows, "case_id int, player string, role string, minutes double")
    drafted = backtest.draft(table, "s", SIZES)
    known = {r[:2]: (float(draw.randrange(20)), [float(draw.randrange(20)) for _ in range(4)], float(draw.randrange(20))) for r in rows}
    forecasts = spark.createDataFrame([(*k, v[0], v[1]) for k, v in known.items()], "case_id int, player string, points double, scenarios array<double>")
    observed = spark.createDataFrame([(*k, v[2]) for k, v in known.items()], "case_id int, player string, points double")
    out = backtest.replay_cases(drafted, forecasts, observed, table.select("case_id", "player", "minutes"), FORMATIONS).collect()
    sides = {}
    for r in drafted.collect():
        sides.setdefault(r.case_id, {}).setdefault(r.side, []).append((r.player, r.role))
    minutes = {r[:2]: r[3] for r in rows}
    assert len(out) == len(sides) > 8
    legal = lambda squad: [(a, b) for i, a in enumerate(squad) for b in squad[i + 1 :] if sorted([a[1], b[1]]) in (["A", "B"], ["A", "A"])]
    for r in out:
        mine, theirs, offered = (sorted(sides[r.case_id][s]) for s in ("first", "second", "market"))
        seen = lambda pair: sum(known[r.case_id, p][2] for p, _ in pair)
        total = lambda pair, by: sum(by(p) for p, _ in pair)
        expected, minute = lambda p: known[r.case_id, p][0], lambda p: minutes[r.case_id, p]
        best = lambda squad, by: [x for x in legal(squad) if total(x, by) == max(total(y, by) for y in legal(squad))]
        assert r.balanced in {seen(x) for x in best(mine, expected)} and r.naive in {seen(x) for x in best(mine, minute)}
        assert r.hindsight == max(map(seen, legal(mine))) >= max(r.balanced, r.naive, r.matchup)
        assert r.opponent in {seen(x) for x in best(theirs, expected)}
        scen = lambda pair: [sum(known[r.case_id, p][1][k] for p, _ in pair) for k in range(4)]
        worth = lambda x, o: sum(2 * (a > b) + (a == b) for a, b in zip(scen(x), scen(o), strict=True))
        assert any(r.matchup in {seen(x) for x in legal(mine) if worth(x, o) == max(worth(y, o) for y in legal(mine))} for o in best(theirs, expected))
        now = max(total(x, expected) for x in legal(mine))
        gains = {(c, d): max(total(x, expected) for x in legal([m for m in mine if m != d] + [c])) - now for c in offered for d in mine if c[1] == d[1] and legal([m for m in mine if m != d] + [c])}
        assert r.predicted_gain == pytest.approx(max([0.0, *gains.values()]))
        if r.target is None:
            assert r.market == r.balanced
        else:
            c, d = next(x for x in gains if (x[0][0], x[1][0]) == (r.target, r.dropped))
            assert gains[c, d] == pytest.approx(r.predicted_gain) and r.market in {seen(x) for x in best([m for m in mine if m != d] + [c], expected)}


def test_lifts_are_paired_by_cluster(spark):
    cases = spark.createDataFrame([(1, 3.0, 1.0, 3.0, 3.0, 4.0), (1, 5.0, 5.0, 5.0, 5.0, 9.0), (2, 2.0, 1.0, 2.0, 2.0, 2.0)], "week int, balanced double, naive double, matchup double, market double, hindsight double")
    out = {r.policy: (r["mean"], r.clusters, r.low <= r["mean"] <= r.high) for r in backtest.lifts(cases, "week", resamples=50).collect()}
    assert out["balanced"] == (1.0, 2, True) and out["hindsight"] == (1.25, 2, True) and out["market"] == (0.0, 2, True)
