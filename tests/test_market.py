"""Exchanges against solving each one anew, and match-ups against enumeration and beam search."""

from itertools import combinations

import numpy as np
import pytest

from kairoframe.operators import decision, market

FORMATIONS = {"a": "DDMF", "b": "DMMF", "c": "DDMM"}
ROLES = [frozenset("D"), frozenset("M"), frozenset("F"), frozenset("DM"), frozenset("MF")]


def solved(points, roles):
    found = decision.best_lineup(np.array(points, dtype=float), [tuple(r) for r in roles], {k: list(v) for k, v in FORMATIONS.items()})
    return -np.inf if found is None else found[2]


@pytest.mark.parametrize("seed", range(25))
def test_an_exchange_is_worth_what_solving_it_anew_gives(seed):
    draw = np.random.default_rng(seed)
    n = draw.integers(4, 9)
    points = draw.integers(-5, 20, n).astype(float)
    roles = [ROLES[k] for k in draw.integers(0, 5, n)]
    found = market.exchange_values(list(range(n)), points, roles, FORMATIONS, ROLES)
    assert found[0][2] == solved(points, roles) or abs(found[0][2] - solved(points, roles)) < 1e-9
    assert {(d, r) for d, r, _, _ in found[1:]} == {(d, r) for d in range(n) for r in ROLES if r & roles[d]}
    for d, r, without, rest in found[1:]:
        left = [i for i in range(n) if i != d]
        for w in (-3.0, 0.0, 4.0, 11.0, 40.0):
            anew = solved([*points[left], w], [*[roles[i] for i in left], r])
            got = max(without, rest + w)
            assert got == anew or abs(got - anew) < 1e-9, (d, r, w)


def enumerated(points, roles, theirs):
    best = None
    for chosen in combinations(range(len(points)), 4):
        value = [[1.0 if slot in roles[i] else decision.FORBIDDEN for i in chosen] for slots in FORMATIONS.values() for slot in slots]
        if any(decision.assign(np.array(value[k : k + 4]).T)[1] > 3.5 for k in range(0, 12, 4)):
            score = points[list(chosen)].sum(axis=0)
            row = (2 * (score > theirs).sum() + (score == theirs).sum(), score.sum(), tuple(-i for i in chosen))
            best = row if best is None else max(best, row)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_match_ups_equal_enumeration_and_are_not_below_beam_search(seed):
    draw = np.random.default_rng(100 + seed)
    n, scenarios = draw.integers(4, 10), draw.integers(1, 30)
    points, theirs = draw.integers(-3, 12, (n, scenarios)), draw.integers(0, 40, scenarios)
    roles = [ROLES[k] for k in draw.integers(0, 5, n)]
    want, found = enumerated(points, roles, theirs), market.best_against(points, roles, FORMATIONS, theirs)
    if want is None:
        assert found is None
        return
    chosen, wins, draws, proved = found
    assert proved and (2 * wins + draws, points[list(chosen)].sum(), tuple(-i for i in chosen)) == tuple(want)
    single = [min(r) for r in roles]
    worth = decision.match_worth(theirs, lambda x: points[list(x)].sum(axis=0))
    assert decision.beam_search(chosen, range(n), single, worth)[1] * scenarios <= 2 * wins + draws + 1e-9 or any(len(r) > 1 for r in roles)


def test_a_search_that_is_cut_says_so():
    draw = np.random.default_rng(0)
    points, theirs = draw.integers(0, 9, (25, 40)), draw.integers(14, 22, 40)
    roles = [ROLES[k] for k in draw.integers(0, 5, 25)]
    few, many = (market.best_against(points, roles, FORMATIONS, theirs, nodes) for nodes in (5, 20_000))
    assert not few[3] and 2 * many[1] + many[2] >= 2 * few[1] + few[2]


def test_exchanges_of_rosters(spark):
    """Two managers, three fixtures, budgets, refunds and targets they own: all against solving each exchange."""
    draw = np.random.default_rng(5)
    players = {k: (ROLES[draw.integers(0, 5)], float(draw.integers(1, 30)), draw.integers(0, 15, 3).astype(float)) for k in range(30)}
    owned = {"m1": range(0, 8), "m2": range(8, 17)}
    row = lambda k: [(k, sorted(players[k][0]), players[k][1], f + 1, float(players[k][2][f])) for f in range(3)]
    rosters = spark.createDataFrame([(m, "l", *r) for m, ks in owned.items() for k in ks for r in row(k)], "manager string, league string, player int, roles array<string>, price double, fixture int, points double")
    offered = spark.createDataFrame([("l", *r) for k in players for r in row(k)], "league string, player int, roles array<string>, price double, fixture int, points double")
    budgets = spark.createDataFrame([("m1", 9.0), ("m2", None)], "manager string, budget double")
    got: dict = {}
    for r in market.rank_exchanges(rosters, offered, budgets, FORMATIONS, (1, 3), refund=True, limit=6).orderBy("manager", "rank").collect():
        got.setdefault(r.manager, []).append((r.target, r.dropped, round(r.improvement, 6), round(r.gain_1, 6), r.affordability))
    for m, ks in owned.items():
        total = lambda team, h: sum(solved([players[k][2][f] for k in team], [players[k][0] for k in team]) for f in range(h))
        want = {}
        for c in players:
            for d in ks:
                if c in ks or not players[c][0] & players[d][0] or (m == "m1" and players[c][1] > 9 + players[d][1]):
                    continue
                changed = [*[k for k in ks if k != d], c]
                gain = total(changed, 3) - total(ks, 3)
                if np.isfinite(gain) and gain > 1e-9 and (c not in want or (-gain, d) < want[c][:2]):
                    want[c] = (-gain, d, total(changed, 1) - total(ks, 1))
        least = {c: min(sum(players[k][2]) for k in ks if players[k][0] & players[c][0]) for c in want}
        order = sorted(want, key=lambda c: (want[c][0], -(sum(players[c][2]) - least[c]), players[c][1], c))[:6]
        assert [(c, want[c][1], round(-want[c][0], 6), round(want[c][2], 6), "affordable" if m == "m1" else "unknown") for c in order] == got.get(m, [])
        assert len(order) > 2


def _market(spark, draw, managers, leagues, targets):
    roles = [sorted(r) for r in ROLES]
    row = lambda k: (k, roles[draw.integers(0, 5)], float(draw.integers(1, 30)) if k % 7 else None)
    points = lambda: [float(x) if x else None for x in draw.integers(0, 15, 3)]
    owned, offered = [], []
    for m in range(managers):
        for i in range(draw.integers(4, 10)):
            p = row(1000 * m + i)
            owned += [(m, f"l{(m + i % 2) % leagues}", *p, f + 1, x) for f, x in enumerate(points())]
    for k in range(targets):
        p = row(900_000 + k)
        offered += [(f"l{k % leagues}", *p, f + 1, x) for f, x in enumerate(points())]
    kind = "league string, player bigint, roles array<string>, price double, fixture int, points double"
    budgets = [(m, None if m % 3 == 0 else float("nan") if m % 5 == 0 else 6.0 + m) for m in range(managers)]
    return spark.createDataFrame(owned, f"manager bigint, {kind}"), spark.createDataFrame(offered, kind), spark.createDataFrame(budgets + budgets[:2], "manager bigint, budget double")


def test_offers_pass_by_rosters_in_parts_and_blocks_of_any_size(spark, monkeypatch):
    """Batches of two rows, parts of two managers and blocks of three offers give what whole leagues give, and no row is a roster or a list of offers."""
    tables = _market(spark, np.random.default_rng(11), 9, 2, 40)
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(market.rank_exchanges(*tables, FORMATIONS, (1, 3), refund=True, limit=8))
    assert len(want) > 20
    for name, n in (("OFFERS", 3), ("MANAGERS", 2), ("EXCHANGES", 2)):
        monkeypatch.setattr(market, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = market.rank_exchanges(*tables, FORMATIONS, (1, 3), refund=True, limit=8)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert plain(found) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in text and "MapInPandas" not in text and "collect_list(struct(player" not in text


def test_equal_points_are_a_tie_whatever_order_they_come_in(spark):
    kind = "league string, player int, roles array<string>, price double, fixture int, points double"
    mine = [("m", "l", k, [r], 1.0, f, 0.0) for k, r in enumerate("DDMF") for f in (1, 2, 3)]
    rosters = spark.createDataFrame(mine, f"manager string, {kind}")
    offers = [("l", k, ["D"], 2.0, f, x) for k, order in ((9, (1, 2, 3)), (8, (3, 2, 1)), (7, (2, 3, 1))) for f, x in ((f, f / 10) for f in order)]
    budgets = spark.createDataFrame([("m", 9.0)], "manager string, budget double")
    found = market.rank_exchanges(rosters, spark.createDataFrame(offers, kind).coalesce(1), budgets, {"a": "DDMF"}, (1, 3))
    assert [r.target for r in found.orderBy("rank").collect()] == [7, 8, 9]


def test_points_of_a_roster_that_are_not_known_count_nothing(spark):
    rosters, offered, budgets = _market(spark, np.random.default_rng(12), 6, 2, 20)
    best = lambda df: sorted((r.manager, r.target, r.dropped, r.improvement) for r in market.rank_exchanges(df, offered, budgets, FORMATIONS, (1, 3), limit=50).collect())
    assert rosters.filter("points IS NULL").count() and best(rosters) == best(rosters.fillna(0.0, ["points"])) != []
