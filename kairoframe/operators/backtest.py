"""Decisions replayed: benchmark rosters by draft, policies on what was known, scores on what was observed, paired by case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import market, metrics

#: Players of a roster by role.
SIZES = {"GK": 3, "DEF": 8, "MID": 8, "FWD": 6}
POLICIES = ("balanced", "naive", "matchup", "market", "hindsight")


def draft(players: DataFrame, seed: str, sizes: Mapping[str, int] = SIZES) -> DataFrame:
    """(case_id, player, role, side): the rosters `first` and `second` of each case and one player of each role on the `market`.

    players: case_id, player, role, minutes.  A role's pool are its 4 n + 1
    players of most minutes, in an order that a digest of seed, case and player
    gives: n for each roster, then one for the market.  A case with under
    2 n + 1 players of a role has no rosters.
    """
    known = players.filter(F.col("role").isin(list(sizes)))
    size = F.element_at(F.create_map(*[F.lit(x) for r, n in sizes.items() for x in (r, n)]), F.col("role"))
    role = Window.partitionBy("case_id", "role")
    pool = known.withColumns({"_n": size, "_place": F.row_number().over(role.orderBy(F.desc("minutes"), "player")), "_of": F.count("*").over(role)}).filter(F.col("_place") <= 4 * F.col("_n") + 1)
    whole = pool.filter(F.col("_of") >= 2 * F.col("_n") + 1).groupBy("case_id").agg(F.count_distinct("role").alias("_roles")).filter(F.col("_roles") == len(sizes))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("case_id").cast("string"), F.col("player").cast("string")))
    dealt = pool.join(whole, "case_id", "left_semi").withColumn("_i", F.row_number().over(role.orderBy(drawn, "player")))
    side = F.when(F.col("_i") <= F.col("_n"), "first").when(F.col("_i") <= 2 * F.col("_n"), "second").when(F.col("_i") == 2 * F.col("_n") + 1, "market")
    return dealt.withColumn("side", side).filter("side IS NOT NULL").select("case_id", "player", "role", "side")


def replay_cases(drafted: DataFrame, forecasts: DataFrame, observed: DataFrame, minutes: DataFrame, formations: Mapping[str, Sequence[str]], nodes: int = 20_000) -> DataFrame:
    """A row for each case: what each policy's line-up of the first roster was observed to score.

    forecasts: case_id, player, points (expected), scenarios (array of points,
    of one length in a case); observed and minutes: case_id, player and points
    or minutes.  balanced: greatest expected points; naive: most minutes;
    matchup: most wins and draws over the scenarios of the second roster's
    balanced line-up; market: balanced after the exchange of greatest expected
    gain, if there is one; hindsight: greatest observed points, which no other
    line-up of the first roster exceeds.  A case's players are few and go to
    one task together.
    """
    sides = reduce(lambda a, b: a.join(b, ["case_id", "player"], "left"), [drafted, forecasts.withColumnRenamed("points", "expected"), observed.withColumnRenamed("points", "seen"), minutes])
    kind = drafted.schema["case_id"].dataType.simpleString()
    person = drafted.schema["player"].dataType.simpleString()
    schema = f"case_id {kind}, " + ", ".join(f"{p} double" for p in POLICIES) + f", opponent double, target {person}, dropped {person}, predicted_gain double, predicted_win double, line_up string"

    def best(squad: pd.DataFrame, by: str) -> list[int] | None:
        """Rows of the best line-up by a column."""
        roles = [frozenset([r]) for r in squad["role"]]
        order = sorted(range(len(squad)), key=lambda i: (-squad[by].iloc[i], i))
        found = [market.Places(s, roles).best([(float(squad[by].iloc[i]), roles[i]) for i in order]) for s in formations.values()]
        total, taken = max(found, key=lambda x: x[0])
        return None if total == -np.inf else [order[i] for i in taken]

    def judge(case: pd.DataFrame) -> pd.DataFrame:
        case = case.fillna({"expected": 0.0, "seen": 0.0, "minutes": 0.0}).sort_values("player").reset_index(drop=True)
        mine, theirs, offered = (case[case["side"] == s].reset_index(drop=True) for s in ("first", "second", "market"))
        chosen = {p: best(mine, by) for p, by in (("balanced", "expected"), ("naive", "minutes"), ("hindsight", "seen"))}
        against = best(theirs, "expected")
        if against is None or any(c is None for c in chosen.values()):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        points = lambda squad: np.rint(np.array([np.zeros(1) if x is None else np.asarray(x, dtype=float) for x in squad["scenarios"]]) * 100).astype(np.int64)
        opponent = points(theirs)[against].sum(axis=0)
        line_up, wins, _, _ = market.best_against(points(mine), [frozenset([r]) for r in mine["role"]], formations, opponent, nodes)
        score = {p: float(mine["seen"].iloc[c].sum()) for p, c in (*chosen.items(), ("matchup", list(line_up)))}
        ids = mine["player"].tolist()
        numbers = market.exchange_values(ids, mine["expected"].tolist(), [frozenset([r]) for r in mine["role"]], formations, [frozenset([r]) for r in offered["role"]])
        now = numbers[0][2]
        gains = [(max(without, rest + w) - now, -i, -ids.index(d)) for d, r, without, rest in numbers[1:] for i, (w, o) in enumerate(zip(offered["expected"], offered["role"], strict=True)) if frozenset([o]) == r]
        gain, i, d = max(gains, default=(0.0, 0, 0))
        target = dropped = None
        score["market"] = score["balanced"]
        if gain > 1e-9:
            target, dropped = offered["player"].iloc[-i], ids[-d]
            changed = pd.concat([mine[mine["player"] != dropped], offered.iloc[[-i]]]).sort_values("player").reset_index(drop=True)
            score["market"] = float(changed["seen"].iloc[best(changed, "expected")].sum())
        return pd.DataFrame([{
            "case_id": case["case_id"].iloc[0], **{p: score[p] for p in POLICIES}, "opponent": float(theirs["seen"].iloc[against].sum()), "target": target, "dropped": dropped,
            "predicted_gain": max(gain, 0.0), "predicted_win": wins / len(opponent), "line_up": ",".join(str(ids[k]) for k in sorted(chosen["balanced"])),
        }])

    return sides.groupBy("case_id").applyInPandas(judge, schema)


def lifts(cases: DataFrame, cluster: str, pairs: Sequence[tuple[str, str]] = (("balanced", "naive"), ("matchup", "balanced"), ("market", "balanced"), ("hindsight", "balanced")), resamples: int = 2000, seed: str = "backtest") -> DataFrame:
    """A row for each pair of policies: the mean paired difference, by cluster (a week), and its interval over resampled clusters."""
    out = []
    for a, b in pairs:
        interval = metrics.bootstrap_mean(cases.withColumn("_lift", F.col(a) - F.col(b)), cluster, "_lift", resamples, f"{seed}:{a}:{b}")
        out.append(interval.select(F.lit(a).alias("policy"), F.lit(b).alias("against"), "mean", "clusters", "low", "high"))
    return reduce(lambda x, y: x.unionByName(y), out)
