"""Simulation, decisions, learning and streams over the driver's tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest
from ..operators import decision as D
from ..operators import learning as L
from ..operators import market
from ..operators import ranks
from ..operators import scoring as O
from ..operators import simulation as X
from ..sources import sinks
from ..sources.tables import shared_folder, staged, table
from ..streaming import live
from .catalog import register

FORMATIONS = {
    "4-4-2": ("GK", *["DEF"] * 4, *["MID"] * 4, *["FWD"] * 2),
    "4-3-3": ("GK", *["DEF"] * 4, *["MID"] * 3, *["FWD"] * 3),
    "3-5-2": ("GK", *["DEF"] * 3, *["MID"] * 5, *["FWD"] * 2),
}


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


def squads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fixtures and players made of all customers: an even number of teams of sixteen and a few more."""
    c = table(spark, sf, "customer")
    c = c.withColumn("team", (F.col("c_custkey") % (2 * max(1, c.count() // 32))).cast("int"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("team").orderBy("c_custkey")))
    x = F.pmod(F.xxhash64("c_custkey"), F.lit(1000)) / 1000.0
    position = F.when(F.col("n") <= 2, "GK").when(F.col("n") <= 7, "DEF").when(F.col("n") <= 12, "MID").otherwise("FWD")
    attack = F.when(position == "FWD", 3.0).when(position == "MID", 1.5).when(position == "DEF", 0.5).otherwise(0.0)
    players = c.select(
        F.format_string("match-%d", F.floor(F.col("team") / 2)).alias("match_id"),
        F.col("c_custkey").cast("string").alias("player_id"),
        F.when(F.col("team") % 2 == 0, "home").otherwise("away").alias("side"),
        position.alias("position"),
        (0.85 + 0.15 * x).alias("availability"),
        (0.3 + 0.5 * x).alias("start"),
        (0.5 + 0.45 * x).alias("appearance"),
        (40 + 45 * x).alias("expected_minutes"),
        F.lit(15.0).alias("minutes_sd"),
        (attack * (0.5 + x)).alias("goal_weight"),
        (attack * (1.5 - x)).alias("assist_weight"),
        (0.05 + 0.2 * x).alias("yellow"),
        F.lit(0.01).alias("red"),
        F.when(position == "GK", 3.0).otherwise(0.0).alias("saves_per90"),
        (attack * x).alias("penalty_weight"),
        F.lit(1.0).alias("own_goal_weight"),
    )
    fixtures = players.select("match_id").distinct().select(
        "match_id", F.lit(1.5).alias("home_mean"), F.lit(1.1).alias("away_mean"), F.lit(0.08).alias("shared"), F.lit(0.72).alias("assisted"), F.lit(5).alias("substitutions"),
        F.lit(0.09).alias("penalty_share"), F.lit(0.03).alias("own_goal_share"), F.lit(0.03).alias("missed_per_goal"), F.lit(0.75).alias("penalty_save"),
    )
    return fixtures, players


@register("simulate_fixtures")
def simulate_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    fixtures, players = squads(spark, sf)
    return X.simulate_summaries(fixtures, players, runs=500, block=500, seed=3)


@register("simulation_conservation", "WITH t AS (SELECT GREATEST(1, COUNT(*) // 32) AS n FROM customer) SELECT 'match-' || i AS match_id, 0::BIGINT AS wrong_minutes, 0::BIGINT AS wrong_keepers, 0::BIGINT AS wrong_goals, 1000::BIGINT AS runs FROM t, LATERAL (SELECT UNNEST(RANGE(n)) AS i)")
def simulation_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Per fixture how many runs break a law: minutes of a team, goals against conceded goals, one keeper."""
    fixtures, players = squads(spark, sf)

    def laws(match_id: str, sides) -> pd.DataFrame:
        home, away = (sides[s][1] for s in ("home", "away"))
        of = lambda mine, c: mine[c].sum(axis=1)
        minutes = sum(int((of(mine, "minutes") != 990).sum()) for mine in (home, away))
        keepers = sum(int((((t["position"] == "GK").to_numpy() & (mine["minutes"] > 0)).sum(axis=1) != 1).sum()) for t, mine in sides.values())
        goals = (of(home, "goals") + of(away, "own_goals") != of(away, "goals_conceded")) | (of(away, "goals") + of(home, "own_goals") != of(home, "goals_conceded"))
        return pd.DataFrame({"match_id": match_id, "wrong_minutes": minutes, "wrong_keepers": keepers, "wrong_goals": int(goals.sum()), "runs": len(goals)}, index=[0])

    names = ("wrong_minutes", "wrong_keepers", "wrong_goals", "runs")
    found = X.simulated(fixtures, players, laws, "match_id string, " + ", ".join(f"{c} bigint" for c in names), runs=1000, block=500, seed=3)
    return found.groupBy("match_id").agg(*[F.sum(c).alias(c) for c in names])


@register("lineup_assignment")
def lineup_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Per team the best formation and eleven for the expected points of the simulation."""
    fixtures, players = squads(spark, sf)
    weights = {"goals": 3.0, "assists": 1.0, "yellow_cards": -0.5, "red_cards": -1.0, "own_goals": -2.0, "penalties_saved": 3.0, "penalties_missed": -3.0}

    def totals(match_id: str, sides) -> pd.DataFrame:
        each = [pd.DataFrame({"match_id": match_id, "side": side, "player_id": t["player_id"], "position": t["position"], "total": O.sample_points(mine, 6.0, weights).sum(axis=0), "runs": len(mine["minutes"])}) for side, (t, mine) in sides.items()]
        return pd.concat(each, ignore_index=True)

    sums = X.simulated(fixtures, players, totals, "match_id string, side string, player_id string, position string, total double, runs bigint", runs=500, block=500, seed=5)
    expected = sums.groupBy("match_id", "side", "player_id", "position").agg((F.sum("total") / F.sum("runs")).alias("points"))

    def choose(team: pd.DataFrame) -> pd.DataFrame:
        team = team.sort_values("player_id").reset_index(drop=True)
        name, chosen, total = D.best_lineup(team["points"].to_numpy(), [(r,) for r in team["position"]], FORMATIONS)
        return pd.DataFrame({"match_id": team["match_id"][0], "side": team["side"][0], "formation": name, "total": round(total, 6), "players": ",".join(sorted(team["player_id"][chosen]))}, index=[0])

    return expected.groupBy("match_id", "side").applyInPandas(choose, "match_id string, side string, formation string, total double, players string")


@register("beam_search_lineups")
def beam_search_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Per team the line-up that beam search finds over scenarios with substitutions, and the gain over the first."""
    fixtures, players = squads(spark, sf)
    weights = {"goals": 3.0, "assists": 1.0, "yellow_cards": -0.5, "own_goals": -2.0}
    scored = X.team_samples(fixtures, players, lambda mine: O.sample_points(mine, 6.0, weights), runs=128, block=128, seed=9)
    capacities = [{r: s.count(r) for r in dict.fromkeys(s)} for s in FORMATIONS.values()]

    def search(team: pd.DataFrame) -> pd.DataFrame:
        names, roles, p, a = X.team_arrays(team)
        mean = p.mean(axis=0)
        _, first, _ = D.best_lineup(mean, [(r,) for r in roles], FORMATIONS)
        order = sorted(range(len(roles)), key=lambda i: -mean[i])

        def worths(lineups: list[tuple[int, ...]]) -> list[float]:
            benches = np.array([[i for i in order if i not in x] for x in lineups])
            return D.lineups_points(p, a, roles, np.array(lineups), benches, capacities).mean(axis=1).tolist()

        def worth(lineup: tuple[int, ...]) -> float:
            return worths([lineup])[0]

        best, total = D.beam_search(first, range(len(roles)), roles, worth, worths=worths)
        return pd.DataFrame({"match_id": team["match_id"].iloc[0], "side": team["side"].iloc[0], "total": round(total, 6), "gain": round(total - worth(tuple(sorted(first))), 6), "players": ",".join(names[i] for i in best)}, index=[0])

    return scored.groupBy("match_id", "side").applyInPandas(search, "match_id string, side string, total double, gain double, players string")


@register("transfer_ranking", """
WITH s AS (SELECT p.p_partkey AS target, c.c_custkey AS giver, ROUND(p.p_size - c.c_custkey % 50, 4) AS gain, p.p_size AS over_replacement, p.p_retailprice AS price FROM part p JOIN customer c ON c.c_custkey % 25 = CAST(REPLACE(p.p_brand, 'Brand#', '') AS BIGINT) - 1 AND p.p_retailprice <= c.c_acctbal),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY gain DESC, over_replacement DESC, price NULLS LAST, target, giver) AS n FROM s)
SELECT target, giver, gain, over_replacement, price FROM b WHERE n = 1 ORDER BY gain DESC, over_replacement DESC, price NULLS LAST, target LIMIT 25""")
def transfer_ranking(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("target"), (F.regexp_replace("p_brand", "Brand#", "").cast("bigint") - 1).alias("g"), F.col("p_size").alias("over_replacement"), F.col("p_retailprice").alias("price"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("giver"), (F.col("c_custkey") % 25).alias("g"), "c_acctbal")
    # a giver is better the smaller the rest of its number, so along falling balances the best one so far is the best that can pay
    giver = lambda of, price, value: of.select("g", price.alias("v"), F.col(value).alias("id"), F.lit(value).alias("side"), *[F.col(x) if x in of.columns else F.lit(None).cast("double" if x == "price" else "int").alias(x) for x in ("over_replacement", "price")])
    line = giver(c.filter("c_acctbal IS NOT NULL"), F.col("c_acctbal"), "giver").unionByName(giver(part.filter("price IS NOT NULL"), F.col("price"), "target")).filter("g IS NOT NULL")
    least = F.when(F.col("side") == "giver", F.struct((F.col("id") % 50).alias("rest"), F.col("id").alias("giver")))
    met = ranks.best_so_far(line, ["g"], [F.desc("v"), F.col("side"), F.col("id")], least, "s").filter("side = 'target' AND s IS NOT NULL")
    best = met.select(F.col("id").alias("target"), F.col("s.giver").alias("giver"), F.round((F.col("over_replacement") - F.col("s.rest")).cast("double"), 4).alias("gain"), "over_replacement", "price")
    return O.rank_swaps(best, "gain", "over_replacement", "price", "target", 25).select("target", "giver", F.col("gain").cast("bigint").alias("gain"), "over_replacement", "price")


def labelled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as examples: was it finished, by what was known of customer and price; a feature is missing at times."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select("o_orderkey", F.year("o_orderdate").alias("season"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))


@register("train_logistic_with_calibration")
def train_logistic_with_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_orders(spark, sf)
    features = ["price", "balance", "nation"]
    last = rows.agg(F.max("season")).first()[0]
    model = L.fit_classifier(rows.filter(F.col("season") < last - 1), features, "label")
    kind, apply = L.calibrate(L.probabilities(model, rows.filter(F.col("season") == last - 1), features), "label")
    scored = apply(L.probabilities(model, rows.filter(F.col("season") == last), features))
    return scored.select("o_orderkey", "label", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"), F.lit(kind).alias("calibration"))


@register("zero_excess_diagnosis", "WITH c AS (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1) SELECT ROUND(AVG(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS zeros, ROUND(EXP(-AVG(n)), 6) AS poisson_zeros, AVG(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - EXP(-AVG(n)) > 0.02 AS hurdle FROM c")
def zero_excess_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    counts = table(spark, sf, "customer").join(urgent, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return L.zero_excess(counts, "n").select(F.round("zeros", 6).alias("zeros"), F.round("poisson_zeros", 6).alias("poisson_zeros"), "hurdle")


def _newton(rounds: int) -> str:
    """Newton steps of the two weights of a log-linear count model, a table for each round."""
    out = ["b0 AS (SELECT seg, 0.0::DOUBLE AS w, LN(GREATEST(AVG(y), 1e-6)) AS c, 0.1::DOUBLE AS a FROM d GROUP BY seg)"]
    for k in range(rounds):
        mean = "EXP(GREATEST(-20.0::DOUBLE, LEAST(20.0::DOUBLE, b.w * d.x + b.c)))"
        out.append(f"""s{k} AS (SELECT seg, w, c, SUM(x * (y - m) / (1 + a * m)) - 0.01::DOUBLE * w AS g1, SUM((y - m) / (1 + a * m)) AS g2, SUM(m / (1 + a * m) * x * x) + 0.01::DOUBLE + 1e-9 AS h11, SUM(m / (1 + a * m) * x) AS h12, SUM(m / (1 + a * m)) + 1e-9 AS h22
  FROM (SELECT d.seg, d.x, d.y, b.w, b.c, b.a, {mean} AS m FROM d JOIN b{k} b USING (seg)) GROUP BY seg, w, c)""")
        out.append(f"n{k} AS (SELECT seg, w + GREATEST(-2, LEAST(2, (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12))) AS w, c + GREATEST(-2, LEAST(2, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12))) AS c FROM s{k})")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT seg, w, c, GREATEST(1e-6, AVG(((y - m) * (y - m) - m) / (GREATEST(m, 1e-9) * GREATEST(m, 1e-9)))) AS a FROM (SELECT d.seg, d.y, b.w, b.c, {mean} AS m FROM d JOIN n{k} b USING (seg)) GROUP BY seg, w, c)")
    return ",\n".join(out)


@register("negative_binomial_by_segment", f"""
WITH o AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1),
d AS MATERIALIZED (SELECT c_mktsegment AS seg, c_acctbal / 10000 AS x, COALESCE(n, 0)::DOUBLE AS y FROM customer LEFT JOIN o ON o_custkey = c_custkey),
{_newton(12)}
SELECT seg AS c_mktsegment, ROUND(w, 5) AS slope, ROUND(c, 5) AS intercept, ROUND(a, 5) AS dispersion, (SELECT COUNT(*) FROM d WHERE d.seg = b.seg) AS n FROM b12 b""")
def negative_binomial_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """A count model for each market segment: orders of a customer by balance."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").join(counts, "c_custkey", "left").select("c_mktsegment", (F.col("c_acctbal") / 10000).alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("y"))
    found = L.fit_negative_binomials(rows, "c_mktsegment", ["x"], "y")
    return found.select("c_mktsegment", F.round(F.col("weights")[0], 5).alias("slope"), F.round(F.col("weights")[1], 5).alias("intercept"), F.round("dispersion", 5).alias("dispersion"), "n")


@register("stream_tumbling_counts", "SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = live.file_stream(spark, f"{sf}/events.parque[t]")
    out = live.drain(live.tumbling(stream, "ts", "1 day", ["event_type"], "1 day"), folder(spark, "streams"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 12 HOUR OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 12 HOUR AS session_end, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    stream = live.file_stream(spark, f"{sf}/events.parque[t]")
    out = live.drain(live.sessions(stream, "ts", "12 hours", ["user_id"], "1 day"), folder(spark, "streams"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@register("stream_change_points", "SELECT user_id, ts AS changed_at, event_type FROM (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def stream_change_points(spark: SparkSession, sf: str) -> DataFrame:
    stream = live.file_stream(spark, f"{sf}/events.parque[t]")
    out = live.drain(live.change_points(stream, "user_id", "ts", "event_type"), folder(spark, "streams"), "append")
    return out.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@register("head_to_head")
def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    """Per match the shares of scenarios that the home eleven wins, draws and loses on points."""
    fixtures, players = squads(spark, sf)
    weights = {"goals": 3.0, "assists": 1.0, "yellow_cards": -0.5}

    def shares(match_id: str, sides) -> pd.DataFrame:
        home, away = (O.sample_points(sides[s][1], 6.0, weights).sum(axis=1) for s in ("home", "away"))
        return pd.DataFrame({"match_id": match_id, "win": int((home > away).sum()), "draw": int((home == away).sum()), "loss": int((home < away).sum()), "runs": len(home)}, index=[0])

    found = X.simulated(fixtures, players, shares, "match_id string, win bigint, draw bigint, loss bigint, runs bigint", runs=500, block=500, seed=11)
    return found.groupBy("match_id").agg(*[(F.sum(c) / F.sum("runs")).alias(c) for c in ("win", "draw", "loss")])


#: Places of a small line-up; roles by the size of a part.
SMALL_FORMATIONS = {"2-3": "AABBB", "3-2": "AAABB"}


@register("matchup_lineups", """
WITH r AS (SELECT p_partkey // 8 AS team, CAST(p_partkey % 8 AS INTEGER) AS i, p_size % 3 AS role, p_partkey FROM part),
q AS (SELECT l_partkey, CAST(l_orderkey % 20 AS INTEGER) AS s, CAST(ROUND(SUM(l_quantity) * 100) AS BIGINT) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT r.team, r.i, g.s, COALESCE(q.v, 0) AS v FROM r CROSS JOIN (SELECT CAST(UNNEST(RANGE(20)) AS INTEGER) AS s) g LEFT JOIN q ON q.l_partkey = r.p_partkey AND q.s = g.s),
t AS (SELECT team, s, SUM(v) * 5 // 8 AS v FROM p GROUP BY ALL),
o AS (SELECT a.team, t.s, t.v FROM (SELECT DISTINCT team, MAX(team) OVER () AS last FROM r) a JOIN t ON t.team = CASE WHEN a.team = a.last THEN 0 ELSE a.team + 1 END),
sets AS (SELECT m, UNNEST(LIST_FILTER(RANGE(8), lambda i: (m >> i) & 1 = 1)) AS i FROM RANGE(256) x(m) WHERE BIT_COUNT(m::INTEGER) = 5),
legal AS (SELECT team, m, LIST(sets.i ORDER BY sets.i) AS l FROM sets JOIN r ON r.i = sets.i GROUP BY team, m
  HAVING COUNT(*) = 5 AND ((COUNT(*) FILTER (WHERE role = 0) <= 2 AND COUNT(*) FILTER (WHERE role = 1) <= 3) OR (COUNT(*) FILTER (WHERE role = 0) <= 3 AND COUNT(*) FILTER (WHERE role = 1) <= 2))),
scored AS (SELECT legal.team, legal.m, legal.l, p.s, SUM(p.v) AS v FROM legal JOIN sets USING (m) JOIN p ON p.team = legal.team AND p.i = sets.i GROUP BY ALL),
worth AS (SELECT scored.team, l, COUNT(*) FILTER (WHERE scored.v > o.v) AS wins, COUNT(*) FILTER (WHERE scored.v = o.v) AS draws, SUM(scored.v) AS total FROM scored JOIN o ON o.team = scored.team AND o.s = scored.s GROUP BY ALL)
SELECT team, ARRAY_TO_STRING(l, ',') AS players, wins, draws, CAST(total AS BIGINT) AS total FROM worth QUALIFY ROW_NUMBER() OVER (PARTITION BY team ORDER BY 2 * wins + draws DESC, total DESC, l) = 1""")
def matchup_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Each team's best line-up against the next team: eight parts a team, their quantities in twenty scenarios."""
    part = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 8).alias("team"), (F.col("p_partkey") % 8).cast("int").alias("i"), (F.col("p_size") % 3).alias("role"), "p_partkey")
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") % 20).cast("int").alias("s")).agg(F.round(F.sum("l_quantity") * 100).cast("bigint").alias("v"))
    told = sold.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))
    points = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0).cast("bigint")))
    players = part.join(told, "p_partkey", "left").withColumn("v", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0).cast("bigint"), 20)).otherwise(points))
    squads = players.groupBy("team").agg(F.sort_array(F.collect_list(F.struct("i", "role", "v"))).alias("squad"), F.array(*[F.floor(F.sum(F.col("v")[s]) * 5 / 8).cast("bigint") for s in range(20)]).alias("theirs"))
    squads = staged(squads, "squads")  # eight players and twenty sums a team, read as one's own and as the next one's
    last = squads.agg(F.max("team").alias("last"))
    faced = squads.crossJoin(F.broadcast(last)).select(F.when(F.col("team") == 0, F.col("last")).otherwise(F.col("team") - 1).alias("team"), "theirs")  # last: one row
    roles = {0: frozenset("A"), 1: frozenset("B"), 2: frozenset("AB")}

    def choose(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                value = np.array([x["v"] for x in row.squad])
                found = market.best_against(value, [roles[x["role"]] for x in row.squad], SMALL_FORMATIONS, np.array(row.theirs))
                if found is not None:
                    rows.append((row.team, ",".join(str(row.squad[i]["i"]) for i in found[0]), found[1], found[2], int(value[list(found[0])].sum())))
            yield pd.DataFrame(rows, columns=["team", "players", "wins", "draws", "total"])

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes, much work
    met = squads.select("team", "squad").join(faced, "team").repartition(spread, "team")
    return met.mapInPandas(choose, "team bigint, players string, wins bigint, draws bigint, total bigint")


#: Rosters and line-ups of the replayed cases: forty parts a case, ten weeks.
CASE_SIZES, CASE_FORMATIONS = {"A": 3, "B": 3, "C": 2}, {"2-2-1": "AABBC"}
_CASES = """
WITH p AS (SELECT p_partkey // 40 AS case_id, p_partkey AS player, SUBSTR('ABC', p_size % 3 + 1, 1) AS role FROM part),
l AS (SELECT l_partkey AS player, COALESCE(SUM(l_quantity) FILTER (WHERE y < 1998), 0) AS minutes, COALESCE(ROUND(AVG(l_quantity) FILTER (WHERE y < 1998), 4), 0) AS expected, COALESCE(SUM(l_quantity) FILTER (WHERE y >= 1998), 0) AS seen FROM (SELECT *, YEAR(l_shipdate) AS y FROM lineitem) GROUP BY 1),
f AS (SELECT p.*, COALESCE(minutes, 0) AS minutes, COALESCE(expected, 0) AS expected, COALESCE(seen, 0) AS seen, CASE role WHEN 'C' THEN 2 ELSE 3 END AS n FROM p LEFT JOIN l USING (player)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, role ORDER BY minutes DESC, player) AS place, COUNT(*) OVER (PARTITION BY case_id, role) AS of FROM f),
w AS (SELECT case_id FROM r WHERE place = 1 AND of >= 2 * n + 1 GROUP BY case_id HAVING COUNT(*) = 3),
d AS (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.case_id, role ORDER BY MD5('case:' || r.case_id || ':' || player), player) AS i FROM r JOIN w USING (case_id) WHERE place <= 4 * n + 1),
m AS (SELECT *, CASE role WHEN 'C' THEN 1 ELSE 2 END AS k FROM d WHERE i <= n),
s AS (SELECT case_id, SUM(seen) FILTER (WHERE a <= k) AS balanced, SUM(seen) FILTER (WHERE b <= k) AS naive, SUM(seen) FILTER (WHERE c <= k) AS hindsight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, role ORDER BY expected DESC, player) AS a,
  ROW_NUMBER() OVER (PARTITION BY case_id, role ORDER BY minutes DESC, player) AS b, ROW_NUMBER() OVER (PARTITION BY case_id, role ORDER BY seen DESC, player) AS c FROM m) GROUP BY case_id)
"""


def _replayed_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of forty parts: what was shipped before 1998 is known, what was shipped later is observed."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("player"), "l_quantity", (F.col("l_orderkey") % 20).alias("s"), (F.year("l_shipdate") < 1998).alias("early"))
    part = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("case_id"), F.col("p_partkey").alias("player"), F.substring(F.lit("ABC"), F.col("p_size") % 3 + 1, F.lit(1)).alias("role"))
    sums = lines.groupBy("player").agg(F.sum(F.when(F.col("early"), F.col("l_quantity"))).alias("minutes"), F.round(F.avg(F.when(F.col("early"), F.col("l_quantity"))), 4).alias("expected"), F.sum(F.when(~F.col("early"), F.col("l_quantity"))).alias("seen"))
    told = lines.filter("early").groupBy("player", "s").agg(F.round(F.avg("l_quantity"), 2).alias("v")).groupBy("player").agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))
    scenarios = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)))
    known = part.join(sums, "player", "left").join(told, "player", "left").fillna(0.0, ["minutes", "expected", "seen"])
    known = known.withColumn("scenarios", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), 20)).otherwise(scenarios))
    drafted = backtest.draft(known.select("case_id", "player", "role", "minutes"), "case", CASE_SIZES)
    key = ["case_id", "player"]
    return backtest.replay_cases(drafted, known.select(*key, F.col("expected").alias("points"), "scenarios"), known.select(*key, F.col("seen").alias("points")), known.select(*key, "minutes"), CASE_FORMATIONS)


@register("backtest_cases", _CASES + "SELECT case_id, balanced, naive, hindsight, hindsight - balanced AS regret FROM s")
def backtest_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Three policies of every case on what was observed; no line-up of the roster is above hindsight."""
    found = _replayed_cases(spark, sf)
    never = F.greatest("balanced", "naive", "matchup") > F.col("hindsight") + 1e-9
    return found.filter(F.when(never, F.raise_error(F.lit("hindsight is beaten")).cast("boolean")).otherwise(F.lit(True))).select("case_id", "balanced", "naive", "hindsight", (F.col("hindsight") - F.col("balanced")).alias("regret"))


@register("backtest_lifts")
def backtest_lifts(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences of the policies with intervals over ten weeks."""
    cases = staged(_replayed_cases(spark, sf).withColumn("week", F.col("case_id") % 10), "cases")
    return backtest.lifts(cases, "week").select("policy", "against", "clusters", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


MARKET_FORMATIONS = {"2-2-2": "DDMMFF", "3-2-1": "DDDMMF", "2-3-1": "DDMMMF"}


@register("market_exchanges")
def market_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's best exchanges of parts within its league of ten suppliers, line-ups chosen anew for each of ten fixtures."""
    part, supplier, lines = table(spark, sf, "part"), table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    n = supplier.count()
    league = lambda k: F.col(k) % n % max(1, n // 10)
    role = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in ("D", "M", "F", "MF")]), F.col("p_size") % 4 + 1)
    sold = lines.groupBy(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") % 10 + 1).cast("int").alias("fixture")).agg(F.round(F.avg("l_quantity"), 4).alias("points"))
    each = part.select("p_partkey", role.alias("roles"), F.col("p_retailprice").alias("price"), league("p_partkey").alias("league"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("fixture"))
    offered = each.join(sold, ["p_partkey", "fixture"], "left").fillna(0.0, ["points"]).withColumnRenamed("p_partkey", "player")
    rosters = offered.withColumn("manager", F.col("player") % n)
    budgets = supplier.select(F.col("s_suppkey").alias("manager"), (F.abs("s_acctbal") / 10).alias("budget"))
    found = market.rank_exchanges(rosters, offered, budgets, MARKET_FORMATIONS, refund=True)
    return found.select("manager", "rank", "target", "dropped", "price", "affordability", *[F.round(c, 4).alias(c) for c in ("improvement", "over_replacement", "efficiency", "gain_1", "gain_3", "gain_5", "gain_10")])


@register("rare_event_prior", """
WITH f AS (SELECT user_id, event_type, ROUND(value) AS minutes, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS penalties, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS own FROM events WHERE ROUND(value) > 0),
p AS (SELECT user_id, ARG_MAX(event_type, (minutes, event_type)) AS role, SUM(minutes) AS m, SUM(penalties)::DOUBLE AS pen, SUM(own)::DOUBLE AS own FROM f WHERE penalties <= 2 GROUP BY user_id),
r AS (SELECT role, SUM(pen) / SUM(m) AS rp, SUM(own) / SUM(m) AS ro FROM p GROUP BY role)
SELECT user_id AS player_id, role, ROUND((pen + 1800.0::DOUBLE * rp) / (m + 1800.0::DOUBLE), 8) AS penalties_rate, ROUND((own + 1800.0::DOUBLE * ro) / (m + 1800.0::DOUBLE), 8) AS own_goals_rate FROM p JOIN r USING (role)""")
def rare_event_prior(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    facts = table(spark, sf, "events").select(F.col("user_id").alias("player_id"), F.col("event_type").alias("role"), F.round("value").alias("minutes"), F.lit(2).alias("goals"), (k % 4).alias("penalties"), (k % 3).alias("own_goals"))
    return X.rare_event_prior(facts).select("player_id", "role", F.round("penalties_rate", 8).alias("penalties_rate"), F.round("own_goals_rate", 8).alias("own_goals_rate"))


@register("sample_archive", "WITH t AS (SELECT GREATEST(1, COUNT(*) // 32) AS n FROM customer) SELECT 'match-' || CAST((c_custkey % (2 * n)) // 2 AS VARCHAR) AS match_id, 50 * COUNT(*) AS samples, 0::BIGINT AS simulated_again FROM customer, t GROUP BY 1")
def sample_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of half of the fixtures are archived, then of all, then asked for once more: nothing is simulated twice."""
    fixtures, players = squads(spark, sf)
    place = folder(spark, f"archive-{uuid.uuid4().hex}")
    half = fixtures.filter(F.pmod(F.xxhash64("match_id"), F.lit(2)) == 0)
    for some in (half, fixtures):
        sinks.archived_samples(spark, place, some, players.join(some.select("match_id"), "match_id", "left_semi"), runs=50, block=50, seed=13)
    samples, again = sinks.archived_samples(spark, place, fixtures, players, runs=50, block=50, seed=13)
    return samples.groupBy("match_id").agg(F.count("*").alias("samples"), F.lit(again).cast("bigint").alias("simulated_again"))


@register("appended_runs", "SELECT 'b' AS run_id, l_returnflag AS target, COUNT(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'a', l_returnflag, COUNT(*) FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL")
def appended_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two runs, the second written twice: its rows are there once, the first run's stay."""
    place = folder(spark, f"predictions-{uuid.uuid4().hex}")
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("target"), "l_linenumber")
    for run_id, part in (("a", rows.filter("l_linenumber = 1")), ("b", rows.filter("l_linenumber = 1")), ("b", rows)):
        sinks.append_run(part, place, run_id)
    return spark.read.parquet(place).groupBy("run_id", "target").agg(F.count("*").alias("n"))


@register("multirole_lineups")
def multirole_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Per team the mean points of its best eleven with substitutions, where every third player has a second role."""
    fixtures, players = squads(spark, sf)
    weights = {"goals": 3.0, "assists": 1.0, "yellow_cards": -0.5, "own_goals": -2.0}
    scored = X.team_samples(fixtures, players, lambda mine: O.sample_points(mine, 6.0, weights), runs=500, block=500, seed=17)
    second = {"DEF": "MID", "MID": "FWD", "FWD": "MID"}

    def value(team: pd.DataFrame) -> pd.DataFrame:
        names, first, p, a = X.team_arrays(team)
        roles = [(r, second[r]) if r in second and int(i) % 3 == 0 else (r,) for i, r in zip(names, first, strict=True)]
        name, chosen, _ = D.best_lineup(p.mean(axis=0), roles, FORMATIONS)
        bench = sorted(set(range(len(roles))) - set(chosen), key=lambda i: (-p[:, i].mean(), i))
        total = D.multirole_points(p, a, roles, chosen, bench, list(FORMATIONS.values()))
        return pd.DataFrame({"match_id": team["match_id"].iloc[0], "side": team["side"].iloc[0], "formation": name, "points": round(float(total.mean()), 6)}, index=[0])

    return scored.groupBy("match_id", "side").applyInPandas(value, "match_id string, side string, formation string, points double")


@register("count_model_arena")
def count_model_arena(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in a year: each candidate's loss over the folds, and which one is used."""
    orders, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season")).agg(F.count("*").alias("n"))
    seasons = orders.select(F.year("o_orderdate").alias("season")).distinct()
    every = c.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").crossJoin(F.broadcast(seasons))  # a row for each year
    rows = every.join(counts, ["c_custkey", "season"], "left").select("season", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    found = L.select_regressor(rows, ["c_acctbal", "nation"], "n", "season", count=True, kinds=("linear", "poisson", "hurdle"), group="c_mktsegment")
    return spark.createDataFrame([(k, round(v, 6), k == found.name, found.radius) for k, v in found.scores.items()], "candidate string, deviance double, used boolean, radius double")
