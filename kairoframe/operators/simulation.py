"""Monte-Carlo simulation of fixtures, many runs side by side.

A fixture's runs are dealt in blocks of rows (fixture, block), each with a seed
derived from (seed, fixture, block); a block is simulated as arrays of runs by
players, so Python loops go over goals and teams, not over runs.  Blocks are
independent and repeat exactly when a task is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a player that the simulator reads.
PLAYER = (
    "player_id string, side string, position string, availability double, start double, appearance double, expected_minutes double, minutes_sd double, "
    "goal_weight double, assist_weight double, yellow double, red double, saves_per90 double, penalty_weight double, own_goal_weight double"
)
#: Columns of a fixture.
FIXTURE = "match_id string, home_mean double, away_mean double, shared double, assisted double, substitutions int, penalty_share double, own_goal_share double, missed_per_goal double, penalty_save double"
COUNTS = ("minutes", "goals", "assists", "yellow_cards", "red_cards", "saves", "goals_conceded", "penalties_scored", "penalties_missed", "penalties_saved", "own_goals")
SAMPLE = "match_id string, run bigint, player_id string, side string, position string, started boolean, clean_sheet boolean, " + ", ".join(f"{c} int" for c in COUNTS)
#: Minutes that the ten outfield places of a team share.
OUTFIELD_MINUTES = 900


def problems(players: DataFrame) -> DataFrame:
    """(match_id, side, problem) of teams that cannot be simulated."""
    bad = F.exists(F.array(*[F.col(c) for c in ("availability", "start", "appearance", "yellow", "red")]), lambda p: p.isNull() | (p < 0) | (p > 1))
    team = players.groupBy("match_id", "side").agg(F.count_if(F.col("position") == "GK").alias("keepers"), F.count_if(F.col("position") != "GK").alias("outfield"), F.count_if(bad).alias("bad"))
    said = F.when(F.col("keepers") < 1, "no goalkeeper").when(F.col("outfield") < 10, "fewer than ten outfield players").when(F.col("bad") > 0, "a probability outside [0, 1]")
    return team.select("match_id", "side", said.alias("problem")).filter("problem IS NOT NULL")


def _top(rng: np.random.Generator, weight: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row k columns without replacement by weight (Gumbel keys), as a mask; fewer if fewer are allowed."""
    key = np.where(allowed, np.log(np.maximum(weight, 1e-9)) + rng.gumbel(size=allowed.shape), -np.inf)
    if k == 0:
        return np.zeros_like(allowed)
    k = min(k, key.shape[1])
    chosen = np.zeros_like(allowed)
    np.put_along_axis(chosen, np.argpartition(-key, k - 1, axis=1)[:, :k], True, axis=1)
    return chosen & allowed


def shared_minutes(raw: np.ndarray, mask: np.ndarray, total: int = OUTFIELD_MINUTES, low: int = 1, high: int = 90) -> np.ndarray:
    """Whole minutes per row that add up to total: one shift for all of a row's players, clipped to [low, high].

    The shift is where the sum, in pieces a straight line, reaches the total;
    rounding gives the largest fractions the minutes that are left.
    """
    # The sum grows with the shift in straight pieces; they bend where a player leaves the low end or reaches the high one.
    bends = np.concatenate([np.where(mask, low - raw, np.inf), np.where(mask, high - raw, np.inf)], axis=1)
    order = np.argsort(bends, axis=1)
    bends = np.minimum(np.take_along_axis(bends, order, axis=1), 200.0)
    slope = np.cumsum(np.where(order < raw.shape[1], 1, -1), axis=1)
    sums = mask.sum(axis=1)[:, None] * low + np.concatenate([np.zeros((len(raw), 1)), np.cumsum(slope[:, :-1] * np.diff(bends, axis=1), axis=1)], axis=1)
    last = np.maximum((sums <= total).sum(axis=1) - 1, 0)
    at = np.arange(len(raw))
    rise = slope[at, last]
    down = bends[at, last] + np.where(rise > 0, (total - sums[at, last]) / np.maximum(rise, 1), 0.0)
    value = np.where(mask, np.clip(raw + down[:, None], low, high), 0)
    whole = np.floor(value + 1e-9)
    order = np.argsort(np.argsort(-np.where(mask & (whole < high), value - whole, -1), axis=1), axis=1)
    return (whole + (order < (total - whole.sum(axis=1))[:, None])).astype(np.int32)


def _pick(rng: np.random.Generator, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One column for each of the rows by weight; -1 where all weights are zero."""
    edges = np.cumsum(weight[rows], axis=1)
    total = edges[:, -1]
    at = (edges <= (rng.random(len(rows)) * total)[:, None]).sum(axis=1)
    return np.where(total > 0, np.minimum(at, weight.shape[1] - 1), -1)


def _allocate(rng: np.random.Generator, counts: np.ndarray, weight: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """Multinomial counts per row; rows whose weights are all zero use the fallback."""
    weight = np.where(weight.sum(axis=1, keepdims=True) > 0, weight, fallback)
    out = np.zeros(weight.shape, dtype=np.int32)
    for k in range(int(counts.max(initial=0))):
        rows = np.flatnonzero(counts > k)
        at = _pick(rng, weight, rows)
        np.add.at(out, (rows[at >= 0], at[at >= 0]), 1)
    return out


def _lineup(rng: np.random.Generator, team: pd.DataFrame, runs: int, substitutions: int) -> tuple[np.ndarray, np.ndarray]:
    """(started, minutes), runs by players."""
    keeper = (team["position"] == "GK").to_numpy()
    p, start, appear = (team[c].to_numpy() for c in ("availability", "start", "appearance"))
    fit = rng.random((runs, len(team))) < p
    for _ in range(50):
        short = np.flatnonzero((fit[:, keeper].sum(axis=1) < 1) | (fit[:, ~keeper].sum(axis=1) < 10))
        if not len(short):
            break
        fit[short] = rng.random((len(short), len(team))) < p
    else:
        raise ValueError("a team has hardly ever eleven available players")
    started = _top(rng, start, fit & keeper, 1) | _top(rng, start, fit & ~keeper, 10)
    enters = np.clip((appear - start) / np.maximum(1 - start, 1e-9), 0, 1)
    bench = fit & ~keeper & ~started & (rng.random(fit.shape) < enters)
    bench = _top(rng, appear, bench, substitutions)
    raw = np.clip(rng.normal(team["expected_minutes"].to_numpy(), np.maximum(team["minutes_sd"].to_numpy(), 1.0), fit.shape), 1, 90)
    minutes = shared_minutes(raw, (started | bench) & ~keeper)
    minutes[started & keeper] = 90
    return started, minutes


def simulate_sides(fixture, team: pd.DataFrame, runs: int, seed: int) -> dict[str, tuple[pd.DataFrame, dict[str, np.ndarray]]]:
    """For each side its players and, by name, their samples (COUNTS, started, clean_sheet) as arrays, runs by players."""
    rng = np.random.default_rng(seed)
    common = fixture.shared * min(fixture.home_mean, fixture.away_mean)
    both = rng.poisson(common, runs)
    goals = {s: both + rng.poisson(max(m - common, 0), runs) for s, m in (("home", fixture.home_mean), ("away", fixture.away_mean))}
    sides = {s: team[team["side"] == s].reset_index(drop=True) for s in ("home", "away")}
    lineups = {s: _lineup(rng, t, runs, fixture.substitutions) for s, t in sides.items()}
    out = {s: {c: np.zeros((runs, len(t)), dtype=np.int32) for c in COUNTS} for s, t in sides.items()}
    means = {"home": fixture.home_mean, "away": fixture.away_mean}
    for side, other in (("home", "away"), ("away", "home")):
        t, o, mine, theirs = sides[side], sides[other], out[side], out[other]
        started, minutes = lineups[side]
        outfield = np.where((t["position"] != "GK").to_numpy(), minutes, 0).astype(float)
        mine["minutes"] = minutes
        penalties = rng.binomial(goals[side], fixture.penalty_share)
        rest = max(1 - fixture.penalty_share, 1e-9)
        own = rng.binomial(goals[side] - penalties, min(1.0, fixture.own_goal_share / rest))
        open_play = goals[side] - penalties - own
        missed = rng.poisson(means[side] * fixture.missed_per_goal, runs)
        saved = rng.binomial(missed, fixture.penalty_save)
        other_keeper = lineups[other][0] & (o["position"] == "GK").to_numpy()
        theirs["penalties_saved"] += np.where(other_keeper, saved[:, None], 0).astype(np.int32)
        theirs["saves"] += np.where(other_keeper, saved[:, None], 0).astype(np.int32)
        theirs["own_goals"] += _allocate(rng, own, o["own_goal_weight"].to_numpy() * lineups[other][1], lineups[other][1].astype(float))
        mine["penalties_scored"] = _allocate(rng, penalties, t["penalty_weight"].to_numpy() * minutes, outfield)
        mine["penalties_missed"] = _allocate(rng, missed, t["penalty_weight"].to_numpy() * minutes, outfield)
        weight = t["goal_weight"].to_numpy() * minutes
        weight = np.where(weight.sum(axis=1, keepdims=True) > 0, weight, outfield)
        for k in range(int(open_play.max(initial=0))):
            rows = np.flatnonzero(open_play > k)
            scorer = _pick(rng, weight, rows)
            np.add.at(mine["goals"], (rows, scorer), 1)
            helped = rng.random(len(rows)) < fixture.assisted
            rows, scorer = rows[helped], scorer[helped]
            help_weight = t["assist_weight"].to_numpy() * minutes
            chosen = help_weight[rows]
            chosen[np.arange(len(rows)), scorer] = 0
            at = _pick(rng, chosen, np.arange(len(rows)))
            np.add.at(mine["assists"], (rows[at >= 0], at[at >= 0]), 1)
        mine["goals"] += mine["penalties_scored"]
        for card, c in (("yellow", "yellow_cards"), ("red", "red_cards")):
            mine[c] = (rng.random(minutes.shape) < 1 - (1 - t[card].to_numpy()) ** (minutes / 90)).astype(np.int32)
        keeper = started & (t["position"] == "GK").to_numpy()
        mine["goals_conceded"] = np.where(keeper, goals[other][:, None], 0).astype(np.int32)
        expected = means[other] * fixture.missed_per_goal * fixture.penalty_save
        rate = np.maximum(t["saves_per90"].to_numpy() * minutes / 90 - expected, 0)
        mine["saves"] += np.where(keeper, rng.poisson(rate), 0).astype(np.int32)
        mine["started"], mine["clean_sheet"] = started, (goals[other] == 0)[:, None] & (minutes >= 60)
    return {side: (sides[side], out[side]) for side in ("home", "away")}


def simulate_block(fixture, team: pd.DataFrame, runs: int, seed: int) -> pd.DataFrame:
    """`runs` runs of a fixture, a row for each run and player; team has the players of both sides."""
    return sample_rows(fixture.match_id, simulate_sides(fixture, team, runs, seed))


def sample_rows(match_id: str, sides: dict[str, tuple[pd.DataFrame, dict[str, np.ndarray]]]) -> pd.DataFrame:
    frames = []
    for side, (t, mine) in sides.items():
        runs, n = mine["minutes"].shape
        frame = {"match_id": match_id, "run": np.repeat(np.arange(runs), n), "player_id": np.tile(t["player_id"], runs), "side": side, "position": np.tile(t["position"], runs)}
        frames.append(pd.DataFrame(frame | {c: mine[c].ravel() for c in ("started", "clean_sheet", *COUNTS)}))
    return pd.concat(frames, ignore_index=True)


Digest = Callable[[str, dict[str, tuple[pd.DataFrame, dict[str, np.ndarray]]]], pd.DataFrame]


def simulated(fixtures: DataFrame, players: DataFrame, digest: Digest, schema: str, runs: int = 10_000, block: int = 1000, seed: int = 0) -> DataFrame:
    """What `digest` makes of every block of runs (match_id, sides as `simulate_sides` gives them), with the block's number; players have a match_id beside the columns of PLAYER.

    A fixture's players are two squads, so they travel with each block.  What
    follows from a run, or can be added up, is best taken from a block's
    arrays, so that no row for each run and player leaves the task.
    """
    names = [x.split()[0] for x in PLAYER.split(", ")]
    spark = fixtures.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes, much work: not for the size to say
    squads = players.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("squad"))
    blocks = fixtures.join(squads, "match_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-runs // block) - 1))))
    blocks = blocks.withColumn("seed", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "match_id", F.col("block").cast("string")), 256), 1, 13), 16, 10).cast("bigint"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                team = pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in row.squad], columns=names)
                size = min(block, runs - row.block * block)
                yield digest(row.match_id, simulate_sides(row, team, size, int(row.seed))).assign(block=row.block)

    return blocks.repartition(tasks, "match_id", "block").mapInPandas(run, f"{schema}, block int")


def simulate(fixtures: DataFrame, players: DataFrame, runs: int = 10_000, block: int = 1000, seed: int = 0) -> DataFrame:
    """Sample rows (SAMPLE) of every fixture and run."""
    rows = simulated(fixtures, players, sample_rows, SAMPLE, runs, block, seed)
    return rows.withColumn("run", F.col("run") + F.col("block") * block).drop("block")


def team_samples(fixtures: DataFrame, players: DataFrame, values: Callable[[dict[str, np.ndarray]], np.ndarray], runs: int = 10_000, block: int = 1000, seed: int = 0) -> DataFrame:
    """(match_id, side, player_id, position, block, points, appeared) with arrays over a block's runs; values: points from the samples by name."""

    def digest(match_id: str, sides) -> pd.DataFrame:
        frames = [pd.DataFrame({"match_id": match_id, "side": side, "player_id": t["player_id"], "position": t["position"], "points": list(values(mine).T), "appeared": list((mine["minutes"] > 0).T)}) for side, (t, mine) in sides.items()]
        return pd.concat(frames, ignore_index=True)

    return simulated(fixtures, players, digest, "match_id string, side string, player_id string, position string, points array<double>, appeared array<boolean>", runs, block, seed)


def team_arrays(team: pd.DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(players, positions, points, appeared) of a team's rows of `team_samples`; arrays are runs by players."""
    held = team.sort_values(["player_id", "block"])
    one = held.drop_duplicates("player_id")
    joined = lambda c: np.stack([np.concatenate(list(x)) for _, x in held.groupby("player_id", sort=True)[c]], axis=1)
    return one["player_id"].tolist(), one["position"].tolist(), joined("points"), joined("appeared").astype(bool)


#: Samples that a summary counts where they are above zero, and those that it takes the mean of.
_SEEN, _MEANS = ("goals", "assists", "yellow_cards", "red_cards"), ("saves", "goals_conceded", "penalties_scored", "penalties_missed", "penalties_saved", "own_goals")


def simulate_summaries(fixtures: DataFrame, players: DataFrame, runs: int = 10_000, block: int = 1000, seed: int = 0) -> DataFrame:
    """What `summarize` gives of `simulate`, from sums over the blocks and the sorted minutes; no sample is a row."""

    def digest(match_id: str, sides) -> pd.DataFrame:
        frames = []
        for t, mine in (sides[s] for s in ("home", "away")):
            sums = {"started": mine["started"].sum(axis=0), "appeared": (mine["minutes"] > 0).sum(axis=0), "clean": mine["clean_sheet"].sum(axis=0)}
            sums |= {f"seen_{c}": (mine[c] > 0).sum(axis=0) for c in _SEEN} | {f"sum_{c}": mine[c].sum(axis=0) for c in _MEANS}
            frames.append(pd.DataFrame({"match_id": match_id, "player_id": t["player_id"], "minutes": list(mine["minutes"].astype(np.int16).T), **sums}))
        return pd.concat(frames, ignore_index=True)

    counted = ["started", "appeared", "clean", *[f"seen_{c}" for c in _SEEN], *[f"sum_{c}" for c in _MEANS]]
    blocks = simulated(fixtures, players, digest, "match_id string, player_id string, minutes array<smallint>, " + ", ".join(f"{c} bigint" for c in counted), runs, block, seed)
    sums = blocks.groupBy("match_id", "player_id").agg(F.sort_array(F.flatten(F.collect_list("minutes"))).alias("m"), *[F.sum(c).alias(c) for c in counted])
    n = F.size("m")

    def percentile(p: float) -> Column:
        place = (n - 1) * F.lit(p)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        a, b = F.get("m", low).cast("double"), F.get("m", high).cast("double")
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    mean = lambda c: F.col(c).cast("double") / n
    return sums.select(
        "match_id",
        "player_id",
        (F.aggregate("m", F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double") / n).alias("mean_minutes"),
        percentile(0.5).alias("median_minutes"),
        percentile(0.1).alias("p10_minutes"),
        percentile(0.9).alias("p90_minutes"),
        mean("started").alias("start_probability"),
        mean("appeared").alias("appearance_probability"),
        *[mean(f"seen_{c}").alias(f"{c}_probability") for c in _SEEN],
        mean("clean").alias("clean_sheet_probability"),
        *[mean(f"sum_{c}").alias(f"mean_{c}") for c in _MEANS],
    )


def summarize(samples: DataFrame) -> DataFrame:
    """Per fixture and player the figures of the sampled distribution."""
    share = lambda c: F.avg(c.cast("double"))
    m = F.col("minutes")
    return samples.groupBy("match_id", "player_id").agg(
        F.avg(m).alias("mean_minutes"),
        F.percentile(m, 0.5).alias("median_minutes"),
        F.percentile(m, 0.1).alias("p10_minutes"),
        F.percentile(m, 0.9).alias("p90_minutes"),
        share(F.col("started")).alias("start_probability"),
        share(m > 0).alias("appearance_probability"),
        *[share(F.col(c) > 0).alias(f"{c}_probability") for c in ("goals", "assists", "yellow_cards", "red_cards")],
        share(F.col("clean_sheet")).alias("clean_sheet_probability"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("saves", "goals_conceded", "penalties_scored", "penalties_missed", "penalties_saved", "own_goals")],
    )


def rare_event_prior(facts: DataFrame, pseudo_minutes: float = 1800.0) -> DataFrame:
    """Per player an own-goal and penalty rate per minute, shrunk to the rate of the player's role.

    facts: player_id, role, minutes, goals, penalties, own_goals of valid rows
    (minutes over 0, counts not negative, penalties not above goals); a
    player's role is the one with most minutes in a row.
    """
    valid = facts.filter("minutes > 0 AND goals >= 0 AND penalties >= 0 AND own_goals >= 0 AND penalties <= goals")
    player = valid.groupBy("player_id").agg(F.max_by("role", F.struct("minutes", "role")).alias("role"), *[F.sum(c).cast("double").alias(c) for c in ("minutes", "penalties", "own_goals")])
    role = player.groupBy("role").agg(*[(F.sum(c) / F.sum("minutes")).alias(f"role_{c}") for c in ("penalties", "own_goals")])
    shrunk = [((F.col(c) + pseudo_minutes * F.col(f"role_{c}")) / (F.col("minutes") + pseudo_minutes)).alias(f"{c}_rate") for c in ("penalties", "own_goals")]
    return player.join(F.broadcast(role), "role").select("player_id", "role", *shrunk)  # a row for each role
