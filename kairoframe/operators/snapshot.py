"""The feature snapshot of players before fixtures, from versioned histories.

Inputs (names of columns; times are UTC):

* candidates: snapshot_row_id, player_id, team_id, opponent_team_id, match_id, prediction_cutoff, kickoff_at, home_flag, referee_id (optional)
* player_history: player_id, event_time, available_at, minutes, started, event_statistics_available, goals, assists, xg, xa, shots, tackles, interceptions, saves
* team_history: team_id, event_time, available_at, goals_for, goals_against, xg_for, xg_against, cards, penalties, referee_id
* referee_history: referee_id, event_time, available_at, cards, penalties (derived from team_history if not given)

Team, opponent and referee features are made once for each context (key and
cutoff), not for each player.  Counts and sums are zero without history, rates
stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import require, staged, with_defaults
from . import folds
from . import temporal as T

#: Prior means and strengths of a referee's smoothed rates.
CARDS_PRIOR, CARDS_STRENGTH = 4.5, 5.0
PENALTIES_PRIOR, PENALTIES_STRENGTH = 0.25, 10.0
PLAYER_METRICS = ("goals", "assists", "xg", "xa", "shots", "tackles", "interceptions", "saves")
ZERO = ("player_history_count", "event_history_count", "minutes_last_1", "minutes_last_3", "minutes_last_5", "minutes_last_10", "starts_last_5", "team_history_count", "team_goals_for_last_5", "team_goals_against_last_5", "schedule_congestion_14d", "opponent_history_count", "opponent_goals_for_last_5", "opponent_goals_against_last_5", "referee_history_count")
LINEAGE = ("player_max_available_at", "team_max_available_at", "opponent_max_available_at", "referee_max_available_at")
CUTOFF = "prediction_cutoff"


#: What a team's schedule looks back on, in microseconds.
CONGESTED = 14 * 86_400_000_000
_ALL = 1 << 30


def _histories(contexts: DataFrame, history: DataFrame, on: tuple[str, str], fields: list[str], limit: int, horizon: int = 0, measures: dict[str, tuple] | None = None) -> DataFrame:
    """contexts with their last visible events or measures of them, one version of each; equal versions fall to a hash of the row."""
    h = history.withColumn("_tie", F.xxhash64(*history.columns))
    return folds.recent_as_of(contexts, h, on, CUTOFF, "event_time", "available_at", [F.desc("available_at"), F.col("_tie")], fields, limit, horizon, measures=measures)


def player_features(candidates: DataFrame, history: DataFrame) -> DataFrame:
    fields = ["minutes", "started", "event_statistics_available", *PLAYER_METRICS]
    history = history.withColumn("event_statistics_available", F.col("event_statistics_available").cast("int"))
    played = "bigint" if dict(history.dtypes)["minutes"] in ("tinyint", "smallint", "int", "bigint") else "double"
    measures = {
        "event_history_count": ("ones", "event_statistics_available", 10),
        **{f"minutes_last_{n}": ("sum", "minutes", n) for n in (1, 3, 5, 10)},
        "starts_last_5": ("sum", "started", 5),
        "goals_last_5": ("sum", "goals", 5),
        "assists_last_5": ("sum", "assists", 5),
        "minutes_ewma_10": ("ewma", "minutes", 10),
        **{f"{c}_per90_last_{n}": ("rate", c, "minutes", n) for c, n in (("xg", 10), ("xa", 10), ("shots", 5), ("tackles", 10), ("interceptions", 10), ("saves", 10))},
        "minutes_volatility_10": ("stddev", "minutes", 10),
        "minutes_trend_5": ("trend", "minutes", 5),
    }
    whole = dict.fromkeys(("event_history_count", "starts_last_5"), "bigint") | {f"minutes_last_{n}": played for n in (1, 3, 5, 10)}
    found = _histories(candidates.select("snapshot_row_id", "player_id", CUTOFF), history, ("player_id", "player_id"), fields, 10, measures=measures)
    return found.select("snapshot_row_id", F.col("held").alias("player_history_count"), *[F.col(m).cast(whole.get(m, "double")).alias(m) for m in measures], F.col("known").alias("player_max_available_at"))


def team_features(candidates: DataFrame, history: DataFrame) -> DataFrame:
    contexts = candidates.select("team_id", CUTOFF, "kickoff_at").distinct()
    found = _histories(contexts, history, ("team_id", "team_id"), ["goals_for", "goals_against", "xg_for", "xg_against"], 10, CONGESTED)
    lately = F.col(CUTOFF) - F.expr("INTERVAL '14' DAY")
    return found.select(
        "team_id",
        CUTOFF,
        "kickoff_at",
        T.array_count("recent", 10).alias("team_history_count"),
        T.array_sum("recent", "goals_for", 5).alias("team_goals_for_last_5"),
        T.array_sum("recent", "goals_against", 5).alias("team_goals_against_last_5"),
        T.array_ewma("recent", "xg_for", 10).alias("team_xg_for_ewma_10"),
        T.array_ewma("recent", "xg_against", 10).alias("team_xg_against_ewma_10"),
        F.datediff("kickoff_at", F.get("recent", 0)["event_time"]).alias("rest_days"),
        T.array_count("recent", _ALL, lambda x: x["event_time"] >= lately).alias("schedule_congestion_14d"),
        F.col("known").alias("team_max_available_at"),
    )


def opponent_features(candidates: DataFrame, history: DataFrame) -> DataFrame:
    contexts = candidates.select("opponent_team_id", CUTOFF).distinct()
    measures = {"opponent_goals_for_last_5": ("sum", "goals_for", 5), "opponent_goals_against_last_5": ("sum", "goals_against", 5), "opponent_xg_against_ewma_10": ("ewma", "xg_against", 10)}
    found = _histories(contexts, history, ("opponent_team_id", "team_id"), ["goals_for", "goals_against", "xg_against"], 10, measures=measures)
    return found.select("opponent_team_id", CUTOFF, F.col("held").alias("opponent_history_count"), *measures, F.col("known").alias("opponent_max_available_at"))


def referee_features(candidates: DataFrame, history: DataFrame) -> DataFrame:
    contexts = candidates.filter("referee_id IS NOT NULL").select("referee_id", CUTOFF).distinct()
    found = _histories(contexts, history, ("referee_id", "referee_id"), ["cards", "penalties"], 20, measures={c: ("sum", c, 20) for c in ("cards", "penalties")})
    n = F.col("held").cast("double")
    return found.select(
        "referee_id",
        CUTOFF,
        F.col("held").alias("referee_history_count"),
        T.smoothed(F.col("cards"), n, CARDS_PRIOR, CARDS_STRENGTH).alias("referee_cards_per_match_20"),
        T.smoothed(F.col("penalties"), n, PENALTIES_PRIOR, PENALTIES_STRENGTH).alias("referee_penalties_per_match_20"),
        F.col("known").alias("referee_max_available_at"),
    )


def referee_history(team_history: DataFrame) -> DataFrame:
    """A referee's events from the two teams' versions.

    At every instant at which a team of the match has a version, each team's
    last version counts; a sum stands only if there are exactly two teams and
    both know the value.
    """
    keys = ["referee_id", "event_time"]
    rows = team_history.filter("referee_id IS NOT NULL").select(*keys, "team_id", "available_at", "cards", "penalties")
    rows = T.latest(rows, [*keys, "team_id", "available_at"], [F.xxhash64("cards", "penalties")])
    grid = rows.select(*keys, "available_at").distinct().join(rows.select(*keys, "team_id").distinct(), keys)
    known = T.asof_join(grid, rows.withColumnRenamed("available_at", "_seen"), [*keys, "team_id"], "available_at", "_seen", ["cards", "penalties"]).filter("_seen IS NOT NULL")
    both = lambda c: F.when((F.count("*") == 2) & (F.count(c) == 2), F.sum(c)).alias(c)
    return known.groupBy(*keys, "available_at").agg(both("cards"), both("penalties"))


def build(candidates: DataFrame, player_history: DataFrame, team_history: DataFrame, referees: DataFrame | None = None) -> DataFrame:
    """All candidates with their features; the leakage guard is in the plan."""
    require(candidates, ["snapshot_row_id", "player_id", "team_id", "opponent_team_id", "match_id", CUTOFF, "kickoff_at", "home_flag"])
    require(player_history, ["player_id", "event_time", "available_at", "minutes", "started"])
    require(team_history, ["team_id", "event_time", "available_at", "goals_for", "goals_against"])
    candidates = with_defaults(candidates, {"referee_id": None}, {"referee_id": "string"})
    players = with_defaults(player_history, {"event_statistics_available": 1, **dict.fromkeys(PLAYER_METRICS)}, {"event_statistics_available": "int"})
    teams = with_defaults(team_history, dict.fromkeys(("xg_for", "xg_against", "cards", "penalties", "referee_id")), {"referee_id": "string"})
    # every family reads its history twice and the candidates once or twice
    candidates, players, teams = staged(candidates, "candidates"), staged(players, "player-history"), staged(teams, "team-history")
    whistles = staged(referee_history(teams), "referee-history") if referees is None else with_defaults(referees, dict.fromkeys(("cards", "penalties")))
    judged = referee_features(candidates, whistles).withColumnsRenamed({"referee_id": "_referee", CUTOFF: "_cutoff"})
    joined = (
        candidates.join(player_features(candidates, players), "snapshot_row_id", "left")
        .join(team_features(candidates, teams), ["team_id", CUTOFF, "kickoff_at"], "left")
        .join(opponent_features(candidates, teams), ["opponent_team_id", CUTOFF], "left")
        .join(judged, F.col("referee_id").eqNullSafe(F.col("_referee")) & (F.col(CUTOFF) == F.col("_cutoff")), "left")
        .drop("_referee", "_cutoff")
        .fillna(0, subset=list(ZERO))
    )
    return T.require_no_future(joined, CUTOFF, LINEAGE)


# ------------------------------------------------------------- from facts


def any_event(values: list[Column]) -> Column:
    """1 if one is positive, else null if one is null, else 0."""
    positive = F.lit(False)
    missing = F.lit(False)
    for v in values:
        positive = positive | F.coalesce(v > 0, F.lit(False))
        missing = missing | v.isNull()
    return F.when(positive, 1.0).when(missing, None).otherwise(0.0)


def player_versions(stats: DataFrame, order: list[Column]) -> DataFrame:
    """Full versions of a player's match from partial updates (player_id, match_id, event_time, available_at, metrics)."""
    columns = [c for c in ("minutes", "started", "event_statistics_available", *PLAYER_METRICS) if c in stats.columns]
    return T.merge_versions(stats, ["player_id", "match_id", "event_time"], "available_at", order, columns)


def team_versions(updates: DataFrame, order: list[Column]) -> DataFrame:
    """As for players; a version counts from when both teams' goals are known."""
    columns = [c for c in ("goals_for", "goals_against", "xg_for", "xg_against", "cards", "penalties") if c in updates.columns]
    merged = T.merge_versions(updates, ["team_id", "match_id", "event_time"], "available_at", order, columns)
    return merged.filter("goals_for IS NOT NULL AND goals_against IS NOT NULL")


def labels(rows: DataFrame) -> DataFrame:
    """Training labels of finished matches.

    rows: snapshot_row_id, season, role, started, minutes, scored, conceded,
    covered (event statistics are there) and the observed numbers goals,
    assists, saves, yellow_cards, red_cards, penalties, base_rating.
    """
    covered = F.col("covered")
    number = lambda c: F.when(covered, F.col(c).cast("double"))
    happened = lambda c: F.when(covered & F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))
    keeper = F.col("role") == "GK"
    made = {
        "start_probability": F.col("started").cast("double"),
        "appearance_probability": (F.col("minutes") > 0).cast("double"),
        "expected_minutes": F.col("minutes").cast("double"),
        "goal_probability": happened("goals"),
        "expected_goals": number("goals"),
        "assist_probability": happened("assists"),
        "expected_assists": number("assists"),
        "team_goals": F.col("scored").cast("double"),
        "team_goals_conceded": F.col("conceded").cast("double"),
        "clean_sheet_probability": (F.col("conceded") == 0).cast("double"),
        "goalkeeper_saves": F.when(keeper, number("saves")),
        "goalkeeper_goals_conceded": F.when(keeper, F.col("conceded").cast("double")),
        "yellow_card_probability": happened("yellow_cards"),
        "red_card_probability": happened("red_cards"),
        "penalty_involvement": happened("penalties"),
        "base_rating": number("base_rating"),
    }
    return rows.select("snapshot_row_id", "season", F.col("role").alias("football_role"), *[c.alias(f"label_{n}") for n, c in made.items()])


def upcoming_memberships(fixtures: DataFrame, observed: DataFrame, transfers: DataFrame, lineups: DataFrame, cutoff: Column, days: int = 365) -> DataFrame:
    """(match_id, team_id, player_id, role, available_at): who plays for whom at each upcoming fixture.

    fixtures: match_id, home_team_id, away_team_id, kickoff_at; observed: the
    last observation of each player (player_id, event_time, team_id, role,
    available_at); transfers: player_id, transfer_date, to_team_id, role (of a
    player without observation), available_at, id; lineups: match_id,
    player_id, team_id, role, event_time, available_at, id.

    Evidence is folded in order: the observation if not older than `days`,
    transfers known by the cutoff that are not after the kickoff nor before
    the observation (no new club ends the membership), then the fixture's own
    line-ups.  A transfer keeps the role known before it.
    """
    seen = observed.filter(F.to_date("event_time") >= F.date_sub(F.to_date(cutoff), days))
    moves = transfers.filter(F.col("available_at") <= cutoff).withColumnRenamed("role", "own_role").join(observed.select("player_id", F.to_date("event_time").alias("_last"), F.col("role").alias("_role")), "player_id", "left")
    moves = moves.filter(F.col("_last").isNull() | (F.col("transfer_date") >= F.col("_last")))
    sheets = lineups.filter(F.col("available_at") <= cutoff)
    step = lambda kind, at, team, role, known, tie: F.struct(F.lit(kind).alias("kind"), at.cast("timestamp").alias("at"), known.alias("known"), tie.cast("string").alias("tie"), team.alias("team"), role.alias("role"))
    games = fixtures.select("match_id", "kickoff_at", "home_team_id", "away_team_id")
    # Only players whom some evidence puts into one of a fixture's teams can end there.
    sides = games.select("match_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    hinted = seen.select("player_id", "team_id").unionByName(moves.select("player_id", F.col("to_team_id").alias("team_id"))).distinct()
    pairs = hinted.join(sides, "team_id").select("match_id", "player_id").unionByName(sheets.join(games.select("match_id"), "match_id", "left_semi").select("match_id", "player_id")).distinct()
    a = pairs.join(seen.select("player_id", step(0, F.col("event_time"), F.col("team_id"), F.col("role"), F.col("available_at"), F.lit("")).alias("s")), "player_id").select("match_id", "player_id", "s")
    steps_of_moves = moves.select("player_id", "transfer_date", step(1, F.col("transfer_date"), F.col("to_team_id"), F.coalesce("_role", "own_role"), F.col("available_at"), F.col("id")).alias("s"))
    b = pairs.join(games.select("match_id", "kickoff_at"), "match_id").join(steps_of_moves, "player_id").filter(F.col("transfer_date") <= F.to_date("kickoff_at")).select("match_id", "player_id", "s")
    c = games.select("match_id").join(sheets.select("match_id", "player_id", step(2, F.col("available_at"), F.col("team_id"), F.col("role"), F.col("available_at"), F.col("id")).alias("s")), "match_id")
    steps = a.unionByName(b).unionByName(c).groupBy("match_id", "player_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    start = F.struct(F.lit(None).cast("string").alias("team"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("timestamp").alias("known"))

    def fold(m, s):
        role = F.coalesce(s["role"], m["role"])
        gone = (s["kind"] == 1) & s["team"].isNull()
        kept = F.struct(F.when(gone, None).otherwise(s["team"]).alias("team"), role.alias("role"), s["known"].cast("timestamp").alias("known"))
        return F.when(role.isNull() & ~gone, m).otherwise(kept)

    folded = steps.select("match_id", "player_id", F.aggregate("steps", start, fold).alias("m")).filter("m.team IS NOT NULL AND m.role IS NOT NULL")
    named = folded.join(games, "match_id").filter((F.col("m.team") == F.col("home_team_id")) | (F.col("m.team") == F.col("away_team_id")))
    return named.select("match_id", F.col("m.team").alias("team_id"), "player_id", F.col("m.role").alias("role"), F.col("m.known").alias("available_at"))


def confirmed_sheet(lineups: DataFrame) -> DataFrame:
    """The latest sheet (match_id, team_id, available_at) of each team that has eleven different starters."""
    sheet = lineups.groupBy("match_id", "team_id", "available_at").agg(F.count_if("is_starting").alias("starters"), F.count_distinct(F.when(F.col("is_starting"), F.col("player_id"))).alias("different"), F.count("*").alias("n"), F.count_distinct("player_id").alias("players"))
    w = Window.partitionBy("match_id", "team_id").orderBy(F.desc("available_at"))
    return sheet.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND starters = 11 AND different = 11 AND n = players").select("match_id", "team_id", "available_at")
