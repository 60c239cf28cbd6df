"""Parsers of provider files into typed rows: season results, match facts and operational JSON.

Each takes a DataFrame of raw columns (or of JSON texts) and gives rows of the
canonical model; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from .tables import require, with_defaults

# Names that providers use and the canonical names they stand for.
STAT_COLUMNS = {
    "HS": "home_shots",
    "AS": "away_shots",
    "HST": "home_shots_on_target",
    "AST": "away_shots_on_target",
    "HC": "home_corners",
    "AC": "away_corners",
    "HF": "home_fouls",
    "AF": "away_fouls",
    "HY": "home_yellow_cards",
    "AY": "away_yellow_cards",
    "HR": "home_red_cards",
    "AR": "away_red_cards",
}
ODDS_COLUMNS = {
    "B365H": "bet365_home",
    "B365D": "bet365_draw",
    "B365A": "bet365_away",
    "PSH": "pinnacle_home",
    "PSD": "pinnacle_draw",
    "PSA": "pinnacle_away",
    "AvgH": "market_average_home",
    "AvgD": "market_average_draw",
    "AvgA": "market_average_away",
}
STATUS = {
    "TBD": "scheduled",
    "NS": "scheduled",
    "FT": "finished",
    "AET": "finished",
    "PEN": "finished",
    "PST": "postponed",
    "CANC": "cancelled",
    "ABD": "abandoned",
    "AWD": "awarded",
    "WO": "forfeited",
    "SUSP": "suspended",
    "1H": "live",
    "HT": "live",
    "2H": "live",
    "ET": "live",
    "BT": "live",
    "P": "live",
    "INT": "suspended",
    "LIVE": "live",
}
STAT_NAMES = {
    "goal_assist": "assists",
    "total_scoring_att": "shots",
    "ontarget_scoring_att": "shots_on_target",
    "total_att_assist": "key_passes",
    "total_tackle": "tackles",
    "won_tackle": "tackles_won",
    "interception": "interceptions",
    "total_clearance": "clearances",
    "yellow_card": "yellow_cards",
    "red_card": "red_cards",
}
IDENTITY_COLUMNS = ("match_id", "match_date", "player_id", "player_name", "team_id", "team_name", "position", "mins_played", "competition", "season", "league")
COVERAGE_COLUMNS = ("total_pass", "accurate_pass", "total_scoring_att", "total_tackle", "saves", "goals", "goal_assist", "yellow_card", "red_card")
EVENT_TYPES = {
    1: "pass",
    2: "offside_pass",
    3: "dribble",
    4: "foul",
    5: "ball_out",
    6: "corner_awarded",
    7: "tackle",
    8: "interception",
    9: "turnover",
    10: "save",
    11: "claim",
    12: "clearance",
    13: "shot_missed",
    14: "shot_post",
    15: "shot_saved",
    16: "goal",
    17: "card",
    18: "substitution_off",
    19: "substitution_on",
    20: "player_retired",
    21: "player_returns",
    30: "period_end",
    32: "period_start",
    34: "lineup",
    35: "position_change",
    40: "formation_change",
    41: "punch",
    43: "deleted",
    44: "aerial_duel",
    45: "challenge",
    47: "card_rescinded",
    49: "ball_recovery",
    50: "dispossessed",
    51: "error",
    52: "goalkeeper_pickup",
    58: "penalty_faced",
    59: "goalkeeper_sweeper",
    61: "ball_touch",
    74: "blocked_pass",
    84: "deleted_after_review",
}
OWN_GOAL_QUALIFIER = "28"
DAY_FORMATS = ("dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm", "dd/MM/yyyy", "dd/MM/yy")
# End of the fixed values.


def number_map(df: DataFrame, columns: dict[str, str]) -> Column:
    """A map of canonical names to the numbers of those columns that there are; blanks are left out."""
    present = {c: n for c, n in columns.items() if c in df.columns}
    if not present:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in present.values()]), F.array(*[F.col(c).cast("string").try_cast("double") for c in present]))
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def result_available_at(kickoff: Column, precision: Column) -> Column:
    """When a result could be known: three hours after a known kickoff, or after the end of its day."""
    return F.when(precision == "minute", kickoff + F.expr("INTERVAL '3' HOUR")).otherwise(F.date_trunc("day", kickoff) + F.expr("INTERVAL '27' HOUR"))


def season_results(df: DataFrame, season: str) -> DataFrame:
    """Matches of a season's result file (string columns); rows without teams are left out."""
    require(df, ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"])
    df = with_defaults(df, {"Time": None, "Referee": None}, {"Time": "string", "Referee": "string"})
    written = F.trim(F.concat_ws(" ", "Date", F.nullif("Time", F.lit(""))))
    day = F.date_trunc("day", F.coalesce(*[F.try_to_timestamp(written, F.lit(f)) for f in DAY_FORMATS]))
    named = df.filter((F.coalesce("HomeTeam", F.lit("")) != "") & (F.coalesce("AwayTeam", F.lit("")) != ""))
    return named.select(
        F.concat_ws(":", F.lit(season), "Date", "HomeTeam", "AwayTeam").alias("source_record_id"),
        F.lit(season).alias("season"),
        day.alias("kickoff_at"),
        result_available_at(day, F.lit("date")).alias("available_at"),
        F.col("HomeTeam").alias("home_team"),
        F.col("AwayTeam").alias("away_team"),
        F.col("FTHG").cast("int").alias("home_score"),
        F.col("FTAG").cast("int").alias("away_score"),
        F.nullif("Referee", F.lit("")).alias("referee"),
        number_map(df, STAT_COLUMNS).alias("stats"),
        number_map(df, ODDS_COLUMNS).alias("odds"),
    )


def player_matches(df: DataFrame) -> DataFrame:
    """Player rows of matches with all other columns as a map of statistics.

    A match is covered if any of its rows has any of the coverage columns.
    """
    require(df, ["match_id", "match_date", "player_id", "player_name", "team_id", "team_name", "mins_played"])
    cover = [F.col(c).isNotNull() for c in COVERAGE_COLUMNS if c in df.columns]
    some = F.lit(False)
    for c in cover:
        some = some | c
    stats = {c: STAT_NAMES.get(c, c) for c in df.columns if c not in IDENTITY_COLUMNS}
    covered = F.bool_or(some).over(Window.partitionBy("match_id"))
    started = [F.col(c).cast("boolean") for c in ("is_starter", "started", "start", "game_started") if c in df.columns]
    position = F.col("position") if "position" in df.columns else F.lit(None).cast("string")
    written = F.col("match_date").cast("string")
    return df.select(
        F.concat_ws(":", "match_id", "player_id").alias("source_record_id"),
        F.col("match_id").cast("string").alias("match_id"),
        F.col("player_id").cast("string").alias("player_id"),
        F.col("player_name"),
        F.col("team_id").cast("string").alias("team_id"),
        F.col("match_date").try_cast("timestamp").alias("event_time"),
        result_available_at(F.col("match_date").try_cast("timestamp"), F.when(written.contains(":"), "minute").otherwise("date")).alias("available_at"),
        F.coalesce(F.col("mins_played").try_cast("int"), F.lit(0)).alias("minutes"),
        F.coalesce(*started, position.isNotNull()).alias("started"),
        covered.alias("event_statistics_available"),
        number_map(df, stats).alias("stats"),
    )


def lineups(df: DataFrame) -> DataFrame:
    require(df, ["match_id", "team_id", "player_id", "is_starter"])
    df = with_defaults(df, dict.fromkeys(("shirt_number", "position", "formation_place")), dict.fromkeys(("shirt_number", "position", "formation_place"), "string"))
    return df.select(F.concat_ws(":", F.lit("lineup"), "match_id", "player_id").alias("source_record_id"), "match_id", "team_id", "player_id", F.col("is_starter").cast("boolean").alias("is_starting"), F.col("shirt_number").try_cast("int").alias("shirt_number"), "position", F.col("formation_place").alias("formation_slot"))


def shots(df: DataFrame) -> DataFrame:
    """Shots without own goals, places from 0-100 to 0-1, and the result in words."""
    require(df, ["match_id", "event_id", "team_id", "player_id", "is_goal"])
    df = with_defaults(df, dict.fromkeys(("minute", "x", "y", "xg", "is_own_goal", "is_blocked")), {"minute": "int", "is_own_goal": "boolean", "is_blocked": "boolean"})
    result = F.when(F.col("is_goal"), "goal").when(F.coalesce("is_blocked", F.lit(False)), "blocked").otherwise("non_goal")
    return df.filter(~F.coalesce("is_own_goal", F.lit(False))).select(F.concat_ws(":", F.lit("shot"), "match_id", "event_id").alias("source_record_id"), "match_id", "team_id", "player_id", "minute", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"), "xg", result.alias("result"))


def shot_totals(df: DataFrame) -> DataFrame:
    """Per match and player: attempts, attempts with a value, their sum, and when the last was known."""
    return df.groupBy("match_id", "player_id").agg(F.count("*").alias("attempts"), F.count("xg").alias("with_xg"), F.sum("xg").alias("xg"), F.max("available_at").alias("available_at"))


def covered_xg(shots_reported: Column, attempts: Column, with_xg: Column, xg: Column) -> Column:
    """The shots' sum only if all reported shots are there and all have a value; no shots reported and none seen is 0."""
    n = F.coalesce(attempts, F.lit(0))
    return F.when((shots_reported == n) & (F.coalesce(with_xg, F.lit(0)) == n), F.coalesce(xg, F.lit(0.0)))


def events(df: DataFrame) -> DataFrame:
    """Typed events with qualifiers as a map; a goal with the own-goal qualifier is an own goal."""
    require(df, ["match_id", "event_id", "type_id", "minute", "second"])
    df = with_defaults(df, dict.fromkeys(("qualifier_json", "team_id", "player_id", "period_id", "x", "y")), dict.fromkeys(("qualifier_json", "team_id", "player_id"), "string") | {"period_id": "int"})
    qualifiers = F.coalesce(F.from_json("qualifier_json", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kind = F.coalesce(lookup(F.col("type_id").cast("string"), {str(k): v for k, v in EVENT_TYPES.items()}), F.lit("unclassified"))
    own = (kind == "goal") & F.map_contains_key(qualifiers, OWN_GOAL_QUALIFIER)
    second = F.coalesce(F.col("minute").cast("int"), F.lit(0)) * 60 + F.coalesce(F.col("second").cast("int"), F.lit(0))
    return df.select(F.concat_ws(":", F.lit("event"), "match_id", "event_id").alias("source_record_id"), "match_id", F.nullif("team_id", F.lit("")).alias("team_id"), F.nullif("player_id", F.lit("")).alias("player_id"), F.when(own, "own_goal").otherwise(kind).alias("event_type"), F.col("period_id").alias("period"), second.alias("second"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"), qualifiers.alias("qualifiers"))


def team_xg(df: DataFrame) -> DataFrame:
    """Two team rows for each game; values outside 0 to 20 are no values."""
    require(df, ["game_id", "date", "home_team", "away_team", "home_goals", "away_goals", "home_xg", "away_xg"])
    fine = lambda c: F.when(F.col(c).between(0, 20), F.col(c))
    side = lambda own, other, home: F.struct(F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), F.lit(home).alias("is_home"), F.col(f"{own}_goals").alias("goals_for"), F.col(f"{other}_goals").alias("goals_against"), fine(f"{own}_xg").alias("xg_for"), fine(f"{other}_xg").alias("xg_against"))
    return df.select(F.col("game_id").cast("string").alias("match_id"), F.col("date").try_cast("timestamp").alias("event_time"), F.inline(F.array(side("home", "away", True), side("away", "home", False))))


# ------------------------------------------------------------ operational JSON

_ID = "struct<id: bigint, name: string>"
ODDS = "fixture struct<id: bigint, date: string>, bookmakers array<struct<id: bigint, name: string, bets: array<struct<id: bigint, name: string, values: array<struct<value: string, odd: string>>>>>>"
STANDINGS = f"league struct<season: int, standings: array<array<struct<rank: int, team: {_ID}, points: int, all: struct<played: int, win: int, draw: int, lose: int, goals: struct<`for`: int, against: int>>>>>>"
TRANSFERS = f"player {_ID}, transfers array<struct<date: string, type: string, teams: struct<`in`: {_ID}, out: {_ID}>>>"
INJURIES = f"player struct<id: bigint, name: string, type: string, reason: string>, team {_ID}, fixture struct<id: bigint, date: string>"
FIXTURES = (
    f"fixture struct<id: bigint, date: string, referee: string, status: struct<short: string>>, league struct<id: int, season: int, round: string>, teams struct<home: {_ID}, away: {_ID}>, goals struct<home: int, away: int>, "
    f"statistics array<struct<team: {_ID}, statistics: array<struct<type: string, value: string>>>>, lineups array<struct<team: {_ID}, startXI: array<struct<player: struct<id: bigint, name: string, number: int, pos: string>>>, substitutes: array<struct<player: struct<id: bigint, name: string, number: int, pos: string>>>>>, "
    f"events array<struct<time: struct<elapsed: int, extra: int>, team: {_ID}, player: {_ID}, type: string, detail: string>>"
)


def rows_of(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed rows of JSON payloads ({"response": [...]}), beside observed_at; what does not parse gives no rows."""
    parsed = payloads.select("observed_at", F.from_json(column, f"response array<struct<{_as_fields(schema)}>>").alias("p"))
    return parsed.select("observed_at", F.explode("p.response").alias("r")).select("observed_at", "r.*")


def _as_fields(schema: str) -> str:
    """A DDL list of columns as the fields of a struct: the first space of each top-level item becomes a colon."""
    out, depth, item = [], 0, ""
    for c in f"{schema},":
        if c == "," and depth == 0:
            name, kind = item.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            item = ""
            continue
        depth += (c == "<") - (c == ">")
        item += c
    return ", ".join(out)


def fixture_matches(rows: DataFrame) -> DataFrame:
    status = lookup(F.col("fixture.status.short"), STATUS)
    done = status == "finished"
    week = F.regexp_extract(F.coalesce("league.round", F.lit("")), r" - (\d+)$", 1).try_cast("int")
    return rows.select(
        F.col("fixture.id").cast("string").alias("match_id"),
        F.format_string("%d-%d", "league.season", F.col("league.season") + 1).alias("season"),
        F.col("fixture.date").try_cast("timestamp").alias("kickoff_at"),
        F.when(F.col("fixture.status.short") == "TBD", "date").otherwise("minute").alias("kickoff_precision"),
        status.alias("status"),
        week.alias("matchweek"),
        F.col("teams.home.id").cast("string").alias("home_team"),
        F.col("teams.away.id").cast("string").alias("away_team"),
        F.when(done, F.col("goals.home")).alias("home_score"),
        F.when(done, F.col("goals.away")).alias("away_score"),
        F.col("fixture.referee").alias("referee"),
        F.col("observed_at").alias("available_at"),
    )


def fixture_lineups(rows: DataFrame) -> DataFrame:
    group = rows.select("observed_at", F.col("fixture.id").cast("string").alias("match_id"), F.explode("lineups").alias("g"))
    both = F.concat(F.transform(F.coalesce("g.startXI", F.array()), lambda x: F.struct(x["player"].alias("p"), F.lit(True).alias("s"))), F.transform(F.coalesce("g.substitutes", F.array()), lambda x: F.struct(x["player"].alias("p"), F.lit(False).alias("s"))))
    named = group.select("observed_at", "match_id", F.col("g.team.id").cast("string").alias("team_id"), F.explode(both).alias("e"))
    return named.select("match_id", "team_id", F.col("e.p.id").cast("string").alias("player_id"), F.col("e.s").alias("is_starting"), F.col("e.p.number").alias("shirt_number"), F.col("e.p.pos").alias("position"), F.col("observed_at").alias("available_at"))


def fixture_statistics(rows: DataFrame) -> DataFrame:
    """(match_id, side, statistic, value) of finished fixtures; percent signs are dropped."""
    group = rows.filter(lookup(F.col("fixture.status.short"), STATUS) == "finished").select(F.col("fixture.id").cast("string").alias("match_id"), "teams", F.explode("statistics").alias("g"))
    side = F.when(F.col("g.team.id") == F.col("teams.home.id"), "home").when(F.col("g.team.id") == F.col("teams.away.id"), "away")
    long = group.select("match_id", side.alias("side"), F.explode("g.statistics").alias("s"))
    return long.select("match_id", "side", F.col("s.type").alias("statistic"), F.rtrim(F.col("s.value"), F.lit("%")).try_cast("double").alias("value"))


def fixture_events(rows: DataFrame) -> DataFrame:
    long = rows.select("observed_at", F.col("fixture.id").cast("string").alias("match_id"), F.posexplode("events").alias("n", "e"))
    minute = F.coalesce("e.time.elapsed", F.lit(0)) + F.coalesce("e.time.extra", F.lit(0))
    return long.select(F.concat_ws(":", "match_id", F.lit("event"), "n").alias("source_record_id"), "match_id", F.col("e.team.id").cast("string").alias("team_id"), F.when(F.col("e.player.name").isNotNull(), F.col("e.player.id").cast("string")).alias("player_id"), F.col("e.type").alias("event_type"), F.col("e.detail").alias("event_subtype"), (minute * 60).alias("second"), F.col("observed_at").alias("available_at"))


def injuries(rows: DataFrame) -> DataFrame:
    day = F.to_date(F.col("fixture.date").try_cast("timestamp"))
    return rows.select(F.col("player.id").cast("string").alias("player_id"), F.col("team.id").cast("string").alias("team_id"), F.col("player.reason").alias("reason"), F.coalesce(F.lower("player.reason").contains("suspend"), F.lit(False)).alias("suspended"), F.when(F.col("player.type") == "Missing Fixture", "out").otherwise("doubtful").alias("status"), day.alias("starts_on"), day.alias("ends_on"), F.col("observed_at").alias("available_at"))


def standings(rows: DataFrame) -> DataFrame:
    item = rows.select("observed_at", "league.season", F.explode(F.flatten("league.standings")).alias("i"))
    return item.select(F.format_string("%d-%d", "season", F.col("season") + 1).alias("season"), F.col("i.team.id").cast("string").alias("team_id"), "i.rank", "i.points", "i.all.played", F.col("i.all.win").alias("won"), F.col("i.all.draw").alias("drawn"), F.col("i.all.lose").alias("lost"), F.col("i.all.goals.for").alias("goals_for"), F.col("i.all.goals.against").alias("goals_against"), F.col("observed_at").alias("available_at"))


def transfers(rows: DataFrame) -> DataFrame:
    long = rows.select("observed_at", F.col("player.id").cast("string").alias("player_id"), F.posexplode("transfers").alias("n", "t"))
    return long.select(F.concat_ws(":", F.lit("transfer"), "player_id", "t.date", "n").alias("source_record_id"), "player_id", F.col("t.teams.out.id").cast("string").alias("from_team"), F.col("t.teams.in.id").cast("string").alias("to_team"), F.col("t.date").try_cast("date").alias("transfer_date"), F.col("t.type").alias("transfer_type"), F.col("observed_at").alias("available_at"))


def odds(rows: DataFrame) -> DataFrame:
    """Three levels of offers, those without odds left out."""
    a = rows.select("observed_at", "fixture", F.explode("bookmakers").alias("b"))
    b = a.select("observed_at", "fixture", "b.name", F.explode("b.bets").alias("m"))
    c = b.select("observed_at", "fixture", "name", F.col("m.name").alias("market"), F.explode("m.values").alias("v"))
    return c.filter("v.odd IS NOT NULL").select(F.col("fixture.id").cast("string").alias("match_id"), F.col("name").alias("bookmaker"), "market", F.col("v.value").alias("selection"), F.col("v.odd").try_cast("decimal(10,4)").alias("decimal_odds"), F.col("observed_at").alias("available_at"))


def scheduled_matches(df: DataFrame, retrieved_at: Column) -> DataFrame:
    """Fixtures of a Parquet file: a written time gives minute precision; played ones were known after the match, others when retrieved."""
    require(df, ["match_id", "match_date", "home_team", "away_team", "home_team_id", "away_team_id", "match_status", "season"])
    df = with_defaults(df, dict.fromkeys(("home_score", "away_score")))
    written = F.col("match_date").cast("string")
    kickoff = written.try_cast("timestamp")
    precision = F.when(written.contains(":"), "minute").otherwise("date")
    status = F.lower(F.col("match_status"))
    played = status.isin("played", "finished", "ft")
    return df.select(
        F.col("match_id").cast("string").alias("match_id"),
        F.replace(F.col("season").cast("string"), F.lit("/"), F.lit("-")).alias("season"),
        kickoff.alias("kickoff_at"),
        precision.alias("kickoff_precision"),
        F.when(played, result_available_at(kickoff, precision)).otherwise(retrieved_at).alias("available_at"),
        F.col("home_team_id").cast("string").alias("home_team_id"),
        F.col("away_team_id").cast("string").alias("away_team_id"),
        F.when(played, "finished").otherwise(status).alias("status"),
        F.col("home_score").try_cast("int").alias("home_score"),
        F.col("away_score").try_cast("int").alias("away_score"),
    )


# -------------------------------------------------- competition JSON, version 4

_TEAM = "struct<id: bigint, name: string, shortName: string>"
COMPETITION = (
    f"matches array<struct<id: bigint, utcDate: string, status: string, matchday: int, season: struct<startDate: string>, homeTeam: {_TEAM}, awayTeam: {_TEAM}, "
    "score: struct<fullTime: struct<home: int, away: int>>, referees: array<struct<id: bigint, name: string, type: string>>>>, "
    f"season struct<startDate: string>, standings array<struct<type: string, `table`: array<struct<position: int, team: {_TEAM}, playedGames: int, points: int, won: int, draw: int, lost: int, goalsFor: int, goalsAgainst: int>>>>, "
    f"teams array<{_TEAM}>"
)


def competition_body(payloads: DataFrame, column: str) -> DataFrame:
    """Bodies beside observed_at; one without any of the three parts is left out."""
    body = payloads.select("observed_at", F.from_json(column, COMPETITION).alias("b")).select("observed_at", "b.*")
    return body.filter("matches IS NOT NULL OR standings IS NOT NULL OR teams IS NOT NULL")


def _season(start: Column) -> Column:
    year = F.substring(start, 1, 4).cast("int")
    return F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))


def _short(team: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{team}.shortName"), F.lit("")), F.col(f"{team}.name"))


def competition_matches(body: DataFrame) -> DataFrame:
    m = body.select("observed_at", F.explode("matches").alias("m"))
    done = F.col("m.status") == "FINISHED"
    status = F.coalesce(lookup(F.col("m.status"), {"TIMED": "scheduled", "IN_PLAY": "live", "PAUSED": "live"}), F.lower("m.status"))
    judge = F.get(F.filter("m.referees", lambda r: r["type"] == "REFEREE"), 0)
    return m.select(
        F.col("m.id").cast("string").alias("match_id"),
        _season(F.col("m.season.startDate")).alias("season"),
        F.col("m.utcDate").try_cast("timestamp").alias("kickoff_at"),
        F.when(F.col("m.status") == "SCHEDULED", "date").otherwise("minute").alias("kickoff_precision"),
        status.alias("status"),
        _short("m.homeTeam").alias("home_team"),
        _short("m.awayTeam").alias("away_team"),
        F.when(done, F.col("m.score.fullTime.home")).alias("home_score"),
        F.when(done, F.col("m.score.fullTime.away")).alias("away_score"),
        F.col("m.matchday").alias("matchweek"),
        judge["name"].alias("referee"),
        F.col("observed_at").alias("available_at"),
    )


def competition_standings(body: DataFrame) -> DataFrame:
    g = body.select("observed_at", _season(F.col("season.startDate")).alias("season"), F.explode("standings").alias("g"))
    t = g.select("observed_at", "season", F.col("g.type").alias("table_type"), F.explode("g.table").alias("t"))
    return t.select("season", "table_type", F.col("t.team.id").cast("string").alias("team_id"), _short("t.team").alias("team"), F.col("t.position").alias("rank"), F.col("t.playedGames").alias("played"), "t.points", "t.won", F.col("t.draw").alias("drawn"), "t.lost", F.col("observed_at").alias("available_at"))


def competition_teams(body: DataFrame) -> DataFrame:
    return body.select(F.explode("teams").alias("t")).select(F.col("t.id").cast("string").alias("team_id"), _short("t").alias("team"))
