"""Provider parsers on small files with the cases that they must get right."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kairoframe.sources import providers as P


def test_season_results(spark):
    rows = [("13/08/2023", "", "Roma", "Milan", "2", "1", "H", "12", "", "1.9"), ("14/08/23", "18:30", "Lazio", "Inter", "0", "0", "D", "", "7", "x"), ("15/08/2023", "", "", "Como", "1", "1", "D", "1", "1", "1")]
    df = spark.createDataFrame(rows, "Date string, Time string, HomeTeam string, AwayTeam string, FTHG string, FTAG string, FTR string, HS string, AS string, B365H string")
    a, b = P.season_results(df, "2023-2024").orderBy("kickoff_at").collect()
    assert (a.home_score, a.stats, a.odds, a.kickoff_at) == (2, {"home_shots": 12.0}, {"bet365_home": 1.9}, datetime(2023, 8, 13))
    assert (b.kickoff_at, b.available_at, b.stats, b.odds, b.referee) == (datetime(2023, 8, 14), datetime(2023, 8, 15, 3), {"away_shots": 7.0}, {}, None)
    with pytest.raises(ValueError, match="FTR"):
        P.season_results(df.drop("FTR"), "x")


def test_player_matches(spark):
    df = spark.createDataFrame([("m1", "2024-01-01 15:00:00", 1, "A", 9, "T", 90, None, True, None), ("m1", "2024-01-01 15:00:00", 2, "B", 9, "T", None, "MID", None, 3), ("m2", "2024-01-02", 3, "C", 9, "T", 10, None, None, None)], "match_id string, match_date string, player_id int, player_name string, team_id int, team_name string, mins_played int, position string, is_starter boolean, goal_assist int")
    a, b, c = P.player_matches(df).orderBy("player_id").collect()
    assert (a.event_statistics_available, b.event_statistics_available, c.event_statistics_available) == (True, True, False)
    assert (a.started, b.started, c.started, b.minutes) == (True, True, False, 0)
    assert b.stats["assists"] == 3.0 and "assists" not in a.stats
    assert (a.available_at, c.available_at) == (datetime(2024, 1, 1, 18), datetime(2024, 1, 3, 3))


def test_shots_events_and_team_xg(spark):
    s = spark.createDataFrame([("m", 1, "t", "p", True, False, 50.0, None, 0.3), ("m", 2, "t", "p", True, True, 1.0, 1.0, 0.1), ("m", 3, "t", "p", False, None, 90.0, 10.0, None)], "match_id string, event_id int, team_id string, player_id string, is_goal boolean, is_own_goal boolean, x double, y double, xg double")
    got = P.shots(s).orderBy("source_record_id").collect()
    assert [(r.result, r.x, r.y) for r in got] == [("goal", 0.5, None), ("non_goal", 0.9, 0.1)]
    e = spark.createDataFrame([("m", 1, 16, 10, 5, '{"28": "x"}', ""), ("m", 2, 16, 1, None, None, "p"), ("m", 3, 999, None, None, "bad", "p")], "match_id string, event_id int, type_id int, minute int, second int, qualifier_json string, player_id string")
    assert [(r.event_type, r.second, r.player_id) for r in P.events(e).orderBy("source_record_id").collect()] == [("own_goal", 605, None), ("goal", 60, "p"), ("unclassified", 0, "p")]
    x = spark.createDataFrame([(1, "2024-01-01", "A", "B", 2, 1, 1.5, 25.0)], "game_id int, date string, home_team string, away_team string, home_goals int, away_goals int, home_xg double, away_xg double")
    assert [(r.team, r.is_home, r.xg_for, r.xg_against) for r in P.team_xg(x).collect()] == [("A", True, 1.5, None), ("B", False, None, 1.5)]


def test_covered_xg(spark):
    df = spark.createDataFrame([(2.0, 2, 2, 0.5), (2.0, 2, 1, 0.5), (0.0, None, None, None), (1.0, None, None, None)], "r double, a int, w int, x double")
    assert [r[0] for r in df.select(P.covered_xg(F.col("r"), F.col("a"), F.col("w"), F.col("x"))).collect()] == [0.5, None, 0.0, None]


def test_operational_json(spark):
    t = datetime(2024, 1, 1)
    team = lambda i: {"id": i, "name": f"T{i}"}
    payload = lambda row: spark.createDataFrame([(t, json.dumps({"response": [row]}))], "observed_at timestamp, body string")
    o = P.odds(P.rows_of(payload({"fixture": {"id": 5, "date": "2024-01-05"}, "bookmakers": [{"id": 1, "name": "B", "bets": [{"id": 2, "name": "1X2", "values": [{"value": "Home", "odd": "1.95"}, {"value": "Draw", "odd": None}]}]}]}), "body", P.ODDS)).collect()
    assert [(r.match_id, r.bookmaker, r.market, r.selection, r.decimal_odds) for r in o] == [("5", "B", "1X2", "Home", Decimal("1.9500"))]
    s = P.standings(P.rows_of(payload({"league": {"season": 2023, "standings": [[{"rank": 1, "team": team(7), "points": 9, "all": {"played": 3, "win": 3, "draw": 0, "lose": 0, "goals": {"for": 5, "against": 1}}}]]}}), "body", P.STANDINGS)).first()
    assert (s.season, s.team_id, s.points, s.won, s.goals_for) == ("2023-2024", "7", 9, 3, 5)
    r = P.transfers(P.rows_of(payload({"player": team(3), "transfers": [{"date": "2024-01-02", "type": "Free", "teams": {"in": team(1), "out": {"id": None, "name": None}}}]}), "body", P.TRANSFERS)).first()
    assert (r.player_id, r.from_team, r.to_team, r.source_record_id) == ("3", None, "1", "transfer:3:2024-01-02:0")
    i = P.injuries(P.rows_of(payload({"player": {"id": 3, "name": "x", "type": "Missing Fixture", "reason": "Suspended"}, "team": team(1), "fixture": {"id": 5, "date": "2024-01-05T20:00:00"}}), "body", P.INJURIES)).first()
    assert (i.status, i.suspended, str(i.starts_on)) == ("out", True, "2024-01-05")
    row = {"fixture": {"id": 5, "date": "2024-01-05T20:00:00", "status": {"short": "FT"}}, "league": {"id": 1, "season": 2023, "round": "Regular Season - 12"}, "teams": {"home": team(1), "away": team(2)}, "goals": {"home": 2, "away": 0}, "statistics": [{"team": team(2), "statistics": [{"type": "Ball Possession", "value": "55%"}]}], "lineups": [{"team": team(1), "startXI": [{"player": {"id": 9, "name": "n", "pos": "G"}}], "substitutes": None}], "events": [{"time": {"elapsed": 45, "extra": 2}, "team": team(1), "player": {"id": 9, "name": None}, "type": "Card", "detail": "Yellow"}]}
    rows = P.rows_of(payload(row), "body", P.FIXTURES)
    m = P.fixture_matches(rows).first()
    assert (m.status, m.matchweek, m.home_score, m.season) == ("finished", 12, 2, "2023-2024")
    assert [tuple(x) for x in P.fixture_statistics(rows).collect()] == [("5", "away", "Ball Possession", 55.0)]
    assert [(x.player_id, x.is_starting) for x in P.fixture_lineups(rows).collect()] == [("9", True)]
    assert [(x.second, x.player_id) for x in P.fixture_events(rows).collect()] == [(2820, None)]
    assert P.rows_of(spark.createDataFrame([(t, "no json")], "observed_at timestamp, body string"), "body", P.ODDS).count() == 0
