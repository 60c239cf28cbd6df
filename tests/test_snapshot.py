"""The player snapshot against its definitions, row by row, on random versioned histories, and its folds by hand."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import snapshot as S

DAY0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(1)
    day = lambda n: DAY0 + timedelta(days=int(n))
    players, teams = [], []
    for p in range(6):
        for t in range(0, 60, 3):
            for v in range(rng.integers(1, 4)):
                value = lambda: None if rng.random() < 0.3 else float(rng.integers(0, 4))
                players.append((f"p{p}", day(t), day(t + v + rng.integers(0, 2) * 0.0 + v), int(rng.integers(1, 91)), bool(rng.random() < 0.6), int(rng.random() < 0.8), *[value() for _ in range(8)]))
    for t in range(0, 60, 3):
        for k in range(4):
            for v in range(rng.integers(1, 3)):
                value = lambda: None if rng.random() < 0.2 else float(rng.integers(0, 5))
                teams.append((f"t{k}", day(t), day(t + 2 * v), float(rng.integers(0, 4)), float(rng.integers(0, 4)), value(), value(), value(), value(), f"r{k // 2}"))
    rows = [(f"m{i}:p{i % 6}", f"p{i % 6}" if i != 5 else "new", f"t{i % 4}", f"t{(i + 1) % 4}", f"m{i}", day(20 + 2 * i), day(20 + 2 * i) + timedelta(hours=18), i % 2, None if i % 5 == 0 else f"r{i % 3}") for i in range(20)]
    return (
        pd.DataFrame(rows, columns="snapshot_row_id player_id team_id opponent_team_id match_id prediction_cutoff kickoff_at home_flag referee_id".split()),
        pd.DataFrame(players, columns="player_id event_time available_at minutes started event_statistics_available goals assists xg xa shots tackles interceptions saves".split()).drop_duplicates(["player_id", "event_time", "available_at"]),
        pd.DataFrame(teams, columns="team_id event_time available_at goals_for goals_against xg_for xg_against cards penalties referee_id".split()).drop_duplicates(["team_id", "event_time", "available_at"]),
    )


def none(v):
    return None if v is None or v != v else v


def seen_before(history, key, value, cutoff):
    """What could be known: of each event the version that was known last, newest event first; and when the last was known."""
    visible = [h for h in history if h[key] == value and h["event_time"] < cutoff and h["available_at"] <= cutoff]
    versions: dict = {}
    for h in sorted(visible, key=lambda h: h["available_at"]):
        versions[h["event_time"]] = h
    return [versions[t] for t in sorted(versions, reverse=True)], max((h["available_at"] for h in versions.values()), default=None)


def total(rows, name):
    values = [none(r[name]) for r in rows if none(r[name]) is not None]
    return sum(values) if values else None


def faded(rows, name):
    pairs = [(none(r[name]), math.exp(-0.35 * i)) for i, r in enumerate(rows[:10])]
    weight = sum(w for v, w in pairs if v is not None)
    return sum(v * w for v, w in pairs if v is not None) / weight if weight else None


def per90(rows, name):
    minutes = sum(r["minutes"] for r in rows if none(r[name]) is not None)
    return 90 * total(rows, name) / minutes if minutes else None


def expected(c, players, teams, referees):
    """Every feature of one candidate, from the definitions, row by row."""
    cut = c["prediction_cutoff"]
    p, p_seen = seen_before(players, "player_id", c["player_id"], cut)
    t, t_seen = seen_before(teams, "team_id", c["team_id"], cut)
    o, o_seen = seen_before(teams, "team_id", c["opponent_team_id"], cut)
    r, r_seen = seen_before(referees, "referee_id", c["referee_id"], cut) if none(c["referee_id"]) else ([], None)
    minutes = [x["minutes"] for x in p[:10]]
    late = p[:5]
    mean = np.mean(range(1, len(late) + 1)) if late else 0
    spread = sum((i + 1 - mean) ** 2 for i in range(len(late)))
    out = {
        "player_history_count": len(p[:10]),
        "event_history_count": sum(x["event_statistics_available"] == 1 for x in p[:10]),
        **{f"minutes_last_{n}": total(p[:n], "minutes") or 0 for n in (1, 3, 5, 10)},
        "starts_last_5": sum(bool(x["started"]) for x in late),
        "goals_last_5": total(late, "goals"),
        "assists_last_5": total(late, "assists"),
        "minutes_ewma_10": faded(p, "minutes"),
        **{f"{m}_per90_last_{n}": per90(p[:n], m) for m, n in (("xg", 10), ("xa", 10), ("shots", 5), ("tackles", 10), ("interceptions", 10), ("saves", 10))},
        "minutes_volatility_10": float(np.std(minutes, ddof=1)) if len(minutes) > 1 else None,
        "minutes_trend_5": -sum((i + 1 - mean) * x["minutes"] for i, x in enumerate(late)) / spread if spread else None,
        "player_max_available_at": p_seen,
        "team_history_count": len(t[:10]),
        "team_goals_for_last_5": total(t[:5], "goals_for") or 0,
        "team_goals_against_last_5": total(t[:5], "goals_against") or 0,
        "team_xg_for_ewma_10": faded(t, "xg_for"),
        "team_xg_against_ewma_10": faded(t, "xg_against"),
        "rest_days": (c["kickoff_at"].date() - t[0]["event_time"].date()).days if t else None,
        "schedule_congestion_14d": sum(x["event_time"] >= cut - timedelta(days=14) for x in t),
        "team_max_available_at": t_seen,
        "opponent_history_count": len(o[:10]),
        "opponent_goals_for_last_5": total(o[:5], "goals_for") or 0,
        "opponent_goals_against_last_5": total(o[:5], "goals_against") or 0,
        "opponent_xg_against_ewma_10": faded(o, "xg_against"),
        "opponent_max_available_at": o_seen,
        "referee_history_count": len(r[:20]),
        "referee_max_available_at": r_seen,
    }
    for name, mean, strength in (("cards", 4.5, 5), ("penalties", 0.25, 10)):
        sum_of = total(r[:20], name)
        out[f"referee_{name}_per_match_20"] = None if sum_of is None else (sum_of + strength * mean) / (len(r[:20]) + strength)
    return out


def whistles(teams):
    """A referee's events: at each time that a team of the match has a version, both teams' last versions, if all is known."""
    games: dict = {}
    for h in teams:
        games.setdefault((h["referee_id"], h["event_time"]), []).append(h)
    out = []
    for (referee, event), rows in games.items():
        for at in sorted({h["available_at"] for h in rows}):
            last = {h["team_id"]: h for h in sorted(rows, key=lambda h: h["available_at"]) if h["available_at"] <= at}
            made = {"referee_id": referee, "event_time": event, "available_at": at}
            for name in ("cards", "penalties"):
                values = [none(h[name]) for h in last.values()]
                made[name] = sum(values) if len(values) == 2 and None not in values else None
            out.append(made)
    return out


def test_snapshot_equals_the_definitions(spark, frames):
    kinds = dict.fromkeys(("prediction_cutoff", "kickoff_at", "event_time", "available_at"), "timestamp") | dict.fromkeys(("minutes", "event_statistics_available", "home_flag"), "int") | {"started": "boolean"}

    def rows_of(frame):
        plain = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else none(v)
        return [{k: plain(v) for k, v in r.items()} for r in frame.astype(object).to_dict("records")]

    def to_spark(frame, rows):
        kind = lambda k: kinds.get(k) or ("string" if k.endswith("_id") else "double")
        return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kind(k)}" for k in frame.columns))

    candidates, players, teams = map(rows_of, frames)
    ours = {r.snapshot_row_id: r for r in S.build(*(to_spark(f, r) for f, r in zip(frames, (candidates, players, teams), strict=True))).collect()}
    assert len(ours) == 20
    for c in candidates:
        for name, v in expected(c, players, teams, whistles(teams)).items():
            got = ours[c["snapshot_row_id"]][name]
            assert got == (pytest.approx(float(v), rel=1e-9, abs=1e-12) if isinstance(v, (int, float, np.floating)) else v), (name, c["snapshot_row_id"])


def test_memberships_fold(spark):
    t = lambda d: datetime(2024, 1, d)
    fixtures = spark.createDataFrame([("m", "A", "B", t(20))], "match_id string, home_team_id string, away_team_id string, kickoff_at timestamp")
    observed = spark.createDataFrame([("stay", t(5), "A", "MID", t(5)), ("moved", t(5), "A", "DEF", t(5)), ("left", t(5), "A", "FWD", t(5)), ("old", datetime(2022, 1, 1), "A", "GK", t(5))], "player_id string, event_time timestamp, team_id string, role string, available_at timestamp")
    transfers = spark.createDataFrame([("moved", date(2024, 1, 10), "B", None, t(9), 1), ("left", date(2024, 1, 8), None, None, t(8), 2), ("stay", date(2024, 1, 2), "B", None, t(2), 3), ("stay", date(2024, 1, 25), "B", None, t(9), 4), ("new", date(2024, 1, 9), "A", "GK", t(9), 5), ("noone", date(2024, 1, 9), "A", None, t(9), 6), ("stay", date(2024, 1, 12), "B", None, t(19), 7)], "player_id string, transfer_date date, to_team_id string, role string, available_at timestamp, id int")
    lineups = spark.createDataFrame([("m", "left", "B", None, t(14), t(14), 1), ("m", "sheet", "A", "FWD", t(14), t(14), 2)], "match_id string, player_id string, team_id string, role string, event_time timestamp, available_at timestamp, id int")
    got = {r.player_id: (r.team_id, r.role) for r in S.upcoming_memberships(fixtures, observed, transfers, lineups, F.lit(t(15)).cast("timestamp")).collect()}
    assert got == {"stay": ("A", "MID"), "moved": ("B", "DEF"), "new": ("A", "GK"), "sheet": ("A", "FWD"), "left": ("B", "FWD")}


def test_labels_mask_without_coverage(spark):
    rows = spark.createDataFrame([("a", "2324", "GK", True, 90, 1, 0, True, 0.0, 1.0, 3.0, 0.0, None, 0.0, 6.5), ("b", "2324", "FWD", False, 0, 1, 2, False, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 7.0)], "snapshot_row_id string, season string, role string, started boolean, minutes int, scored int, conceded int, covered boolean, goals double, assists double, saves double, yellow_cards double, red_cards double, penalties double, base_rating double")
    a, b = S.labels(rows).orderBy("snapshot_row_id").collect()
    assert (a.label_goal_probability, a.label_assist_probability, a.label_goalkeeper_saves, a.label_red_card_probability, a.label_clean_sheet_probability) == (0.0, 1.0, 3.0, None, 1.0)
    assert (b.label_expected_goals, b.label_base_rating, b.label_goalkeeper_goals_conceded, b.label_team_goals_conceded) == (None, None, None, 2.0)


def test_confirmed_sheet(spark):
    rows = [("m", "A", DAY0, True, f"p{i}") for i in range(11)] + [("m", "B", DAY0, True, f"q{i}") for i in range(11)] + [("m", "B", DAY0 + timedelta(hours=1), True, f"q{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "match_id string, team_id string, available_at timestamp, is_starting boolean, player_id string")
    assert [r.team_id for r in S.confirmed_sheet(df).collect()] == ["A"]
