"""Get-or-create with repeated rows, repeated players and missing names; identities with all evidence against row-by-row scores."""

import random
from datetime import date

from kairoframe.operators import quality, resolution

PLAYERS = "match_id int, team_id int, name string, extra map<string,int>"
KNOWN = "match_id int, team_id int, name string, player_id string"


def players(spark, incoming, known):
    found = resolution.players_get_or_create(spark.createDataFrame(incoming, PLAYERS), spark.createDataFrame(known, KNOWN))
    return sorted(((r.match_id or 0, r.team_id or 0, r.name or "", r.player_id, r.state, r.review) for r in found.collect()), key=str)


def test_repeated_rows_find_the_same_player(spark):
    known = [(1, 1, "john smith", "p1")]
    for more in ([], known):  # known once or twice
        got = players(spark, [(1, 1, "j smith", {"a": 1}), (1, 1, "j smith", None)], known + more)
        assert got == [(1, 1, "j smith", "p1", "found", None)] * 2


def test_two_players_of_one_name_are_for_review(spark):
    got = players(spark, [(1, 1, "j smith", None), (1, 1, "k smith", None), (2, 1, "j smith", None)], [(1, 1, "john smith", "p1"), (1, 1, "jack smith", "p2")])
    assert [x[3:] for x in got[1:2]] and [(x[2], x[4], x[5]) for x in got] == [("j smith", "created", "same name"), ("k smith", "created", "same surname"), ("j smith", "created", None)]
    assert len({x[3] for x in got}) == 3


def test_rows_without_names_are_nobody(spark):
    got = players(spark, [(1, 1, None, None), (2, None, None, None), (None, 1, "a b", None), (1, None, "a b", None)], [(1, 1, None, "p1")])
    assert [(x[2], x[4]) for x in got if not x[2]] == [("", "unnamed")] * 2 and all(x[3] is None for x in got if not x[2])
    made = [x[3] for x in got if x[2]]
    assert len(set(made)) == 2 and None not in made
    teams = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5), ("c", 6)], "name string, row int")
    known = spark.createDataFrame([("b", "t1"), ("b", "t1"), ("c", "t2"), ("c", "t3"), (None, "t4")], "known string, team string")
    out = {r.row: (r.team, r.state) for r in resolution.get_or_create(teams, known, "name", "team", "known").collect()}
    assert out[1] == out[2] == (None, "unnamed")
    assert out[3] == out[4] and out[3][1] == "created" and out[5] == ("t1", "found") and out[6] == (None, "blocked")


def test_new_ids_tell_parts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("", "a"), ("a", ""), ("a\\", "b"), ("a", "\\b"), ("\\0", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert len({r[0] for r in df.select(resolution.new_id(df.x, df.y)).collect()}) == len(rows)


PERSON = "name string, born date, nationality string, team int, position string"


def ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_identities_row_by_row(spark):
    draw = random.Random(11)
    people = ["anna rossi", "ana rossi", "a rossi", "bruno neri", "bruna neri", "carla verdi", "x"]
    person = lambda: (draw.choice(people), draw.choice([None, date(1990, 1, 1), date(1991, 2, 2)]), draw.choice([None, "it", "IT", "fr"]), draw.choice([None, 1, 2]), draw.choice([None, "gk", "fw"]))
    when = lambda: draw.choice([None, date(2020, 1, 1), date(2020, 6, 1), date(2021, 1, 1)])
    asked = [(i, *person(), when()) for i in range(60)]
    cast = [(1000 + i, *person(), when(), when()) for i in range(80)]
    q = spark.createDataFrame(asked, f"q int, {PERSON}, day date")
    c = spark.createDataFrame(cast, f"c int, {PERSON}, valid_from date, valid_to date")
    known = spark.createDataFrame([(3, 1005), (4, 9999)], "q int, c int")
    got = {r.q: r for r in quality.resolve_identities(q, c, "q", "c", known).collect()}
    assert len(got) == 60
    for i, name, born, nat, team, pos, day in asked:
        scored = []
        for key, n2, b2, t2, team2, p2, a, z in cast:
            s, why = (0.82, ["exact_normalized_name"]) if name == n2 else (0.70 * ratio(name, n2), ["fuzzy_name"])
            if born and b2:
                s += 0.14 if born == b2 else -0.30
                why.append("date_of_birth_match" if born == b2 else "date_of_birth_conflict")
            if nat and t2:
                s += 0.03 if nat.lower() == t2.lower() else -0.02
                why += ["nationality_match"] * (nat.lower() == t2.lower())
            if team and team2:
                inside = day is None or ((a is None or a <= day) and (z is None or z >= day))
                s += (0.08 if inside else 0.0) if team == team2 else -0.05
                why += ["temporal_team_match"] * (team == team2 and inside)
            if pos and pos == p2:
                s += 0.02
                why.append("position_match")
            scored.append((-round(max(0.0, min(1.0, s)), 6), key, sorted(why)))
        scored = sorted(scored)[:5]
        r = got[i]
        if i == 3:
            assert (r.status, r.selected, r.confidence, r.method) == ("resolved", 1005, 1.0, "existing_mapping")
            continue
        assert [(x.candidate, x.evidence) for x in r.candidates] == [(k, w) for _, k, w in scored], i
        top, second = -scored[0][0], -scored[1][0]
        status = "unresolved" if top < 0.7 else "ambiguous" if top < 0.87 or top - second <= 0.04 else "resolved"
        assert (r.status, r.selected) == (status, scored[0][1] if status == "resolved" else None)
    assert {r.status for r in got.values()} == {"resolved", "ambiguous", "unresolved"} or len({r.status for r in got.values()}) > 1
