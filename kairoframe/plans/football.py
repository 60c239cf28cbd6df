"""The snapshot operators themselves over histories made of the driver's tables.

A customer is a player, a nation a team, and an order a player's match that
becomes known some days later and is revised once; a nation's matches are its
customers' orders of a day.  The SQL gathers what a candidate may see into
ordered lists and takes sums of slices of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot as P
from ..sources.tables import table
from .catalog import register

_DAY = "INTERVAL 1 DAY"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("o_custkey").cast("string").alias("player_id"), F.col("c_nationkey").alias("nation"), "o_orderdate", "o_totalprice", (F.col("o_orderkey") % 90 + 1).cast("int").alias("minutes"))


def _histories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, player versions and team versions."""
    o = _orders(spark, sf)
    k = F.col("o_orderkey")
    revised = o.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    players = revised.select(
        "player_id", F.col("o_orderdate").alias("event_time"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(2) + 20 * F.col("v"))).alias("available_at"), (F.col("minutes") - F.col("v") * (k % 2)).cast("int").alias("minutes"),
        (k % 3 == 0).alias("started"), (k % 5 != 0).cast("int").alias("event_statistics_available"), (k % 4 + F.col("v")).cast("double").alias("goals"), F.when(k % 7 != 0, (k % 2).cast("double")).alias("assists"),
        F.when(k % 3 != 1, (k % 10) / 10.0).alias("xg"), F.lit(None).cast("double").alias("xa"), (k % 6).cast("double").alias("shots"), (k % 5).cast("double").alias("tackles"), F.when(k % 2 == 0, (k % 3).cast("double")).alias("interceptions"), F.lit(0.0).alias("saves"),
    )
    # the greatest of a day's rows, where what is not known is above all values, as in the SQL
    held = players.columns[3:]
    greatest = F.max(F.struct(*[F.struct(F.col(c).isNull().alias("unknown"), F.col(c).alias("value")).alias(c) for c in held]))
    players = players.groupBy("player_id", "event_time", "available_at").agg(greatest.alias("x")).select("player_id", "event_time", "available_at", *[F.col("x")[c]["value"].alias(c) for c in held])
    teams = o.groupBy(F.concat(F.lit("t"), "nation").alias("team_id"), F.col("o_orderdate").alias("event_time")).agg(
        F.min(F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("available_at"), F.max(k % 4).cast("double").alias("goals_for"), F.min(k % 3).cast("double").alias("goals_against"),
        F.max(F.when(k % 2 == 0, (k % 20) / 10.0)).alias("xg_for"), F.max((k % 30) / 10.0).alias("xg_against"), F.max(k % 6).cast("double").alias("cards"), F.max(F.when(k % 5 != 0, (k % 2).cast("double"))).alias("penalties"),
        F.concat(F.lit("r"), F.first("nation") % 5).alias("referee_id"),
    )
    candidates = o.select(
        k.cast("string").alias("snapshot_row_id"), "player_id", F.concat(F.lit("t"), "nation").alias("team_id"), F.concat(F.lit("t"), (F.col("nation") + 1) % 25).alias("opponent_team_id"), k.alias("match_id"), F.col("o_orderdate").alias("prediction_cutoff"),
        (F.col("o_orderdate") + F.expr("INTERVAL '30' HOUR")).alias("kickoff_at"), (k % 2).cast("int").alias("home_flag"), F.when(k % 4 != 0, F.concat(F.lit("r"), F.col("nation") % 5)).alias("referee_id"),
    )
    return candidates, players, teams


_BASE = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS player, c_nationkey AS n, o_orderdate AS d, o_orderkey % 90 + 1 AS m FROM orders JOIN customer ON o_custkey = c_custkey),
ph AS (SELECT player, d, d + INTERVAL 1 DAY * (2 + 20 * v) AS known, MAX({'minutes': m - v * (k % 2), 'started': k % 3 = 0, 'here': CAST(k % 5 <> 0 AS INT), 'goals': (k % 4 + v)::DOUBLE, 'assists': CASE WHEN k % 7 <> 0 THEN (k % 2)::DOUBLE END,
  'xg': CASE WHEN k % 3 <> 1 THEN (k % 10) / 10.0::DOUBLE END, 'shots': (k % 6)::DOUBLE, 'tackles': (k % 5)::DOUBLE, 'interceptions': CASE WHEN k % 2 = 0 THEN (k % 3)::DOUBLE END}) AS x FROM o, (VALUES (0), (1)) t(v) GROUP BY ALL),
th AS (SELECT n, d, d + INTERVAL 1 DAY AS known, MAX(k % 4)::DOUBLE AS gf, MIN(k % 3)::DOUBLE AS ga, MAX(CASE WHEN k % 2 = 0 THEN (k % 20) / 10.0::DOUBLE END) AS xf, MAX((k % 30) / 10.0::DOUBLE) AS xa FROM o GROUP BY n, d),
c AS (SELECT * FROM o),
weights AS (SELECT LIST(EXP(-0.35::DOUBLE * i) ORDER BY i) AS w FROM RANGE(10) t(i)),
pv AS (SELECT c.k, h.d, ARG_MAX(h.x, h.known) AS x, MAX(h.known) AS seen FROM c JOIN ph h ON h.player = c.player AND h.d < c.d AND h.known <= c.d GROUP BY c.k, h.d),
pl AS (SELECT k, LIST(x ORDER BY d DESC)[1:10] AS l, MAX(seen) AS seen FROM pv GROUP BY k),
tl AS (SELECT c.n, c.d AS cut, LIST({'d': h.d, 'gf': h.gf, 'ga': h.ga, 'xf': h.xf, 'xa': h.xa} ORDER BY h.d DESC) AS l, MAX(h.known) AS seen FROM (SELECT DISTINCT n, d FROM (SELECT n, d FROM c UNION ALL SELECT (n + 1) % 25, d FROM c)) c JOIN th h ON h.n = c.n AND h.d < c.d AND h.known <= c.d GROUP BY c.n, c.d)
"""


@register("snapshot_players", _BASE + """
SELECT CAST(c.k AS VARCHAR) AS snapshot_row_id, COALESCE(LEN(l), 0) AS player_history_count, COALESCE(LEN(LIST_FILTER(l, lambda x: x.here = 1)), 0) AS event_history_count,
  CAST(COALESCE(LIST_SUM(LIST_TRANSFORM(l[1:3], lambda x: x.minutes)), 0) AS BIGINT) AS minutes_last_3, CAST(COALESCE(LIST_SUM(LIST_TRANSFORM(l, lambda x: x.minutes)), 0) AS BIGINT) AS minutes_last_10, COALESCE(LEN(LIST_FILTER(l[1:5], lambda x: x.started)), 0) AS starts_last_5,
  LIST_SUM(LIST_TRANSFORM(l[1:5], lambda x: x.goals)) AS goals_last_5, LIST_SUM(LIST_TRANSFORM(l[1:5], lambda x: x.assists)) AS assists_last_5,
  ROUND(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(l, w[1:LEN(l)]), lambda z: z[1].minutes * z[2])) / LIST_SUM(w[1:LEN(l)]), 6) AS minutes_ewma_10,
  ROUND(90 * LIST_SUM(LIST_TRANSFORM(l, lambda x: x.xg)) / NULLIF(LIST_SUM(LIST_TRANSFORM(LIST_FILTER(l, lambda x: x.xg IS NOT NULL), lambda x: x.minutes)), 0), 6) AS xg_per90,
  ROUND(90 * LIST_SUM(LIST_TRANSFORM(l[1:5], lambda x: x.shots)) / NULLIF(LIST_SUM(LIST_TRANSFORM(l[1:5], lambda x: x.minutes)), 0), 6) AS shots_per90,
  ROUND(LIST_STDDEV_SAMP(LIST_TRANSFORM(l, lambda x: x.minutes)), 6) AS minutes_volatility_10, seen AS player_max_available_at
FROM c LEFT JOIN pl ON pl.k = c.k CROSS JOIN weights""")
def snapshot_players(spark: SparkSession, sf: str) -> DataFrame:
    out = P.build(*_histories(spark, sf))
    six = lambda c, n: F.round(c, 6).alias(n)
    return out.select(
        "snapshot_row_id", "player_history_count", "event_history_count", "minutes_last_3", "minutes_last_10", "starts_last_5", "goals_last_5", "assists_last_5", six("minutes_ewma_10", "minutes_ewma_10"), six("xg_per90_last_10", "xg_per90"),
        six("shots_per90_last_5", "shots_per90"), six("minutes_volatility_10", "minutes_volatility_10"), "player_max_available_at",
    )


@register("snapshot_teams", _BASE + """
SELECT CAST(c.k AS VARCHAR) AS snapshot_row_id, LEAST(10, COALESCE(LEN(a.l), 0)) AS team_history_count, COALESCE(LIST_SUM(LIST_TRANSFORM(a.l[1:5], lambda x: x.gf)), 0) AS team_goals_for_last_5,
  ROUND(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a.l[1:10], w[1:LEAST(10, LEN(a.l))]), lambda z: z[1].xa * z[2])) / LIST_SUM(w[1:LEAST(10, LEN(a.l))]), 6) AS team_xg_against,
  ROUND(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a.l[1:10], w[1:LEAST(10, LEN(a.l))]), lambda z: z[1].xf * z[2])) / LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a.l[1:10], w[1:LEAST(10, LEN(a.l))]), lambda z: CASE WHEN z[1].xf IS NOT NULL THEN z[2] END)), 6) AS team_xg_for,
  DATE_DIFF('day', CAST(a.l[1].d AS DATE), CAST(c.d + INTERVAL 30 HOUR AS DATE)) AS rest_days, COALESCE(LEN(LIST_FILTER(a.l, lambda x: x.d >= c.d - INTERVAL 14 DAY)), 0) AS congestion, a.seen AS team_max_available_at,
  LEAST(10, COALESCE(LEN(b.l), 0)) AS opponent_history_count, COALESCE(LIST_SUM(LIST_TRANSFORM(b.l[1:5], lambda x: x.ga)), 0) AS opponent_goals_against_last_5
FROM c LEFT JOIN tl a ON a.n = c.n AND a.cut = c.d LEFT JOIN tl b ON b.n = (c.n + 1) % 25 AND b.cut = c.d CROSS JOIN weights""")
def snapshot_teams(spark: SparkSession, sf: str) -> DataFrame:
    out = P.build(*_histories(spark, sf))
    return out.select(
        "snapshot_row_id", "team_history_count", "team_goals_for_last_5", F.round("team_xg_against_ewma_10", 6).alias("team_xg_against"), F.round("team_xg_for_ewma_10", 6).alias("team_xg_for"),
        F.col("rest_days").cast("bigint").alias("rest_days"), F.col("schedule_congestion_14d").alias("congestion"), "team_max_available_at", "opponent_history_count", "opponent_goals_against_last_5",
    )


@register("snapshot_referees", """
WITH o AS (SELECT o_orderkey AS k, c_nationkey AS n, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT n, 'r' || (n % 5) AS r, d, MAX(k % 6)::DOUBLE AS cards, MAX(CASE WHEN k % 5 <> 0 THEN (k % 2)::DOUBLE END) AS pens FROM o GROUP BY n, d),
h AS (SELECT r, d, CASE WHEN COUNT(*) = 2 AND COUNT(cards) = 2 THEN SUM(cards) END AS cards, CASE WHEN COUNT(*) = 2 AND COUNT(pens) = 2 THEN SUM(pens) END AS pens FROM t GROUP BY r, d),
c AS (SELECT k, d, 'r' || (n % 5) AS r FROM o WHERE k % 4 <> 0),
l AS (SELECT c.k, LIST({'c': h.cards, 'p': h.pens} ORDER BY h.d DESC)[1:20] AS l FROM c JOIN h ON h.r = c.r AND h.d < c.d AND h.d + INTERVAL 1 DAY <= c.d GROUP BY c.k)
SELECT CAST(o.k AS VARCHAR) AS snapshot_row_id, COALESCE(LEN(l), 0) AS n, ROUND((LIST_SUM(LIST_TRANSFORM(l, lambda x: x.c)) + 22.5::DOUBLE) / (LEN(l) + 5), 6) AS cards, ROUND((LIST_SUM(LIST_TRANSFORM(l, lambda x: x.p)) + 2.5::DOUBLE) / (LEN(l) + 10), 6) AS penalties
FROM o LEFT JOIN l ON l.k = o.k""")
def snapshot_referees(spark: SparkSession, sf: str) -> DataFrame:
    """Referees' histories are derived from the two teams' rows."""
    out = P.build(*_histories(spark, sf))
    return out.select("snapshot_row_id", F.col("referee_history_count").alias("n"), F.round("referee_cards_per_match_20", 6).alias("cards"), F.round("referee_penalties_per_match_20", 6).alias("penalties"))


@register("player_labels", """
SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_row_id, CAST(YEAR(o_orderdate) AS VARCHAR) AS season, CASE WHEN o_custkey % 11 = 0 THEN 'GK' ELSE 'FWD' END AS football_role, CAST(o_orderkey % 3 = 0 AS INT)::DOUBLE AS label_start_probability, CAST(o_orderkey % 90 > 0 AS INT)::DOUBLE AS label_appearance_probability,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 4 > 0 AS INT)::DOUBLE END AS label_goal_probability, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN (o_orderkey % 4)::DOUBLE END AS label_expected_goals,
  CAST(o_orderkey % 3 = 0 AS INT)::DOUBLE AS label_clean_sheet_probability, CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 5 <> 0 THEN (o_orderkey % 6)::DOUBLE END AS label_goalkeeper_saves, CASE WHEN o_custkey % 11 = 0 THEN (o_orderkey % 3)::DOUBLE END AS label_goalkeeper_goals_conceded FROM orders""")
def player_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("double")
    rows = table(spark, sf, "orders").select(
        k.cast("string").alias("snapshot_row_id"), F.year("o_orderdate").cast("string").alias("season"), F.when(F.col("o_custkey") % 11 == 0, "GK").otherwise("FWD").alias("role"), (k % 3 == 0).alias("started"), (k % 90).alias("minutes"), (k % 4).alias("scored"), (k % 3).alias("conceded"),
        (k % 5 != 0).alias("covered"), F.when(k % 7 != 0, n(4)).alias("goals"), n(2).alias("assists"), n(6).alias("saves"), n(2).alias("yellow_cards"), n(9).alias("red_cards"), n(3).alias("penalties"), n(10).alias("base_rating"),
    )
    kept = "start_probability appearance_probability goal_probability expected_goals clean_sheet_probability goalkeeper_saves goalkeeper_goals_conceded".split()
    return P.labels(rows).select("snapshot_row_id", "season", "football_role", *[f"label_{c}" for c in kept])


@register("confirmed_sheets", """
WITH s AS (SELECT l_orderkey % 50 AS match_id, l_suppkey % 2 AS team_id, CAST(YEAR(l_shipdate) AS INT) AS available_at, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS p, COUNT(*) FILTER (WHERE l_linenumber <= 4) AS st, COUNT(DISTINCT CASE WHEN l_linenumber <= 4 THEN l_partkey END) AS d FROM lineitem WHERE l_quantity > 38 GROUP BY ALL),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, team_id ORDER BY available_at DESC) AS r FROM s)
SELECT match_id, team_id, available_at FROM f WHERE r = 1 AND st = 11 AND d = 11 AND n = p""")
def confirmed_sheets(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_quantity > 38")
    rows = li.select((F.col("l_orderkey") % 50).alias("match_id"), (F.col("l_suppkey") % 2).alias("team_id"), F.year("l_shipdate").alias("available_at"), (F.col("l_linenumber") <= 4).alias("is_starting"), F.col("l_partkey").alias("player_id"))
    return P.confirmed_sheet(rows)


@register("team_version_stream", """
WITH u AS (SELECT user_id, event_id, DATE_TRUNC('day', ts) AS d, ts, CASE WHEN event_id % 3 = 0 THEN (event_id % 4)::DOUBLE END AS gf, CASE WHEN event_id % 2 = 0 THEN (event_id % 5)::DOUBLE END AS ga FROM events),
v AS (SELECT user_id, d, ts, event_id, LAST_VALUE(gf IGNORE NULLS) OVER w AS gf, LAST_VALUE(ga IGNORE NULLS) OVER w AS ga FROM u WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, d, ts ORDER BY event_id DESC) AS n FROM v)
SELECT user_id AS team_id, ts AS available_at, gf AS goals_for, ga AS goals_against FROM l WHERE n = 1 AND gf IS NOT NULL AND ga IS NOT NULL""")
def team_version_stream(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    day = F.date_trunc("day", "ts")
    updates = table(spark, sf, "events").select(F.col("user_id").alias("team_id"), day.alias("match_id"), day.alias("event_time"), F.col("ts").alias("available_at"), k.alias("id"), F.when(k % 3 == 0, (k % 4).cast("double")).alias("goals_for"), F.when(k % 2 == 0, (k % 5).cast("double")).alias("goals_against"))
    return P.team_versions(updates, [F.col("id")]).select("team_id", "available_at", "goals_for", "goals_against")


@register("player_version_stream", """
WITH u AS (SELECT user_id, event_id, DATE_TRUNC('day', ts) AS d, ts, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 91 AS INT) END AS m, CASE WHEN event_id % 2 = 0 THEN (event_id % 5)::DOUBLE END AS g FROM events),
v AS (SELECT user_id, ts, event_id, d, LAST_VALUE(m IGNORE NULLS) OVER w AS m, LAST_VALUE(g IGNORE NULLS) OVER w AS g FROM u WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, d, ts ORDER BY event_id DESC) AS n FROM v)
SELECT user_id AS player_id, ts AS available_at, m AS minutes, g AS goals FROM l WHERE n = 1""")
def player_version_stream(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    day = F.date_trunc("day", "ts")
    updates = table(spark, sf, "events").select(F.col("user_id").alias("player_id"), day.alias("match_id"), day.alias("event_time"), F.col("ts").alias("available_at"), k.alias("id"), F.when(k % 3 == 0, (k % 91).cast("int")).alias("minutes"), F.when(k % 2 == 0, (k % 5).cast("double")).alias("goals"))
    return P.player_versions(updates, [F.col("id")]).select("player_id", "available_at", "minutes", "goals")


@register("upcoming_memberships", """
WITH f AS (SELECT n_nationkey AS match_id, CAST(n_nationkey AS VARCHAR) AS home, CAST((n_nationkey + 1) % 25 AS VARCHAR) AS away FROM nation),
p AS (SELECT c_custkey AS player_id, CAST(c_nationkey AS VARCHAR) AS team, CASE c_custkey % 3 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' ELSE 'MID' END AS role FROM customer WHERE c_custkey % 10 <> 0),
m AS (SELECT player_id, CASE WHEN player_id % 4 = 0 THEN CAST((CAST(team AS INT) + 3) % 25 AS VARCHAR) WHEN player_id % 4 = 1 THEN NULL ELSE team END AS team, role FROM p)
SELECT match_id, team AS team_id, player_id, role FROM m JOIN f ON team = home OR team = away""")
def upcoming_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Customers observed in their nation; a quarter has moved on since, a quarter has left, and one in ten was last seen years ago."""
    at = lambda text: F.lit(text).cast("timestamp")
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    fixtures = n.select(F.col("n_nationkey").alias("match_id"), F.col("n_nationkey").cast("string").alias("home_team_id"), ((F.col("n_nationkey") + 1) % 25).cast("string").alias("away_team_id"), at("2024-03-01 18:00:00").alias("kickoff_at"))
    k = F.col("c_custkey")
    role = F.when(k % 3 == 0, "GK").when(k % 3 == 1, "DEF").otherwise("MID")
    observed = c.select(k.alias("player_id"), F.when(k % 10 == 0, at("2020-01-01")).otherwise(at("2024-01-10")).alias("event_time"), F.col("c_nationkey").cast("string").alias("team_id"), role.alias("role"), at("2024-01-10").alias("available_at"))
    moved = F.when(k % 4 == 0, ((F.col("c_nationkey") + 3) % 25).cast("string"))
    transfers = c.filter("c_custkey % 4 < 2 AND c_custkey % 10 <> 0").select(k.alias("player_id"), F.lit("2024-02-01").cast("date").alias("transfer_date"), moved.alias("to_team_id"), F.lit(None).cast("string").alias("role"), at("2024-02-01").alias("available_at"), k.alias("id"))
    lineups = spark.createDataFrame([], "match_id bigint, player_id bigint, team_id string, role string, event_time timestamp, available_at timestamp, id bigint")
    return P.upcoming_memberships(fixtures, observed, transfers, lineups, at("2024-02-15")).select("match_id", "team_id", "player_id", "role")
