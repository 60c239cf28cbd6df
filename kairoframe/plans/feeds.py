"""Provider parsers and sinks over raw files and payloads made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import providers as P
from ..sources import replay, sinks, tables, versions
from ..sources.tables import table
from .catalog import register


def seen() -> F.Column:
    return F.lit("2024-01-05 12:00:00").cast("timestamp")


def text(column: F.Column | str) -> F.Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


# -------------------------------------------------------------- files of rows


@register("season_results", """
SELECT '9798:' || STRFTIME(o_orderdate, '%d/%m/%Y') || ':h' || (o_custkey % 20) || ':a' || (o_orderkey % 20) AS source_record_id, CAST(DATE_TRUNC('day', o_orderdate) AS TIMESTAMP) AS kickoff_at, CAST(DATE_TRUNC('day', o_orderdate) AS TIMESTAMP) + INTERVAL 27 HOUR AS available_at, CAST(o_orderkey % 5 AS INTEGER) AS home_score,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ref' END AS referee, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 17)::DOUBLE END AS shots, 1.5::DOUBLE + o_orderkey % 4 AS odds FROM orders WHERE o_orderkey % 7 <> 0""")
def season_results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("h"), F.col("o_custkey") % 20).alias("HomeTeam"), F.when(k % 7 != 0, F.concat(F.lit("a"), k % 20)).alias("AwayTeam"), text(k % 5).alias("FTHG"), text(k % 3).alias("FTAG"), F.lit("H").alias("FTR"),
        F.when(k % 2 == 0, "ref").otherwise("").alias("Referee"), F.when(k % 3 != 0, text(k % 17)).alias("HS"), text(1.5 + k % 4).alias("B365H"),
    )
    out = P.season_results(raw, "9798")
    return out.select("source_record_id", F.col("kickoff_at").cast("timestamp_ntz").alias("kickoff_at"), F.col("available_at").cast("timestamp_ntz").alias("available_at"), "home_score", "referee", F.try_element_at("stats", F.lit("home_shots")).alias("shots"), F.try_element_at("odds", F.lit("bet365_home")).alias("odds"))


@register("scheduled_matches", """
SELECT CAST(o_orderkey AS VARCHAR) AS match_id, '1997-98' AS season, CAST(o_orderdate AS TIMESTAMP) AS kickoff_at, CASE WHEN o_orderkey % 2 = 0 THEN 'minute' ELSE 'date' END AS kickoff_precision,
  CASE WHEN o_orderstatus <> 'F' THEN TIMESTAMP '2024-01-05 12:00:00' WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 HOUR ELSE DATE_TRUNC('day', o_orderdate) + INTERVAL 27 HOUR END AS available_at, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'fixture' END AS status, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 4 AS INTEGER) END AS home_score FROM orders""")
def scheduled_matches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.date_format("o_orderdate", "yyyy-MM-dd")
    done = F.col("o_orderstatus") == "F"
    raw = table(spark, sf, "orders").select(k.alias("match_id"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(written).alias("match_date"), F.lit("x").alias("home_team"), F.lit("y").alias("away_team"), F.lit(1).alias("home_team_id"), F.lit(2).alias("away_team_id"), F.when(done, "Played").otherwise("Fixture").alias("match_status"), F.lit("1997/98").alias("season"), F.when(done, k % 4).alias("home_score"))
    out = P.scheduled_matches(raw, seen())
    return out.select("match_id", "season", F.col("kickoff_at").cast("timestamp_ntz").alias("kickoff_at"), "kickoff_precision", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "status", "home_score")


@register("player_match_rows", """
SELECT l_orderkey || ':' || l_partkey AS source_record_id, CAST(l_quantity AS INTEGER) AS minutes, l_linenumber <= 2 AS started, BOOL_OR(l_linenumber = 3) OVER (PARTITION BY l_orderkey) AS covered, CASE WHEN l_linenumber = 3 THEN l_tax END AS shots FROM lineitem""")
def player_match_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A match is covered if one of its rows (here the third line) has a statistic."""
    raw = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), text("l_shipdate").alias("match_date"), F.col("l_partkey").alias("player_id"), F.lit("p").alias("player_name"), F.col("l_suppkey").alias("team_id"), F.lit("t").alias("team_name"), F.col("l_quantity").alias("mins_played"), (F.col("l_linenumber") <= 2).alias("is_starter"), F.when(F.col("l_linenumber") == 3, F.col("l_tax")).alias("total_scoring_att"))
    return P.player_matches(raw).select("source_record_id", "minutes", "started", F.col("event_statistics_available").alias("covered"), F.try_element_at("stats", F.lit("shots")).alias("shots"))


@register("lineup_rows", "SELECT 'lineup:' || l_orderkey || ':' || l_partkey AS source_record_id, l_linenumber <= 2 AS is_starting, CAST(l_quantity AS INTEGER) AS shirt_number, CAST(NULL AS VARCHAR) AS formation_slot FROM lineitem")
def lineup_rows(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("team_id"), F.col("l_partkey").alias("player_id"), (F.col("l_linenumber") <= 2).cast("int").alias("is_starter"), text(F.col("l_quantity").cast("int")).alias("shirt_number"))
    return P.lineups(raw).select("source_record_id", "is_starting", "shirt_number", "formation_slot")


@register("shot_coverage", """
WITH s AS (SELECT l_orderkey AS m, l_partkey AS p, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS xg FROM lineitem WHERE l_quantity >= 5),
t AS (SELECT m, p, COUNT(*) AS n, COUNT(xg) AS w, ROUND(SUM(xg), 6) AS xg FROM s GROUP BY ALL)
SELECT m AS match_id, p AS player_id, n AS attempts, CASE WHEN CASE WHEN m % 3 = 0 THEN n + 1 ELSE n END = n AND w = n THEN xg END AS xg FROM t""")
def shot_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Shots (own goals left out) summed per player; the sum stands where all reported shots have a value."""
    line = F.col("l_linenumber")
    raw = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), line.alias("event_id"), F.col("l_suppkey").alias("team_id"), F.col("l_partkey").alias("player_id"), (line == 1).alias("is_goal"), (F.col("l_quantity") < 5).alias("is_own_goal"), F.lit(50.0).alias("x"), F.lit(50.0).alias("y"), F.when(line % 5 != 0, F.col("l_discount")).alias("xg"))
    totals = P.shot_totals(P.shots(raw).withColumn("available_at", seen()))
    reported = F.when(F.col("match_id") % 3 == 0, F.col("attempts") + 1).otherwise(F.col("attempts"))
    return totals.select("match_id", "player_id", "attempts", F.round(P.covered_xg(reported, F.col("attempts"), F.col("with_xg"), F.col("xg")), 6).alias("xg"))


@register("typed_events", """
SELECT 'event:' || user_id || ':' || event_id AS source_record_id, CASE WHEN event_id % 4 = 1 THEN 'own_goal' WHEN event_id % 2 = 1 THEN 'goal' WHEN event_id % 4 = 0 THEN 'pass' ELSE 'unclassified' END AS event_type, CAST(event_id % 90 * 60 + event_id % 60 AS INTEGER) AS second, (event_id % 100) / 100.0::DOUBLE AS x FROM events""")
def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    raw = table(spark, sf, "events").select(F.col("user_id").alias("match_id"), "event_id", F.when(e % 2 == 1, 16).when(e % 4 == 0, 1).otherwise(9999).alias("type_id"), (e % 90).alias("minute"), (e % 60).alias("second"), F.when(e % 4 == 1, '{"28": ""}').alias("qualifier_json"), (e % 100).cast("double").alias("x"))
    return P.events(raw).select("source_record_id", "event_type", "second", "x")


@register("team_xg_rows", """
WITH g AS (SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 'h' AS h, 'a' AS a, CASE WHEN o_orderkey % 30 <= 20 THEN (o_orderkey % 30)::DOUBLE END AS hx, o_orderkey % 3 + 0.5::DOUBLE AS ax FROM orders)
SELECT match_id, h AS team, TRUE AS is_home, hx AS xg_for, ax AS xg_against FROM g UNION ALL SELECT match_id, a, FALSE, ax, hx FROM g""")
def team_xg_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(k.alias("game_id"), text("o_orderdate").alias("date"), F.lit("h").alias("home_team"), F.lit("a").alias("away_team"), F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"), (k % 30).cast("double").alias("home_xg"), (k % 3 + 0.5).alias("away_xg"))
    return P.team_xg(raw).select("match_id", "team", "is_home", "xg_for", "xg_against")


@register("pasted_rosters", """
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'GK' WHEN c_custkey % 3 = 1 THEN 'DEF/MID' ELSE 'FWD' END AS roles, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS team, CASE WHEN c_custkey % 3 = 1 THEN 12.5::DOUBLE END AS price, c_custkey % 3 = 2 AS issue FROM customer WHERE c_custkey % 10 <> 9""")
def pasted_rosters(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    line = F.when(c % 10 == 9, "Nome;Ruolo").when(c % 3 == 0, F.concat_ws(";", "c_name", F.lit("P"), "c_mktsegment")).when(c % 3 == 1, F.concat_ws("\t", "c_name", F.lit("D/C"), "c_mktsegment", F.lit("12,5 €"))).otherwise(F.concat_ws(",", "c_name", F.lit("striker zz")))
    out = tables.pasted_rosters(table(spark, sf, "customer").select("c_custkey", line.alias("line")), ["c_custkey"])
    return out.select("c_custkey", "name", F.array_join("roles", "/").alias("roles"), "team", "price", "issue")


@register("roster_csv", "SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'GK' END AS role, CAST(NULL AS VARCHAR) AS team, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS price FROM supplier")
def roster_csv(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "supplier").select(F.col("s_name").alias(" Player "), F.when(F.col("s_suppkey") % 2 == 0, "GK").otherwise(" ").alias("ROLE"), F.replace(text("s_acctbal"), F.lit("."), F.lit(",")).alias("Price"))
    return tables.roster_csv(raw)


@register("renamed_scan", "SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def renamed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A file with names in camel case, read under snake case with an equality pushed to the scan."""
    k = F.col("o_orderkey")
    path = f"{tables.shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    table(spark, sf, "orders").select(k.alias("orderKey"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("Priority")).write.parquet(path)
    return tables.scoped_parquet(spark, path, ["order_key", "priority"], priority="1-URGENT").select("order_key", "total")


# ---------------------------------------------------------- operational JSON


def _payload(rows: DataFrame, *columns: F.Column) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(*columns)).alias("response")))
    return rows.select(seen().alias("observed_at"), body.alias("body"))


_named = lambda i, n: F.struct(i.alias("id"), F.lit(n).alias("name"))


@register("json_fixtures", """
SELECT CAST(o_orderkey AS VARCHAR) AS match_id, '1997-1998' AS season, o_orderdate AS kickoff_at, CASE o_orderkey % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'scheduled' ELSE 'postponed' END AS status, CAST(o_orderkey % 38 AS INTEGER) AS matchweek, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS home_score FROM orders""")
def json_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    short = F.when(k % 3 == 0, "FT").when(k % 3 == 1, "NS").otherwise("PST")
    body = _payload(
        table(spark, sf, "orders"),
        F.struct(k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"), F.struct(short.alias("short")).alias("status")).alias("fixture"),
        F.struct(F.lit(135).alias("id"), F.lit(1997).alias("season"), F.concat(F.lit("Regular Season - "), k % 38).alias("round")).alias("league"),
        F.struct(_named(F.lit(1), "h").alias("home"), _named(F.lit(2), "a").alias("away")).alias("teams"),
        F.struct((k % 4).alias("home"), F.lit(0).alias("away")).alias("goals"),
    )
    out = P.fixture_matches(P.rows_of(body, "body", P.FIXTURES))
    return out.select("match_id", "season", F.col("kickoff_at").cast("timestamp_ntz").alias("kickoff_at"), "status", "matchweek", "home_score")


@register("json_statistics", """
SELECT CAST(o_orderkey AS VARCHAR) AS match_id, v.side, 'Ball Possession' AS statistic, v.value FROM orders, LATERAL (SELECT 'home' AS side, (o_orderkey % 100)::DOUBLE AS value UNION ALL SELECT 'away', 100 - (o_orderkey % 100)::DOUBLE) v WHERE o_orderkey % 3 = 0""")
def json_statistics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    share = lambda v: F.array(F.struct(F.lit("Ball Possession").alias("type"), F.concat(text(v), F.lit("%")).alias("value")))
    body = _payload(
        table(spark, sf, "orders"), F.struct(k.alias("id"), F.struct(F.when(k % 3 == 0, "FT").otherwise("NS").alias("short")).alias("status")).alias("fixture"), F.struct(_named(F.lit(1), "h").alias("home"), _named(F.lit(2), "a").alias("away")).alias("teams"),
        F.array(F.struct(_named(F.lit(1), "h").alias("team"), share(k % 100).alias("statistics")), F.struct(_named(F.lit(2), "a").alias("team"), share(100 - k % 100).alias("statistics"))).alias("statistics"),
    )
    return P.fixture_statistics(P.rows_of(body, "body", P.FIXTURES))


@register("json_sheets_and_events", """
SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 'lineup' AS kind, CAST(o_custkey AS VARCHAR) AS player_id, 'starting' AS detail FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lineup', CAST(o_custkey + 1 AS VARCHAR), 'bench' FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'event', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END, CAST((o_orderkey % 90 + 2) * 60 AS VARCHAR) FROM orders""")
def json_sheets_and_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    player = lambda i: F.array(F.struct(F.struct(i.alias("id"), F.lit("n").alias("name"), F.lit(9).alias("number"), F.lit("F").alias("pos")).alias("player")))
    c = F.col("o_custkey")
    event = F.struct(F.struct((k % 90).alias("elapsed"), F.lit(2).alias("extra")).alias("time"), _named(F.lit(1), "h").alias("team"), F.struct(c.alias("id"), F.when(k % 2 == 0, "n").alias("name")).alias("player"), F.lit("Goal").alias("type"), F.lit("x").alias("detail"))
    body = _payload(table(spark, sf, "orders"), F.struct(k.alias("id")).alias("fixture"), F.array(F.struct(_named(F.lit(1), "h").alias("team"), player(c).alias("startXI"), player(c + 1).alias("substitutes"))).alias("lineups"), F.array(event).alias("events"))
    rows = P.rows_of(body, "body", P.FIXTURES)
    sheets = P.fixture_lineups(rows).select("match_id", F.lit("lineup").alias("kind"), "player_id", F.when(F.col("is_starting"), "starting").otherwise("bench").alias("detail"))
    return sheets.unionByName(P.fixture_events(rows).select("match_id", F.lit("event").alias("kind"), "player_id", text("second").alias("detail")))


@register("json_absences", "SELECT CAST(c_custkey AS VARCHAR) AS player_id, c_custkey % 4 = 0 AS suspended, CASE WHEN c_custkey % 2 = 0 THEN 'out' ELSE 'doubtful' END AS status, DATE '2024-01-03' AS starts_on FROM customer")
def json_absences(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    body = _payload(table(spark, sf, "customer"), F.struct(c.alias("id"), F.lit("n").alias("name"), F.when(c % 2 == 0, "Missing Fixture").otherwise("Questionable").alias("type"), F.when(c % 4 == 0, "Suspended").otherwise("Knee").alias("reason")).alias("player"), _named(F.lit(1), "h").alias("team"), F.struct(F.lit(1).alias("id"), F.lit("2024-01-03T18:00:00+00:00").alias("date")).alias("fixture"))
    return P.injuries(P.rows_of(body, "body", P.INJURIES)).select("player_id", "suspended", "status", "starts_on")


@register("json_standings", "SELECT '2023-2024' AS season, CAST(n_nationkey AS VARCHAR) AS team_id, CAST(n_nationkey + 1 AS INTEGER) AS rank, CAST(n_nationkey % 7 AS INTEGER) AS won, CAST(n_nationkey % 5 AS INTEGER) AS goals_against FROM nation")
def json_standings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    games = F.struct(F.lit(10).alias("played"), (n % 7).alias("win"), F.lit(1).alias("draw"), F.lit(2).alias("lose"), F.struct(F.lit(3).alias("for"), (n % 5).alias("against")).alias("goals"))
    item = F.struct((n + 1).alias("rank"), _named(n, "t").alias("team"), F.lit(30).alias("points"), games.alias("all"))
    body = _payload(table(spark, sf, "nation"), F.struct(F.lit(2023).alias("season"), F.array(F.array(item)).alias("standings")).alias("league"))
    return P.standings(P.rows_of(body, "body", P.STANDINGS)).select("season", "team_id", "rank", "won", "goals_against")


@register("json_transfers", "SELECT 'transfer:' || c_custkey || ':2023-07-0' || (v.i + 1) || ':' || v.i AS source_record_id, CAST(c_nationkey AS VARCHAR) AS to_team, MAKE_DATE(2023, 7, CAST(v.i + 1 AS INTEGER)) AS transfer_date FROM customer, (VALUES (0), (1)) v(i)")
def json_transfers(spark: SparkSession, sf: str) -> DataFrame:
    move = lambda day: F.struct(F.lit(day).alias("date"), F.lit("Loan").alias("type"), F.struct(_named(F.col("c_nationkey"), "t").alias("in"), _named(F.lit(0), "o").alias("out")).alias("teams"))
    body = _payload(table(spark, sf, "customer"), _named(F.col("c_custkey"), "n").alias("player"), F.array(move("2023-07-01"), move("2023-07-02")).alias("transfers"))
    return P.transfers(P.rows_of(body, "body", P.TRANSFERS)).select("source_record_id", "to_team", "transfer_date")


@register("json_odds", "SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 'book' AS bookmaker, 'Winner' AS market, v.s AS selection, v.o AS decimal_odds FROM orders, LATERAL (SELECT 'Home' AS s, CAST(1.5 + o_orderkey % 3 AS DECIMAL(10, 4)) AS o UNION ALL SELECT 'Away', CASE WHEN o_orderkey % 2 = 0 THEN CAST(4 AS DECIMAL(10, 4)) END) v WHERE v.o IS NOT NULL")
def json_odds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = F.array(F.struct(F.lit("Home").alias("value"), text(1.5 + k % 3).alias("odd")), F.struct(F.lit("Away").alias("value"), F.when(k % 2 == 0, "4.0").alias("odd")))
    bets = F.array(F.struct(F.lit(1).alias("id"), F.lit("Winner").alias("name"), values.alias("values")))
    body = _payload(table(spark, sf, "orders"), F.struct(k.alias("id")).alias("fixture"), F.array(F.struct(F.lit(8).alias("id"), F.lit("book").alias("name"), bets.alias("bets"))).alias("bookmakers"))
    return P.odds(P.rows_of(body, "body", P.ODDS)).select("match_id", "bookmaker", "market", "selection", "decimal_odds")


@register("competition_matches", """
SELECT CAST(o_orderkey AS VARCHAR) AS match_id, '1997-1998' AS season, CASE o_orderkey % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'scheduled' ELSE 'live' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'sh' ELSE 'long h' END AS home_team, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS home_score, CASE WHEN o_orderkey % 5 <> 0 THEN 'ref' END AS referee FROM orders""")
def competition_matches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    home = F.struct(F.lit(1).alias("id"), F.lit("long h").alias("name"), F.when(k % 2 == 0, "sh").alias("shortName"))
    judges = F.array(F.struct(F.lit(1).alias("id"), F.lit("other").alias("name"), F.lit("VAR").alias("type")), F.struct(F.lit(2).alias("id"), F.lit("ref").alias("name"), F.when(k % 5 != 0, "REFEREE").otherwise("FOURTH").alias("type")))
    m = F.struct(k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"), F.when(k % 3 == 0, "FINISHED").when(k % 3 == 1, "TIMED").otherwise("PAUSED").alias("status"), (k % 38).alias("matchday"), F.struct(F.lit("1997-08-01").alias("startDate")).alias("season"), home.alias("homeTeam"), home.alias("awayTeam"), F.struct(F.struct((k % 4).alias("home"), F.lit(0).alias("away")).alias("fullTime")).alias("score"), judges.alias("referees"))
    body = table(spark, sf, "orders").select(seen().alias("observed_at"), F.to_json(F.struct(F.array(m).alias("matches"))).alias("body"))
    return P.competition_matches(P.competition_body(body, "body")).select("match_id", "season", "status", "home_team", "home_score", "referee")


@register("competition_tables", """
SELECT '2023-2024' AS season, 'TOTAL' AS table_type, CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS team, CAST(n_nationkey + 1 AS INTEGER) AS rank FROM nation UNION ALL SELECT NULL, 'team', CAST(n_nationkey AS VARCHAR), n_name, NULL FROM nation""")
def competition_tables(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    team = F.struct(n.alias("id"), F.col("n_name").alias("name"))
    row = F.struct((n + 1).alias("position"), team.alias("team"), F.lit(3).alias("playedGames"), F.lit(4).alias("points"), F.lit(1).alias("won"), F.lit(1).alias("draw"), F.lit(1).alias("lost"), F.lit(2).alias("goalsFor"), F.lit(2).alias("goalsAgainst"))
    whole = F.struct(F.struct(F.lit("2023-08-01").alias("startDate")).alias("season"), F.array(F.struct(F.lit("TOTAL").alias("type"), F.array(row).alias("table"))).alias("standings"), F.array(team).alias("teams"))
    body = P.competition_body(table(spark, sf, "nation").select(seen().alias("observed_at"), F.to_json(whole).alias("body")), "body")
    teams = P.competition_teams(body).select(F.lit(None).cast("string").alias("season"), F.lit("team").alias("table_type"), "team_id", "team", F.lit(None).cast("int").alias("rank"))
    return P.competition_standings(body).select("season", "table_type", "team_id", "team", "rank").unionByName(teams)


# --------------------------------------------------------------------- sinks


def _place(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("snapshot_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written under its digest twice (the second time nothing is written), read back and verified."""
    where = _place(spark, "snapshots")
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = sinks.write_snapshot(df, where, "customers", "v1")
    again = sinks.write_snapshot(df.repartition(3), where, "customers", "v1")
    if first != again:
        raise ValueError("equal rows must have one snapshot")
    return sinks.read_snapshot(spark, again)


@register("raw_archive", "SELECT event_type AS provider, COUNT(DISTINCT props) AS n FROM events GROUP BY 1")
def raw_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads archived in two deliveries, each content of a provider once, and read back with their digests checked."""
    where = _place(spark, "raw")
    e = table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.lit("2324").alias("season"), F.col("props").alias("content"), "event_id")
    sinks.write_raw(e.filter("event_id % 2 = 0").drop("event_id"), where)
    sinks.write_raw(e.drop("event_id"), where, spark.read.parquet(where))
    return sinks.read_raw(spark, where).groupBy("provider").agg(F.count("content").alias("n"))


_REPLAY = """
WITH runs AS (SELECT k, 'r' || LPAD(CAST(k AS VARCHAR), 2, '0') AS run, CASE WHEN k = 5 THEN 'failed' ELSE 'succeeded' END AS status FROM RANGE(14) t(k)),
sent AS (
  SELECT l_orderkey % 12 AS k, l_orderkey AS o, l_linenumber AS line, l_partkey AS part, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity, l_shipdate AS seen FROM lineitem
  UNION ALL SELECT 12, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 3 THEN NULL ELSE l_quantity END, l_shipdate FROM lineitem WHERE l_orderkey % 10 = 0
  UNION ALL SELECT 13, l_orderkey, l_linenumber, l_partkey, l_quantity + 1, l_shipdate FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 3
)
"""


@register("raw_replay", _REPLAY + """
, valid AS (SELECT s.*, '{"o":' || o || ',"line":' || line || ',"part":' || part || ',"quantity":' || CAST(quantity AS INTEGER) || '}' AS content FROM sent s JOIN runs USING (k) WHERE status = 'succeeded' AND quantity IS NOT NULL),
first AS (SELECT o, line, part, content, seen, MIN(k) AS k FROM valid GROUP BY ALL),
won AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o, line ORDER BY seen DESC, k DESC, SHA256(content) DESC) AS n FROM first)
SELECT o, line, part, CAST(content->>'quantity' AS INTEGER) AS quantity, seen AS available_at, 'r' || LPAD(CAST(k AS VARCHAR), 2, '0') AS run_id FROM won WHERE n = 1""")
def raw_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines rebuilt from their archived payloads in three batches; the first attempt is lost in the second one, and the third changes nothing.

    One run failed, one repeats observations, and payloads without a quantity are superseded by a later run.
    """
    lines = table(spark, sf, "lineitem")
    put = lambda run, quantity, rows: rows.select(run.cast("int").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), quantity.cast("int").alias("quantity"), F.col("l_shipdate").alias("available_at"))
    unknown = (F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 3)
    quantity = F.when(~unknown, F.col("l_quantity"))
    sent = put(F.col("l_orderkey") % 12, quantity, lines).union(put(F.lit(12), quantity, lines.filter("l_orderkey % 10 = 0"))).union(put(F.lit(13), F.col("l_quantity") + 1, lines.filter(unknown)))
    run_id = lambda k: F.concat(F.lit("r"), F.lpad(k.cast("string"), 2, "0"))
    content = F.to_json(F.struct("o", "line", "part", "quantity"))
    observations = sent.select(run_id(F.col("k")).alias("run_id"), F.lit("player_lines").alias("kind"), F.concat_ws(":", "o", "line").alias("object_id"), content.alias("content"), F.sha2(content, 256).alias("sha256"), "available_at")
    runs = spark.range(14).select(run_id(F.col("id")).alias("run_id"), F.lit("shop").alias("source"), F.lit("all").alias("scope"), F.when(F.col("id") == 5, "failed").otherwise("succeeded").alias("status"), F.timestamp_seconds(F.col("id") * 86400).alias("started_at"), F.lit(None).cast("string").alias("replay_of"))
    planned = replay.plan(runs, observations, valid=F.get_json_object("content", "$.quantity").isNotNull())
    parse = lambda rows: rows.select("*", F.from_json("content", "o bigint, line int, part bigint, quantity int").alias("j")).select(*rows.columns, "j.*")
    targets = [replay.Target("lines", ("player_lines",), ("o", "line"), parse)]
    store = versions.Store(spark, _place(spark, "replay"))

    def lost(batch: int) -> None:
        if batch == 1:
            raise ConnectionError("the run is lost")

    try:
        replay.replay(store, planned, targets, 3, lost, keep=1)
    except ConnectionError:
        replay.replay(store, planned, targets, 3, keep=1)
    number = store.head()[0]
    replay.replay(store, planned, targets, 2, keep=1)
    if store.head()[0] != number:
        raise AssertionError("a second replay has changed the tables")
    tables.unstaged(planned.observations)
    return store.read("lines").select("o", "line", "part", "quantity", "available_at", "run_id")


@register("versioned_updates", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'retired' ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance FROM supplier WHERE s_suppkey % 5 <> 0""")
def versioned_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A table of versions: insert, upsert the even rows, update by predicate, delete by predicate."""
    where = _place(spark, "suppliers")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    sinks.merge_into(spark, where, s, ["s_suppkey"])
    sinks.merge_into(spark, where, s.filter("s_suppkey % 2 = 0").withColumn("balance", F.col("balance") + 1), ["s_suppkey"])
    sinks.update_where(spark, where, F.col("s_suppkey") % 3 == 0, {"name": F.lit("retired")})
    sinks.delete_where(spark, where, F.col("s_suppkey") % 5 == 0)
    return sinks.current(spark, where)


@register("quarantined_rows", "SELECT 'kept' AS side, COUNT(*) AS n FROM lineitem WHERE l_discount <= 0.05 UNION ALL SELECT 'rejected', COUNT(*) FROM lineitem WHERE NOT COALESCE(l_discount <= 0.05, FALSE)")
def quarantined_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept, rejected = Q.quarantine(table(spark, sf, "lineitem"), F.col("l_discount") <= 0.05)
    return kept.agg(F.lit("kept").alias("side"), F.count("*").alias("n")).unionByName(rejected.agg(F.lit("rejected").alias("side"), F.count("*").alias("n")))
