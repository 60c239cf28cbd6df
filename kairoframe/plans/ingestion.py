"""Names, roles, resolution, availability and market queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import resolution as V
from ..sources.tables import table
from .catalog import register

ntz = lambda text: F.lit(text).cast("timestamp_ntz")

# ------------------------------------------------------------------- scalars

PLAIN, ACCENTED = "aceilnorsuz", "ăčęíłňøřšüž"


@register("normalize_names", f"""
SELECT p_partkey, TRIM(REGEXP_REPLACE(LOWER(STRIP_ACCENTS(TRANSLATE(p_name, '{PLAIN}', '{ACCENTED}'))), '[^a-z0-9]+', ' ', 'g')) AS name,
  TRIM(REGEXP_REPLACE(REPLACE(LOWER(STRIP_ACCENTS('Ça ' || p_name || 'ß-ÉÑ')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS other FROM part""")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names written with marks: letters that decompose lose them, others (ł, ø) are no letters a-z."""
    name = F.col("p_name")
    marked = F.translate(name, PLAIN, ACCENTED)
    return table(spark, sf, "part").select("p_partkey", S.normalize_name(marked).alias("name"), S.normalize_name(F.concat(F.lit("Ça "), name, F.lit("ß-ÉÑ"))).alias("other"))


@register("normalize_teams", """
WITH t AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'A.C. ' || n_name || ' F.C.' WHEN 1 THEN n_name || ' Calcio' WHEN 2 THEN 'US Lecce' ELSE 'Hellas  Verona' END AS n FROM nation)
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 2 THEN 'lecce' WHEN 3 THEN 'verona' ELSE TRIM(REGEXP_REPLACE(LOWER((SELECT n_name FROM nation x WHERE x.n_nationkey = t.n_nationkey)), '[^a-z0-9]+', ' ', 'g')) END AS team FROM t""")
def normalize_teams(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("n_nationkey") % 4, F.col("n_name")
    written = F.when(k == 0, F.concat(F.lit("A.C. "), n, F.lit(" F.C."))).when(k == 1, F.concat(n, F.lit(" Calcio"))).when(k == 2, "US Lecce").otherwise("Hellas  Verona")
    return table(spark, sf, "nation").select("n_nationkey", S.normalize_team(written).alias("team"))


_ROLE = "CASE c_custkey % 7 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'wing-back' WHEN 2 THEN ' Attaccante ' WHEN 3 THEN 'POR' WHEN 4 THEN 'D' WHEN 5 THEN 'coach' END"


@register("role_dictionaries", """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'FWD' WHEN 3 THEN 'GK' END AS football,
  CASE c_custkey % 7 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'FWD' WHEN 3 THEN 'Por' WHEN 4 THEN 'D' WHEN 5 THEN 'coach' ELSE 'MID' END AS fantasy,
  CASE c_custkey % 7 WHEN 0 THEN 'GK' WHEN 2 THEN 'FWD' WHEN 3 THEN 'GK' WHEN 4 THEN 'DEF' END AS token FROM customer""")
def role_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    role = F.expr(_ROLE)
    return table(spark, sf, "customer").select("c_custkey", S.football_role(role).alias("football"), S.fantasy_role(role, F.lit("Midfielder")).alias("fantasy"), S.role_token(role).alias("token"))


@register("photo_name_scores", """
WITH n AS (SELECT p_partkey, p_name AS target, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'x ' || p_name ELSE SUBSTR(p_name, 1, 1) || ' ' || SPLIT_PART(p_name, ' ', 2) END AS name,
  CASE WHEN p_partkey % 4 = 2 THEN SPLIT_PART(p_name, ' ', 2) ELSE '' END AS last FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN CASE WHEN SUBSTR(target, 1, 1) = 'x' THEN 80 ELSE 0 END WHEN 2 THEN 90 ELSE 80 END AS score FROM n""")
def photo_name_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    last = F.split_part(name, F.lit(" "), F.lit(2))
    other = F.when(k == 0, name).when(k == 1, F.concat(F.lit("x "), name)).otherwise(F.concat(F.substring(name, 1, 1), F.lit(" "), last))
    return table(spark, sf, "part").select("p_partkey", S.photo_name_score(name, other, F.lit(""), F.when(k == 2, last).otherwise("")).alias("score"))


@register("lenient_numbers", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_tax WHEN 1 THEN l_discount ELSE l_quantity END AS number,
  CASE WHEN l_linenumber % 3 <> 1 THEN l_discount END AS price FROM lineitem""")
def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A percent, a decimal comma or no number (then the next alias); prices below zero are none."""
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.concat(F.col("l_tax").cast("string"), F.lit("%"))).when(k == 1, F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))).otherwise("n/a")
    price = F.concat(F.when(k == 1, "-1").otherwise(""), F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.number(text, F.col("l_quantity")).alias("number"), S.decimal(price).alias("price"))


@register("full_names_and_flags", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'first' ELSE 'first ' || s_name END AS name, CASE WHEN s_suppkey % 3 = 0 OR s_acctbal < 0 THEN 0 ELSE 1 END AS covered,
  REGEXP_REPLACE(s_name, '[^A-Za-z0-9_.-]+', '_', 'g') || '_x' AS identifier, s_suppkey % 2 = 0 AS secure FROM supplier""")
def full_names_and_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    first = F.when(k == 0, " ").otherwise("first")
    last = F.when(k == 2, F.col("s_name"))
    url = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "https://").otherwise("http://"), F.lit("host/photo"))
    covered = S.all_present(F.nullif(F.trim(first), F.lit("")), F.when(F.col("s_acctbal") >= 0, 1))
    return table(spark, sf, "supplier").select("s_suppkey", S.full_name(first, last, fallback=F.col("s_name")).alias("name"), covered.alias("covered"), S.safe_identifier(F.concat(F.lit("._"), "s_name", F.lit(" /x._"))).alias("identifier"), S.secure_url(url).alias("secure"))


@register("json_shapes", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '$.a.b[],$.a.c,$.k' ELSE '$.k' END AS paths, '{"k":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '","seen":"' || event_type || '"}' AS marked FROM events""")
def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": {"b": [1, 2], "c": null}, '), F.substring("props", 2, 1000))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.array_join(S.json_paths(nested), ",").alias("paths"), S.json_set(F.col("props"), "seen", F.col("event_type")).alias("marked"))


@register("event_times", "SELECT event_id, ts + INTERVAL 1 SECOND * (CAST(json_extract(props, '$.k') AS BIGINT) * 60 + event_id % 60) AS at, CASE WHEN event_id % 2 = 0 THEN ts ELSE DATE_TRUNC('day', ts) END AS known_from FROM events")
def event_times(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", S.elapsed(F.col("ts"), minute, F.col("event_id") % 60).alias("at"), S.known_before(F.col("ts"), F.col("event_id") % 2 == 0).cast("timestamp_ntz").alias("known_from"))


@register("utc_times", "SELECT o_orderkey, o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS at FROM orders")
def utc_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise("Z"))
    seconds = F.unix_timestamp(S.to_utc(text))
    return table(spark, sf, "orders").select("o_orderkey", F.timestamp_add("SECOND", seconds, ntz("1970-01-01")).alias("at"))


# ---------------------------------------------------------------- predicates


@register("closed_and_upcoming", """
SELECT 'closed' AS kind, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'upcoming', o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' AND o_orderdate <= TIMESTAMP '1997-06-01' + INTERVAL 90 DAY AND o_orderstatus <> 'F'""")
def closed_and_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "finished").otherwise("scheduled"))
    closed = V.closed_periods(o, "o_orderdate", ntz("1996-01-01")).select(F.lit("closed").alias("kind"), "o_orderkey")
    return closed.unionByName(V.upcoming(o, "o_orderdate", "status", ntz("1997-06-01")).select(F.lit("upcoming").alias("kind"), "o_orderkey"))


@register("eligible_examples", "SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL AND source IS NOT NULL AND lang = 'en'")
def eligible_examples(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return V.eligible(joined, "toxic", "source", F.col("lang") == "en").select("doc_id", "toxic")


@register("either_side", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey = 7 OR l_partkey = 7) AND EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0)")
def either_side(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter(R.either(F.col("l_suppkey"), F.col("l_partkey"), 7)).select("l_orderkey", "l_linenumber")
    return rows if not table(spark, sf, "supplier").filter("s_acctbal < 0").isEmpty() else rows.limit(0)


@register("join_distinct_references", "SELECT s_suppkey, s_name FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 45) JOIN supplier ON s_suppkey = l_suppkey")
def join_distinct_references(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, sf, "supplier").join(used, "s_suppkey").select("s_suppkey", "s_name")


# ---------------------------------------------------------------- resolution


@register("team_get_or_create", """
WITH k AS (SELECT p_name, COUNT(*) AS n, MIN(p_partkey) AS key FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT i.p_partkey AS record, CASE WHEN n = 1 THEN CAST(key AS VARCHAR) WHEN n IS NULL THEN 'new-' || SUBSTR(SHA256(i.p_name), 1, 16) END AS team_id, CASE WHEN n > 1 THEN 'blocked' WHEN n = 1 THEN 'found' ELSE 'created' END AS state
FROM part i LEFT JOIN k ON i.p_name = k.p_name WHERE i.p_partkey % 3 <> 0""")
def team_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("team_id"), F.col("p_name").alias("known_name"))
    return V.get_or_create(part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("record"), "p_name"), known, "p_name", "team_id", "known_name").select("record", "team_id", "state")


_CAST = "SELECT l_orderkey AS match_id, l_suppkey % 5 AS team_id, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"


@register("player_get_or_create", f"""
WITH c AS ({_CAST}),
k AS (SELECT match_id, team_id, l_partkey AS key, p_name AS name FROM c WHERE l_linenumber % 2 = 0),
i AS (SELECT match_id, team_id, l_linenumber AS line, SUBSTR(p_name, 1, 1) || ' ' || SPLIT_PART(p_name, ' ', 2) AS name FROM c WHERE l_linenumber % 2 = 1),
p AS (SELECT i.match_id, i.team_id, i.name, k.key, COALESCE(SUBSTR(k.name, 1, 1) = SUBSTR(i.name, 1, 1) AND SPLIT_PART(k.name, ' ', 2) = SPLIT_PART(i.name, ' ', 2), FALSE) AS fits, COALESCE(SPLIT_PART(k.name, ' ', 2) = SPLIT_PART(i.name, ' ', 2), FALSE) AS surname FROM i LEFT JOIN k ON i.match_id = k.match_id AND i.team_id = k.team_id),
g AS (SELECT match_id, team_id, name, COUNT(DISTINCT key) FILTER (WHERE fits) AS n, MIN(CAST(key AS VARCHAR)) FILTER (WHERE fits) AS key, SUM(CAST(surname AS INT)) AS m FROM p GROUP BY ALL)
SELECT i.match_id, line, CASE WHEN n = 1 THEN key ELSE 'new-' || SUBSTR(SHA256(i.match_id || '|' || i.team_id || '|' || i.name), 1, 16) END AS player_id, CASE WHEN n = 1 THEN 'found' ELSE 'created' END AS state, CASE WHEN n > 1 THEN 'same name' WHEN n <> 1 AND m > 0 THEN 'same surname' END AS review
FROM i JOIN g ON g.match_id = i.match_id AND g.team_id = i.team_id AND g.name = i.name""")
def player_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    cast = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("match_id"), (F.col("l_suppkey") % 5).alias("team_id"), F.col("l_linenumber").alias("line"), "l_partkey", "p_name")
    known = cast.filter("line % 2 = 0").select("match_id", "team_id", F.col("l_partkey").alias("player_id"), F.col("p_name").alias("name"))
    short = F.concat(F.substring("p_name", 1, 1), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    incoming = cast.filter("line % 2 = 1").select("match_id", "team_id", "line", short.alias("name"))
    return V.players_get_or_create(incoming, known).select("match_id", "line", "player_id", "state", "review")


@register("match_get_or_create", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate AS w, o_orderpriority AS score FROM orders),
k AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), i AS (SELECT * FROM o WHERE o_orderkey % 2 = 1),
p AS (SELECT i.o_orderkey AS rec, k.w, CAST(k.o_orderkey AS VARCHAR) AS key, CAST(i.w AS DATE) = CAST(k.w AS DATE) AS day, i.score = k.score AND ABS(EPOCH(i.w) - EPOCH(k.w)) <= 21 * 86400 AS near FROM i JOIN k ON i.o_custkey = k.o_custkey),
g AS (SELECT rec, ARG_MIN(key, (w, key)) FILTER (WHERE day) AS d, ARG_MIN(key, (w, key)) FILTER (WHERE near) AS s FROM p GROUP BY rec)
SELECT o_orderkey AS record_id, COALESCE(CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey - 1 AS VARCHAR) END, d, s, 'new-' || SUBSTR(SHA256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS match_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'mapped' WHEN d IS NOT NULL THEN 'same day' WHEN s IS NOT NULL THEN 'same score' ELSE 'created' END AS state FROM i LEFT JOIN g ON rec = o_orderkey""")
def match_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("score"))
    known = o.filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "match_id")
    incoming = o.filter("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "record_id")
    mapping = incoming.filter("record_id % 11 = 0").select("record_id", (F.col("record_id") - 1).alias("match_id"))
    return V.matches_get_or_create(incoming, known, mapping, ["o_custkey"], "at", ["score"]).select("record_id", "match_id", "state")


@register("import_resolution", """
WITH p AS (
  SELECT p_partkey AS k, LOWER(p_name) AS name, p_type AS born, p_brand AS team, p_size % 4 AS pos, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 7 END AS nat, DATE '2020-01-01' + p_size AS a,
    CASE WHEN p_size % 3 <> 0 THEN DATE '2020-01-31' + p_size END AS z, p_retailprice FROM part
), s AS (
  SELECT q.k, c.k AS candidate, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE,
    CASE WHEN q.name = c.name THEN 0.82::DOUBLE ELSE 0.70::DOUBLE * (1 - LEVENSHTEIN(q.name, c.name)::DOUBLE / GREATEST(LENGTH(q.name), LENGTH(c.name))) END
    + CASE WHEN q.born = c.born THEN 0.14::DOUBLE ELSE -0.30::DOUBLE END + CASE WHEN q.nat IS NULL OR c.nat IS NULL THEN 0.0::DOUBLE WHEN q.nat = c.nat THEN 0.03::DOUBLE ELSE -0.02::DOUBLE END
    + CASE WHEN q.team <> c.team THEN -0.05::DOUBLE WHEN c.a <= DATE '2020-01-20' AND (c.z IS NULL OR c.z >= DATE '2020-01-20') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN q.pos = c.pos THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS score, q.name = c.name AS same, q.team = c.team AND c.a <= DATE '2020-01-20' AND (c.z IS NULL OR c.z >= DATE '2020-01-20') AS teamed
  FROM p q JOIN p c ON q.k % 20 = 0 AND c.p_retailprice < 1500 AND q.k <> c.k
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY score DESC, candidate) AS n FROM s QUALIFY n <= 5),
l AS (SELECT k, MAX(score) AS top, MAX(score) FILTER (WHERE n = 2) AS next, MAX(candidate) FILTER (WHERE n = 1) AS best, BOOL_OR(same) FILTER (WHERE n = 1) AS same, BOOL_OR(teamed) FILTER (WHERE n = 1) AS teamed,
  STRING_AGG(candidate || ':' || CAST(CAST(ROUND(score * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS listed FROM r GROUP BY k),
d AS (SELECT *, CASE WHEN top < 0.70 THEN 'unresolved' WHEN top < 0.87 OR top - next <= 0.04::DOUBLE THEN 'ambiguous' ELSE 'resolved' END AS status FROM l)
SELECT p.k AS p_partkey, CASE WHEN p.k % 100 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN p.k % 100 = 0 THEN 3 WHEN status = 'resolved' THEN best END AS selected, CASE WHEN p.k % 100 = 0 THEN 1.0 ELSE top END AS confidence,
  CASE WHEN p.k % 100 = 0 THEN 'existing_mapping' WHEN status = 'resolved' THEN CASE WHEN teamed THEN 'temporal_context' WHEN same THEN 'exact' ELSE 'fuzzy' END END AS method,
  CASE WHEN p.k % 100 = 0 THEN '3:1000000' ELSE listed END AS candidates
FROM p JOIN d ON d.k = p.k WHERE p.k % 20 = 0""")
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Imported names against all active players: names, birth, nationality, club at the time and position; the five best of each."""
    part = table(spark, sf, "part").select(
        "p_partkey", "p_retailprice", S.normalize_name(F.col("p_name")).alias("name"), F.col("p_type").alias("born"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 7).cast("string")).alias("nationality"), F.col("p_brand").alias("team"),
        (F.col("p_size") % 4).alias("position"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("valid_from"), F.when(F.col("p_size") % 3 != 0, F.date_add(F.lit("2020-01-31").cast("date"), F.col("p_size"))).alias("valid_to"),
    )
    queries = part.filter("p_partkey % 20 = 0").withColumn("day", F.lit("2020-01-20").cast("date"))
    active = part.filter("p_retailprice < 1500").withColumnRenamed("p_partkey", "candidate")
    mapping = queries.filter("p_partkey % 100 = 0").select("p_partkey", F.lit(3).cast("bigint").alias("candidate"))
    found = Q.resolve_identities(queries, active, "p_partkey", "candidate", mapping)
    listed = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["candidate"].cast("string"), F.round(x["confidence"] * 1_000_000).cast("bigint").cast("string"))), ",")
    return found.withColumn("candidates", listed)


@register("self_pair_matches", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS source, o_orderstatus, o_orderdate, o_custkey % 25 AS k FROM orders),
g AS (SELECT o_custkey, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM o GROUP BY ALL HAVING COUNT(*) = 2)
SELECT a.o_orderkey AS first, b.o_orderkey AS second, CAST(a.o_orderdate AS DATE) AS day FROM g JOIN o a ON a.o_custkey = g.o_custkey AND YEAR(a.o_orderdate) = y JOIN o b ON b.o_custkey = g.o_custkey AND YEAR(b.o_orderdate) = y
WHERE (a.o_orderdate, a.o_orderkey) < (b.o_orderdate, b.o_orderkey) AND a.source <> b.source AND a.o_orderstatus = b.o_orderstatus AND EPOCH(b.o_orderdate) - EPOCH(a.o_orderdate) <= 21 * 86400""")
def self_pair_matches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumns({"source": F.col("o_orderkey") % 2, "y": F.year("o_orderdate")})
    return V.self_pairs(o, ["o_custkey", "y"], "o_orderkey", "source", ["o_orderstatus"], "o_orderdate")


@register("first_mapping_owner", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_mapping_owner(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return V.first_owner(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"], order).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@register("planned_import_roles", """
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_tax, CASE WHEN l_quantity > 40 THEN 'ZZ' WHEN l_linenumber % 3 = 0 THEN 'GK' WHEN l_linenumber % 3 = 1 THEN 'DEF' END AS role FROM lineitem),
d AS (SELECT l_partkey, role, MIN((l_orderkey, l_linenumber)) AS o FROM r WHERE role IS NOT NULL GROUP BY ALL),
l AS (SELECT l_partkey, STRING_AGG(role, '/' ORDER BY o) AS roles, BOOL_OR(role = 'ZZ') AS refused FROM d GROUP BY 1)
SELECT p.l_partkey, COALESCE(roles, '') AS roles, COALESCE(refused, FALSE) AS refused, n > 1 AS price_conflict FROM (SELECT l_partkey, COUNT(DISTINCT l_tax) AS n FROM r GROUP BY 1) p LEFT JOIN l USING (l_partkey)""")
def planned_import_roles(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("l_quantity") > 40, "ZZ").when(F.col("l_linenumber") % 3 == 0, "GK").when(F.col("l_linenumber") % 3 == 1, "DEF")
    return V.planned_roles(table(spark, sf, "lineitem"), "l_partkey", role, "l_tax", ["GK", "DEF"], [F.col("l_orderkey"), F.col("l_linenumber")])


@register("nested_secret_keys", "SELECT event_id FROM events WHERE event_id % 4 IN (1, 2)")
def nested_secret_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A secret's key at the top, inside an array's object, none, and its word only as a value."""
    k = F.col("event_id") % 4
    text = F.when(k == 1, '{"api_key": 1}').when(k == 2, '{"a": [{"b": {"DB-Password" : "x"}}]}').when(k == 3, '{"kind": "password"}').otherwise(F.col("props"))
    return Q.secret_keys(table(spark, sf, "events").select("event_id", text.alias("meta")), "meta").select("event_id")


_SLOTS = {"A": 2, "B": 2, "C": 3}


@register("roster_legality", """
WITH r AS (SELECT c_custkey // 8 AS team, CASE c_custkey * 7919 % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 4 WHEN 8 THEN 1 ELSE -1 END AS mask FROM customer),
s AS (SELECT * FROM (VALUES (1, 2), (2, 2), (4, 3), (3, 4), (5, 5), (6, 5), (7, 7)) v(set, room)),
c AS (SELECT team, set, room, COUNT(*) FILTER (WHERE mask >= 0 AND (mask | set) = set) AS n FROM r, s GROUP BY ALL)
SELECT team, BOOL_AND(n <= room) AS legal FROM c GROUP BY team""")
def roster_legality(spark: SparkSession, sf: str) -> DataFrame:
    """Rosters of eight; D has no limit."""
    kinds = [["A"], ["B"], ["C"], ["A", "B"], ["A", "C"], ["B", "C"], ["A", "B", "C"], ["C"], ["A"], ["D"], ["A", "D"]]
    roles = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("c_custkey") * 7919 % 11 + 1).cast("int"))
    return Q.legal_rosters(table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 8).alias("team"), roles.alias("roles")), _SLOTS)


@register("no_fixture_findings", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49 UNION SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def no_fixture_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_quantity >= 49")
    return V.without_fixture(table(spark, sf, "supplier").select("s_suppkey"), rows, "s_suppkey", "l_suppkey", "l_partkey")


# ------------------------------------------------------- what was known when


@register("unavailable_players", """
WITH i AS (SELECT l_partkey AS player_id, l_suppkey % 3 AS source, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS s, CAST(l_shipdate + INTERVAL 20 DAY AS DATE) AS e, l_shipdate AS w, l_orderkey * 10 + l_linenumber AS id, l_returnflag <> 'N' AS x, l_linenumber % 2 AS kind FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-06-20'),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind, source, player_id, s ORDER BY w DESC, id DESC) AS n FROM i),
u AS (SELECT player_id, MAX(w) AS w FROM r WHERE n = 1 AND s <= DATE '1997-06-25' AND e >= DATE '1997-06-25' AND x GROUP BY 1)
SELECT player_id FROM u WHERE NOT (player_id % 4 = 0 AND w <= TIMESTAMP '1997-06-15')""")
def unavailable_players(spark: SparkSession, sf: str) -> DataFrame:
    """Injuries (even lines) and suspensions (odd lines); every fourth player has a sheet of June 15th."""
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_partkey").alias("player_id"), (F.col("l_suppkey") % 3).alias("source"), F.date_trunc("month", "l_shipdate").cast("date").alias("started_on"), F.date_add(F.to_date("l_shipdate"), 20).alias("ended_on"),
        F.col("l_shipdate").alias("available_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") != "N").alias("excluded"), (F.col("l_linenumber") % 2).alias("kind"),
    )
    sheet = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("player_id"), ntz("1997-06-15").alias("confirmed_at"))
    return V.unavailable([rows.filter("kind = 0"), rows.filter("kind = 1")], ntz("1997-06-20"), F.lit("1997-06-25").cast("date"), sheet)


@register("known_referee", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate <= o_orderdate + INTERVAL 30 DAY THEN l_suppkey END AS referee FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def known_referee(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", V.known_referee(F.col("l_suppkey"), F.col("l_shipdate"), F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("referee"))


@register("reschedules", """
WITH c AS (SELECT o_orderkey AS match_id, o_orderdate AS kickoff_at, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'date' END AS precision, o_orderdate - INTERVAL 30 DAY AS available_at, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'scheduled' END AS status FROM orders),
i AS (SELECT l_orderkey AS match_id, CASE WHEN l_linenumber = 1 THEN (SELECT o_orderdate FROM orders WHERE o_orderkey = l_orderkey) ELSE l_shipdate END AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'minute' ELSE 'date' END AS p, l_shipdate - INTERVAL 20 DAY AS a FROM lineitem),
j AS (SELECT i.*, c.*, p = 'minute' AND k > TIMESTAMP '1996-06-01' AND a >= c.available_at AND status <> 'finished' AS moves, c.precision = 'unknown' AND c.kickoff_at = k AS settles FROM i JOIN c USING (match_id)),
g AS (SELECT match_id, MAX((a, k, p)) FILTER (WHERE moves) AS m, MAX((a, p)) FILTER (WHERE NOT moves AND settles) AS s, MAX(a) AS latest FROM j GROUP BY 1)
SELECT c.match_id, status, COALESCE(m[2], kickoff_at) AS kickoff_at, COALESCE(m[3], s[2], precision) AS precision, GREATEST(available_at, latest) AS available_at FROM c LEFT JOIN g USING (match_id)""")
def reschedules(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    day = lambda c, n: F.col(c) - F.make_dt_interval(F.lit(n))
    current = o.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("kickoff_at"), F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise("date").alias("precision"), day("o_orderdate", 30).alias("available_at"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("scheduled").alias("status"))
    li = table(spark, sf, "lineitem").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    incoming = li.select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_linenumber") == 1, F.col("o_orderdate")).otherwise(F.col("l_shipdate")).alias("kickoff_at"), F.when(F.col("l_linenumber") % 2 == 0, "minute").otherwise("date").alias("precision"), day("l_shipdate", 20).alias("available_at"))
    return V.rescheduled(current, incoming, "match_id", ntz("1996-06-01"))


@register("observed_outcomes", """
WITH s AS (SELECT o_custkey AS m, o_orderkey % 2 AS t, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS starters, BOOL_AND(o_totalprice > 1000) AS covered, SUM(o_orderkey % 3) AS goals, SUM(CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS own FROM orders GROUP BY ALL)
SELECT c.c_custkey AS match_id, v.t AS team_id, COALESCE(a.starters = 11 AND a.covered AND COALESCE(a.goals, 0) + COALESCE(b.own, 0) = v.score, FALSE) AS consistent
FROM customer c, LATERAL (SELECT UNNEST([0, 1]) AS t, c_custkey % 9 + 4 AS score) v LEFT JOIN s a ON a.m = c.c_custkey AND a.t = v.t LEFT JOIN s b ON b.m = c.c_custkey AND b.t = 1 - v.t""")
def observed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as the rows of two sides; whether starters, coverage and goals agree with a score."""
    k = F.col("o_orderkey")
    stats = table(spark, sf, "orders").select(F.col("o_custkey").alias("match_id"), (k % 2).alias("team_id"), (F.col("o_orderstatus") != "P").alias("started"), (F.col("o_totalprice") > 1000).alias("covered"), (k % 3).alias("goals"), (k % 17 == 0).cast("int").alias("own_goals"))
    c = table(spark, sf, "customer")
    scores = c.select(F.col("c_custkey").alias("match_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("team_id"), (F.col("c_custkey") % 9 + 4).alias("score")).withColumn("opponent_id", 1 - F.col("team_id"))
    return V.consistent_sheets(stats, scores)


@register("compatible_run", """
WITH r AS (SELECT c_custkey AS run_id, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT * FROM r ORDER BY c_acctbal DESC, run_id DESC LIMIT 1)
SELECT run_id FROM n WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)""")
def compatible_run(spark: SparkSession, sf: str) -> DataFrame:
    """Runs made of customers (cutoff by balance), models of nations; every run uses its nation's model."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    runs = c.select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("succeeded").alias("status"), F.col("c_acctbal").alias("prediction_cutoff"), (F.col("c_acctbal") - 1).alias("data_cutoff"), F.lit("v2").alias("feature_schema"))
    references = c.select(F.col("c_custkey").alias("run_id"), F.lit("goals").alias("target"), F.col("c_nationkey").alias("model_id"), F.col("c_nationkey").cast("string").alias("version"))
    models = n.select(F.col("n_nationkey").alias("model_id"), F.lit("goals").alias("target"), F.col("n_nationkey").cast("string").alias("version"), F.lit("v2").alias("feature_schema"), F.lit(-1e9).alias("trained_at"), F.lit(-1e9).alias("training_cutoff"))
    return V.compatible_run(runs, references, models, "v2").select("run_id")


# ---------------------------------------------------------------- decisions


@register("roster_player_team", "SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1")
def roster_player_team(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_linenumber = 1")
    return rows.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "p_name", "s_name")


@register("first_candidate_per_player", """
SELECT l_partkey AS player_id, l_orderkey AS match_id, value FROM (SELECT l_partkey, l_orderkey, l_quantity AS value, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= TIMESTAMP '1996-01-01') WHERE n = 1""")
def first_candidate_per_player(spark: SparkSession, sf: str) -> DataFrame:
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    joined = li.join(o.filter(F.col("o_orderdate") >= ntz("1996-01-01")), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    first = R.top_per_group(joined, ["l_partkey"], [F.col(c) for c in ("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity")], 1)
    return first.select(F.col("l_partkey").alias("player_id"), F.col("l_orderkey").alias("match_id"), F.col("l_quantity").alias("value"))


@register("signature_groups", """
WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '1' ELSE '0' END || CASE WHEN c_mktsegment = 'BUILDING' THEN '1' ELSE '0' END || CASE WHEN c_nationkey < 10 THEN '1' ELSE '0' END AS signature FROM customer)
SELECT signature, COUNT(*) AS members, MIN(c_custkey) AS first, CAST(ROW_NUMBER() OVER (ORDER BY signature) AS INTEGER) AS "group" FROM s GROUP BY signature""")
def signature_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumns({"f0": F.col("c_acctbal") < 0, "f1": F.col("c_mktsegment") == "BUILDING", "f2": F.col("c_nationkey") < 10})
    return V.signature_groups(c, "c_custkey", ["f0", "f1", "f2"])


@register("alternate_draft", "SELECT p_partkey, CAST(n AS INTEGER) AS rank, CASE WHEN n % 2 = 1 THEN 'first' ELSE 'second' END AS side FROM (SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)")
def alternate_draft(spark: SparkSession, sf: str) -> DataFrame:
    return V.alternate_draft(table(spark, sf, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], ["p_brand", "p_size"]).select("p_partkey", "rank", "side")


@register("replay_order", """
SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY DATE_TRUNC('hour', ts), CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_id) AS INTEGER) AS place FROM events""")
def replay_order(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return V.replay_order(events, "event_type", ["view", "click", "purchase"], "hour", [F.col("event_id")]).select("event_id", "place")


@register("market_horizons", """
WITH s AS (SELECT l_partkey AS player, SUM(CASE WHEN l_linenumber <= 1 THEN l_quantity ELSE 0 END) AS h1, SUM(CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END) AS h3, SUM(CASE WHEN l_linenumber <= 5 THEN l_quantity ELSE 0 END) AS h5, SUM(CASE WHEN l_linenumber <= 10 THEN l_quantity ELSE 0 END) AS h10 FROM lineitem GROUP BY 1),
w AS (SELECT p_partkey AS give, p_partkey + 1 AS take, p_retailprice AS price FROM part WHERE p_partkey % 2 = 0)
SELECT give, take, price, COALESCE(t.h1, 0) - COALESCE(g.h1, 0) AS gain_1, COALESCE(t.h3, 0) - COALESCE(g.h3, 0) AS gain_3, COALESCE(t.h5, 0) - COALESCE(g.h5, 0) AS gain_5, COALESCE(t.h10, 0) - COALESCE(g.h10, 0) AS gain_10,
  CASE WHEN price > 0 THEN (COALESCE(t.h10, 0) - COALESCE(g.h10, 0)) / price END AS efficiency FROM w LEFT JOIN s t ON t.player = take LEFT JOIN s g ON g.player = give""")
def market_horizons(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("player"), F.col("l_linenumber").alias("period"), F.col("l_quantity").alias("points"))
    swaps = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("give"), (F.col("p_partkey") + 1).alias("take"), F.col("p_retailprice").alias("price"))
    return V.swaps_by_horizon(swaps, points)


@register("long_predictions", """
SELECT l_orderkey, l_linenumber, v.target, v.value, GREATEST(0.0::DOUBLE, v.low) AS low, LEAST(v.bound, v.high) AS high, v.reliability FROM lineitem, LATERAL (
  SELECT 'discount' AS target, l_discount AS value, l_discount - 0.03::DOUBLE AS low, l_discount + 0.03::DOUBLE AS high, 1.0::DOUBLE AS bound, 1 / (1 + 0.02::DOUBLE) AS reliability
  UNION ALL SELECT 'quantity', l_quantity, l_quantity - 5.5::DOUBLE, l_quantity + 5.5::DOUBLE, 50.0::DOUBLE, 1 / (1 + 3.0::DOUBLE)) v""")
def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    targets = {"discount": (F.col("l_discount"), 0.03, 0.02, 1.0), "quantity": (F.col("l_quantity"), 5.5, 3.0, 50.0)}
    return V.long_predictions(li, "key", targets).select("key.*", "target", "value", "low", "high", "reliability")


@register("forecast_inputs", """
WITH p AS (SELECT l_orderkey AS m, l_partkey AS p, MAX(l_discount) AS s, MAX(l_tax) * 5 AS a, MAX(l_quantity) AS g FROM lineitem GROUP BY ALL),
h AS (SELECT m, p, BOOL_OR(st) AS st FROM (SELECT l_orderkey AS m, l_partkey AS p, l_linenumber = 1 AS st FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 3) GROUP BY ALL)
SELECT p.m AS match_id, p.p AS player_id, CASE WHEN c.m IS NOT NULL THEN COALESCE(CAST(h.st AS INT)::DOUBLE, 0.0::DOUBLE) ELSE s END AS start,
  CASE WHEN c.m IS NOT NULL AND h.st IS NULL THEN 0.0::DOUBLE WHEN c.m IS NOT NULL AND h.st THEN 1.0::DOUBLE ELSE GREATEST(a, s) END AS appearance, g AS expected_goals, CASE WHEN p.p % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS penalty_weight
FROM p LEFT JOIN (SELECT DISTINCT m FROM h) c ON c.m = p.m LEFT JOIN h ON h.m = p.m AND h.p = p.p""")
def forecast_inputs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "match_id", "l_partkey": "player_id"})
    one = li.groupBy("match_id", "player_id").agg(F.max("l_discount").alias("start_probability"), (F.max("l_tax") * 5).alias("appearance_probability"), F.max("l_quantity").alias("expected_goals"))
    names = ("start_probability", "appearance_probability", "expected_goals")
    predictions = one.unpivot(["match_id", "player_id"], list(names), "target", "value")
    sheets = li.filter("match_id % 2 = 0 AND l_linenumber <= 3").groupBy("match_id", "player_id").agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_starting"))
    priors = table(spark, sf, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("player_id"), F.lit(0.25).alias("penalties_rate"))
    return V.forecast_inputs(predictions, sheets, priors, names)
