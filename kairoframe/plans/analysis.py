"""Identity, quality, metrics and scoring over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import scoring as O
from ..operators import similarity
from ..sources.tables import table
from .catalog import register


@register("identity_top_candidate", """
WITH q AS (SELECT p_partkey, LOWER(p_name) AS name, p_brand, p_type FROM part WHERE p_partkey % 20 = 0),
c AS (SELECT p_partkey AS candidate, LOWER(p_name) AS other, p_brand, p_type AS other_type FROM part),
s AS (
  SELECT p_partkey, candidate, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE,
    CASE WHEN name = other THEN 0.82::DOUBLE ELSE 0.70::DOUBLE * (1 - LEVENSHTEIN(name, other)::DOUBLE / GREATEST(LENGTH(name), LENGTH(other))) END
    + CASE WHEN p_type = other_type THEN 0.14::DOUBLE ELSE -0.30::DOUBLE END)), 6) AS score
  FROM q JOIN c ON p_partkey <> candidate
), r AS (SELECT *, ROW_NUMBER() OVER w AS n, LEAD(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, candidate))
SELECT q.p_partkey, candidate, score, CASE WHEN score IS NULL OR score < 0.70 THEN 'unresolved' WHEN score < 0.87 OR score - COALESCE(runner_up, 0) <= 0.04::DOUBLE THEN 'ambiguous' ELSE 'resolved' END AS decision FROM q LEFT JOIN r ON q.p_partkey = r.p_partkey AND n = 1""")
def identity_top_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Each query against every other part, by the edit-distance join; a query without candidates is unresolved."""
    part = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_type")
    q, c = part.filter("p_partkey % 20 = 0"), part.withColumnRenamed("p_partkey", "candidate")
    same_type = Q.evidence(F.lit(True), F.col("p_type") == F.col("_p_type"), 0.14, 0.30)
    score = lambda name, other, alike: Q.identity_score(name, other, same_type, alike)
    scored = similarity.nearest(q, c, "p_partkey", "candidate", "name", ["p_type"], score, lambda below: 0.70 * below + 0.14)
    best = Q.decide(scored, "p_partkey", "candidate").select("p_partkey", "candidate", "score", "decision")
    return q.select("p_partkey").join(best, "p_partkey", "left").withColumn("decision", F.coalesce("decision", F.lit("unresolved")))


@register("name_corroboration", """
WITH n AS (SELECT p_partkey, LOWER(p_name) AS full_name, SUBSTR(p_name, 1, 1) || ' ' || SPLIT_PART(p_name, ' ', 2) AS short FROM part)
SELECT a.p_brand, COUNT(*) AS pairs, COUNT(*) FILTER (WHERE x.full_name = LOWER(y.short) OR (SPLIT_PART(x.full_name, ' ', 2) = SPLIT_PART(LOWER(y.short), ' ', 2) AND SUBSTR(x.full_name, 1, 1) = SUBSTR(LOWER(y.short), 1, 1))) AS corroborated
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey JOIN n x ON x.p_partkey = a.p_partkey JOIN n y ON y.p_partkey = b.p_partkey GROUP BY a.p_brand""")
def name_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", S.normalize_name(F.col("p_name")).alias("full_name"))
    tokens = F.split("full_name", " ")
    other = part.select(F.col("p_partkey").alias("other"), "p_brand", "p_size", F.concat(F.substring("full_name", 1, 1), F.lit(" "), F.element_at(tokens, 2)).alias("short"))
    return Q.corroborated_pairs(part, other, ["p_brand", "p_size"], "p_partkey", "other", "full_name", "short").groupBy("p_brand").agg(F.sum("pairs").alias("pairs"), F.sum("corroborated").alias("corroborated")).filter("pairs > 0")


@register("reconcile_redirects", """
WITH m AS (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY SHA256(text)) AS new FROM documents)
SELECT l.doc_id AS label_id, COALESCE(CASE WHEN m.doc_id <> m.new THEN m.new END, l.doc_id) AS doc_id, quality FROM labels l LEFT JOIN m ON m.doc_id = l.doc_id""")
def reconcile_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Labels moved to the first of the documents with equal text."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    mapping = Q.redirects(docs, "doc_id", [F.col("digest")])
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), "doc_id", "quality")
    return Q.redirect(labels, "doc_id", mapping)


_RULES = """
SELECT 'discount_range' AS rule, 'error' AS severity, l_orderkey || '-' || l_linenumber AS record FROM lineitem WHERE l_discount > 0.095
UNION ALL SELECT 'shipped_open', 'warning', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'large_quantity', 'warning', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_quantity >= 50"""


@register("quality_findings", _RULES)
def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    rules = {
        "discount_range": ("error", F.col("l_discount") > 0.095),
        "shipped_open": ("warning", (F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))),
        "large_quantity": ("warning", F.col("l_quantity") >= 50),
    }
    return Q.findings(table(spark, sf, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber"), rules)


@register("result_precedence", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderpriority, o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def result_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return Q.accepted_result(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", F.col("o_orderstatus") == "F", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("source_freshness", """
WITH s AS (SELECT source, COUNT(*) AS n, MAX(n_chars) AS longest FROM documents GROUP BY source),
e AS (SELECT event_type AS source, MAX(ts) AS last FROM events GROUP BY 1)
SELECT source, last, CASE WHEN DATE_DIFF('day', last, TIMESTAMP '2024-02-05') > 6 THEN 'stale' ELSE 'available' END AS state FROM e UNION ALL SELECT source, NULL, 'unavailable' FROM s""")
def source_freshness(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"))
    never = table(spark, sf, "documents").select("source").distinct().withColumn("last", F.lit(None).cast("timestamp_ntz"))
    return last.unionByName(never).withColumn("state", Q.freshness(F.col("last"), F.lit("2024-02-05").cast("timestamp_ntz"), 6, F.lit(True)))


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a score of the document's length, as a probability."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    p = F.round(F.lit(0.2) + F.lit(0.7) * F.col("n_chars") / (F.col("n_chars") + 2000), 9)
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality", "toxic", F.col("n_chars"), p.alias("p"))


_SCORED = "s AS (SELECT l.doc_id, lang, quality, toxic, n_chars, ROUND(0.2::DOUBLE + 0.7::DOUBLE * n_chars / (n_chars + 2000), 9) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_LOSS = "-(quality * LN(GREATEST(1e-7, LEAST(1 - 1e-7, p))) + (1 - quality) * LN(1 - GREATEST(1e-7, LEAST(1 - 1e-7, p))))"


@register("calibration_error", f"WITH {_SCORED}, b AS (SELECT LEAST(FLOOR(p * 10), 9) AS bin, COUNT(*) AS n, AVG(p) AS mp, AVG(quality) AS my FROM s GROUP BY 1) SELECT ROUND(SUM(n * ABS(mp - my)) / SUM(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return M.calibration_error(scored_labels(spark, sf), "quality", "p").select(F.round("ece", 6).alias("ece"))


@register("log_loss_brier", f"WITH {_SCORED} SELECT ROUND(AVG({_LOSS}), 6) AS log_loss, ROUND(AVG((p - quality) * (p - quality)), 6) AS brier, COUNT(*) AS n FROM s")
def log_loss_brier(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("quality").cast("double"), F.col("p")
    return scored_labels(spark, sf).agg(F.round(M.log_loss(y, p), 6).alias("log_loss"), F.round(M.brier(y, p), 6).alias("brier"), F.count("*").alias("n"))


@register("average_precision", f"WITH {_SCORED}, g AS (SELECT p, COUNT(*) AS n, SUM(toxic) AS pos FROM s GROUP BY p), r AS (SELECT pos, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT ROUND(SUM(pos * (tp::DOUBLE / k::DOUBLE)) / SUM(pos), 6) AS average_precision FROM r")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return M.average_precision(scored_labels(spark, sf), "toxic", "p").select(F.round("average_precision", 6).alias("average_precision"))


@register("subgroup_gate", f"WITH {_SCORED} SELECT lang, COUNT(*) AS n, ROUND(AVG({_LOSS}), 6) AS log_loss, ROUND(AVG((p - quality) * (p - quality)), 6) AS brier FROM s GROUP BY lang HAVING COUNT(*) >= 20")
def subgroup_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.subgroup(scored_labels(spark, sf), "lang", "quality", "p").select("lang", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@register("regression_metrics", "SELECT l_returnflag, ROUND(AVG(ABS(l_quantity * 1500 - l_extendedprice)), 4) AS mae, ROUND(SQRT(AVG(POW(l_quantity * 1500 - l_extendedprice, 2))), 4) AS rmse, ROUND(AVG(GREATEST(0.9::DOUBLE * (l_extendedprice - l_quantity * 1500), -0.1::DOUBLE * (l_extendedprice - l_quantity * 1500))), 4) AS pinball_90 FROM lineitem GROUP BY l_returnflag")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(M.mae(y, p), 4).alias("mae"), F.round(M.rmse(y, p), 4).alias("rmse"), F.round(M.pinball(y, p, 0.9), 4).alias("pinball_90"))


@register("poisson_metrics", "WITH c AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS y FROM orders GROUP BY ALL) SELECT o_orderpriority, ROUND(AVG(2 * (y * LN(y / 2.0::DOUBLE) - (y - 2.0::DOUBLE))), 6) AS deviance, ROUND(AVG(2.0::DOUBLE - y * LN(2.0::DOUBLE) + LN(FACTORIAL(CAST(y AS INTEGER))::DOUBLE)), 6) AS nll FROM c GROUP BY o_orderpriority")
def poisson_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("y"))
    mu = F.lit(2.0)
    return c.groupBy("o_orderpriority").agg(F.round(M.poisson_deviance(F.col("y"), mu), 6).alias("deviance"), F.round(M.poisson_nll(F.col("y"), mu), 6).alias("nll"))


@register("baseline_priors", f"WITH {_SCORED}, m AS (SELECT AVG(n_chars) AS prior FROM s) SELECT lang, ROUND((SUM(quality) + 1)::DOUBLE / (COUNT(*) + 2), 6) AS quality_prior, ROUND((SUM(n_chars) + MAX(prior) * 30) / (COUNT(*) + 30), 4) AS shrunk_chars FROM s, m GROUP BY lang")
def baseline_priors(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_labels(spark, sf)
    with_prior = s.crossJoin(F.broadcast(s.agg(F.avg("n_chars").alias("prior"))))  # one row
    return with_prior.groupBy("lang").agg(F.round(M.laplace_prior(F.col("quality")), 6).alias("quality_prior"), F.round(M.shrunk_mean(F.col("n_chars"), F.max("prior"), 30), 4).alias("shrunk_chars"))


@register("rolling_origin_fold_sizes", """
WITH y AS (SELECT YEAR(o_orderdate) AS season, COUNT(*) AS n FROM orders GROUP BY 1), i AS (SELECT *, DENSE_RANK() OVER (ORDER BY season) AS i FROM y)
SELECT CAST(f.season AS INTEGER) AS fold, CASE WHEN p.i = f.i THEN 'test' WHEN p.i = f.i - 1 THEN 'calibrate' ELSE 'fit' END AS role, CAST(SUM(p.n) AS BIGINT) AS n FROM i f JOIN i p ON p.i <= f.i WHERE f.i > 2 GROUP BY ALL""")
def rolling_origin_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), "o_orderkey")
    return M.rolling_origin(orders, "season").groupBy("fold", "role").agg(F.count("*").alias("n"))


@register("conformal_radius", """
WITH e AS (SELECT o_orderpriority, ABS(o_totalprice - 250000) AS e, COUNT(*) OVER (PARTITION BY o_orderpriority) AS n, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY ABS(o_totalprice - 250000)) - 1 AS i FROM orders)
SELECT o_orderpriority, ROUND(e, 4) AS radius, n FROM e WHERE i = CEIL(ROUND(LEAST(1.0::DOUBLE, CEIL((n + 1) * 0.8::DOUBLE) / n) * (n - 1), 9))""")
def conformal_radius(spark: SparkSession, sf: str) -> DataFrame:
    out = M.conformal_radius(table(spark, sf, "orders"), F.col("o_totalprice") - 250000, 0.8, ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("radius", 4).alias("radius"), "n")


@register("bootstrap_ci", """
WITH m AS (SELECT DATE_TRUNC('week', CAST(o_orderdate AS DATE) - 1) AS week, AVG(o_totalprice) AS m FROM orders GROUP BY 1),
c AS (SELECT m, ROW_NUMBER() OVER (ORDER BY week) - 1 AS i, COUNT(*) OVER () AS n FROM m),
d AS (SELECT id // n AS b, CAST(FLOOR(CAST('0x' || SUBSTR(MD5('bootstrap:' || (id // n) || ':' || (id % n)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * n) AS BIGINT) AS i FROM (SELECT MAX(n) AS n FROM c), (SELECT UNNEST(RANGE(2000 * (SELECT COUNT(*) FROM c))) AS id)),
s AS (SELECT b, AVG(c.m) AS m FROM d JOIN c ON c.i = d.i GROUP BY b)
SELECT (SELECT ROUND(AVG(m), 2) FROM c) AS mean, (SELECT COUNT(*) FROM c) AS clusters, ROUND(QUANTILE_CONT(m, 0.025), 2) AS low, ROUND(QUANTILE_CONT(m, 0.975), 2) AS high FROM s""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("week", S.week_start(F.to_date("o_orderdate")))
    return M.bootstrap_mean(orders, "week", "o_totalprice").select(F.round("mean", 2).alias("mean"), "clusters", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@register("evenly_spaced_orders", """
WITH n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM n WHERE i IN (SELECT CAST(ROUND_EVEN(k * (n - 1) / 99.0::DOUBLE, 0) AS BIGINT) FROM RANGE(100) t(k))""")
def evenly_spaced_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred orders at equal steps of the price."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.evenly_spaced(orders, [F.col("o_totalprice"), F.col("o_orderkey")], 100)


@register("prediction_coherence", "SELECT l_orderkey, l_linenumber, l_partkey, LEAST(l_discount, l_tax + 0.02) AS starts, LEAST(l_tax + 0.02, l_quantity / 50) AS appears FROM lineitem")
def prediction_coherence(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("starts"), (F.col("l_tax") + 0.02).alias("appears"), (F.col("l_quantity") / 50).alias("plays"))
    return M.coherent(wide, {"starts": ["appears"], "appears": ["plays"]}).drop("plays")


@register("event_scoring", """
SELECT user_id, CAST(ts AS DATE) AS day, ROUND(6.0::DOUBLE + SUM(CASE event_type WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE WHEN 'error' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS points, COUNT(*) AS n
FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING SUM(value) >= 10""")
def event_scoring(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).pivot("event_type", ["purchase", "click", "view", "error"]).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    total = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("minutes"))
    rows = total.join(e, ["user_id", "day"])
    points = O.points(F.lit(6.0), {"purchase_n": 3.0, "click_n": 1.0, "view_n": 0.5, "error_n": -2.0}, F.col("minutes"), 10.0)
    return rows.filter("minutes >= 10").select("user_id", "day", F.round(points, 4).alias("points"), "n")


@register("modifier_bands", "SELECT l_suppkey, ROUND(AVG(l_quantity), 6) AS rating, CASE WHEN AVG(l_quantity) >= 28 THEN 6.0::DOUBLE WHEN AVG(l_quantity) >= 26 THEN 3.0::DOUBLE WHEN AVG(l_quantity) >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS modifier FROM lineitem GROUP BY l_suppkey")
def modifier_bands(spark: SparkSession, sf: str) -> DataFrame:
    rated = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("rating"))
    return rated.select("l_suppkey", F.round("rating", 6).alias("rating"), O.bands(F.col("rating"), {25.0: 1.0, 26.0: 3.0, 28.0: 6.0}).alias("modifier"))


@register("risk_objective", "SELECT l_suppkey, ROUND(AVG(l_quantity), 6) AS balanced, ROUND(0.6::DOUBLE * AVG(l_quantity) + 0.4::DOUBLE * QUANTILE_CONT(l_quantity, 0.1), 6) AS floor, ROUND(0.6::DOUBLE * AVG(l_quantity) + 0.4::DOUBLE * QUANTILE_CONT(l_quantity, 0.9), 6) AS upside FROM lineitem GROUP BY l_suppkey")
def risk_objective(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(q).alias("mean"), F.percentile(q, 0.1).alias("p10"), F.percentile(q, 0.9).alias("p90"))
    return s.select("l_suppkey", *[F.round(O.risk(F.col("mean"), F.col("p10"), F.col("p90"), k), 6).alias(k) for k in ("balanced", "floor", "upside")])


@register("replacement_level", "WITH p AS (SELECT p_partkey, p_type, p_retailprice, MIN(p_retailprice) OVER (PARTITION BY p_type) AS level FROM part) SELECT p_partkey, ROUND(level, 2) AS replacement, ROUND(p_retailprice - level, 2) AS over_replacement FROM p")
def replacement_level(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    level = part.groupBy("p_type").agg(F.min("p_retailprice").alias("level"))
    return part.join(level, "p_type").select("p_partkey", F.round("level", 2).alias("replacement"), F.round(F.col("p_retailprice") - F.col("level"), 2).alias("over_replacement"))


@register("week_selection", """
WITH w AS (SELECT CAST(CAST(o_orderdate AS DATE) - CAST((ISODOW(o_orderdate) - 2 + 7) % 7 AS INTEGER) AS DATE) AS week, * FROM orders)
SELECT week, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM w GROUP BY week HAVING COUNT(*) >= 40 AND COUNT(DISTINCT o_custkey) = COUNT(*)""")
def week_selection(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("week", S.week_start(F.to_date("o_orderdate")))
    return orders.groupBy("week").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers")).filter("n >= 40 AND customers = n")


@register("reasons_topk_with_caveat", """
WITH r AS (SELECT user_id, event_type, event_id, ABS(value) * CAST(json_extract(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS weight, CAST(json_extract(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS confidence FROM events),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY weight DESC, event_id) AS n FROM r)
SELECT user_id, CAST(n AS INTEGER) AS rank, CASE WHEN n = 3 AND BOOL_OR(confidence < 0.5) OVER (PARTITION BY user_id) THEN 'caveat' ELSE event_type END AS reason FROM t WHERE n <= 3""")
def reasons_topk_with_caveat(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.abs("value") * k / 100.0).alias("weight"), (k / 100.0).alias("confidence"))
    return O.top_reasons(e, "user_id", "weight", "confidence", "event_type", "event_id", 3)


@register("win_draw_loss", "SELECT o_custkey, ROUND(AVG(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS win, ROUND(AVG(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS draw, ROUND(AVG(CASE WHEN a < b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS loss FROM (SELECT o_custkey, FLOOR(o_totalprice / 100000) AS a, o_orderkey % 5 AS b FROM orders) GROUP BY o_custkey")
def win_draw_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 100000).alias("a"), (F.col("o_orderkey") % 5).alias("b"))
    return rows.groupBy("o_custkey").agg(*[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in (("win", F.col("a") > F.col("b")), ("draw", F.col("a") == F.col("b")), ("loss", F.col("a") < F.col("b")))])


@register("snapshot_digest")
def snapshot_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of a table's content that does not depend on files or order."""
    return Q.content_digest(table(spark, sf, "orders"))


@register("status_counts", "SELECT COUNT(*) AS orders, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, MAX(o_orderdate) AS latest, COUNT(DISTINCT o_custkey) AS customers FROM orders")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max("o_orderdate").alias("latest"), F.count_distinct("o_custkey").alias("customers"))


@register("ordered_horizon", "SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') WHERE n <= 3")
def ordered_horizon(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("position", F.row_number().over(w)).filter("position <= 3").select("o_custkey", "o_orderkey", "position")
