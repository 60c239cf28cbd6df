"""Filters, joins, aggregates, windows, sets and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranks
from ..operators import relational as R
from ..operators import temporal as T
from ..sources.tables import table
from .catalog import register


@register("filter_composition", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def filter_composition(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    conditions = [F.col("o_totalprice").between(100000, 300000), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), ~F.col("o_orderstatus").isin("P"), None, F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")]
    return R.where_all(orders, conditions).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@register("case_insensitive_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR (p_name ILIKE 'red%' AND ENDS_WITH(p_name, ' widget'))")
def case_insensitive_search(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").filter(name.ilike("%RING%") | (name.ilike("red%") & name.endswith(" widget"))).select("p_partkey", "p_name")


@register("join_chain_revenue", "SELECT r_name, n_name, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def join_chain_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("not_in_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def not_in_anti(spark: SparkSession, sf: str) -> DataFrame:
    large = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return R.not_in(table(spark, sf, "customer"), large, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@register("semi_by_coverage", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.5)")
def semi_by_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.semi_by_coverage(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", 0.5).select("o_orderkey", "o_custkey")


@register("semi_top_orders", "SELECT l_orderkey, COUNT(*) AS n_lines, CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) GROUP BY l_orderkey")
def semi_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(F.broadcast(top), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


@register("one_row_cross_join_share", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(COUNT(*) / (SELECT COUNT(*) FROM events)::DOUBLE, 6) AS share, (SELECT COUNT(DISTINCT user_id) FROM events) AS all_users FROM events GROUP BY event_type")
def one_row_cross_join_share(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    grouped = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    joined = R.with_summary(grouped, events.agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("all_users")))
    return joined.select("event_type", "n", "users", F.round(F.col("n") / F.col("total"), 6).alias("share"), "all_users")


@register("outer_fanout_distinct_filter", "SELECT n_name, COUNT(DISTINCT c_custkey) AS customers, COUNT(DISTINCT s_suppkey) AS suppliers, COUNT(DISTINCT c_custkey) FILTER (WHERE c_acctbal < 0) AS in_debt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def outer_fanout_distinct_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The two fan-outs are counted apart and then joined: their product per nation is never made."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct(F.when(F.col("c_acctbal") < 0, F.col("c_custkey"))).alias("in_debt"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", zero("customers"), zero("suppliers"), zero("in_debt"))


@register("asof_last_view_before_purchase", """
SELECT p.event_id, p.user_id, v.ts AS view_ts, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view_before_purchase(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return T.asof_join(bought, views, ["user_id"], "ts", "view_ts", ["view_id", "view_value"]).drop("ts")


@register("complete_pair_sum", "SELECT l_orderkey, l_linenumber, CASE WHEN COUNT(*) = 2 AND COUNT(l_quantity) = 2 THEN SUM(l_quantity) END AS pair_quantity, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber")
def complete_pair_sum(spark: SparkSession, sf: str) -> DataFrame:
    both = (F.count("*") == 2) & (F.count("l_quantity") == 2)
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.when(both, F.sum("l_quantity")).alias("pair_quantity"), F.count("*").alias("n"))


@register("carry_forward_non_null", """
SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase, LAST_VALUE(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_view
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward_non_null(spark: SparkSession, sf: str) -> DataFrame:
    sparse = table(spark, sf, "events").withColumns({"last_purchase": F.when(F.col("event_type") == "purchase", F.col("value")), "last_view": F.when(F.col("event_type") == "view", F.col("value"))})
    return T.carry_forward(sparse, ["user_id"], [F.col("ts"), F.col("event_id")], ["last_purchase", "last_view"]).select("event_id", "last_purchase", "last_view")


@register("merge_fact_versions", """
WITH u AS (SELECT user_id, DATE_TRUNC('day', ts) AS known, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS clicks, CASE WHEN event_type = 'error' THEN value END AS errors FROM events),
m AS (SELECT user_id, known, ARG_MAX(clicks, (ts, event_id)) FILTER (WHERE clicks IS NOT NULL) AS clicks, ARG_MAX(errors, (ts, event_id)) FILTER (WHERE errors IS NOT NULL) AS errors FROM u GROUP BY user_id, known)
SELECT user_id, known, LAST_VALUE(clicks IGNORE NULLS) OVER w AS clicks, LAST_VALUE(errors IGNORE NULLS) OVER w AS errors FROM m WINDOW w AS (PARTITION BY user_id ORDER BY known ROWS UNBOUNDED PRECEDING)""")
def merge_fact_versions(spark: SparkSession, sf: str) -> DataFrame:
    updates = table(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("known"), "ts", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("clicks"), F.when(F.col("event_type") == "error", F.col("value")).alias("errors"))
    return T.merge_versions(updates, ["user_id"], "known", [F.col("ts"), F.col("event_id")], ["clicks", "errors"])


@register("latest_version_by_priority", """
SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def latest_version_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.coalesce(S.lookup(F.col("event_type"), {"purchase": "0", "click": "1", "view": "2"}).cast("int"), F.lit(3))
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return T.latest(events, ["user_id", "day"], [priority, F.desc("ts"), F.col("event_id")]).select("user_id", "day", "event_id", "event_type")


@register("latest_version_by_revision", """
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_version_by_revision(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_orderkey")]
    return T.latest(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], order).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@register("first_value_group_order", "SELECT o_orderkey, FIRST_VALUE(o_orderdate) OVER w AS first_date, FIRST_VALUE(o_orderkey) OVER w AS first_order, FIRST_VALUE(o_orderpriority) OVER w AS first_priority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def first_value_group_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.first_value("o_orderdate").over(w).alias("first_date"), F.first_value("o_orderkey").over(w).alias("first_order"), F.first_value("o_orderpriority").over(w).alias("first_priority"))


@register("any_over_partition", "SELECT DISTINCT l_orderkey, BOOL_OR(l_returnflag = 'R' OR l_discount > 0.09) OVER (PARTITION BY l_orderkey) AS any_trouble FROM lineitem")
def any_over_partition(spark: SparkSession, sf: str) -> DataFrame:
    trouble = (F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.09)
    return table(spark, sf, "lineitem").select("l_orderkey", F.bool_or(trouble).over(Window.partitionBy("l_orderkey")).alias("any_trouble")).distinct()


@register("change_point_islands", """
WITH a AS (SELECT *, LAG(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, SUM(CASE WHEN before IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
g AS (SELECT user_id, CAST(island AS BIGINT) AS island, MIN(event_type) AS event_type, MIN(ts) AS valid_from, COUNT(*) AS observations FROM b GROUP BY user_id, island)
SELECT *, LEAD(valid_from) OVER (PARTITION BY user_id ORDER BY island) AS valid_to FROM g""")
def change_point_islands(spark: SparkSession, sf: str) -> DataFrame:
    return T.spans(table(spark, sf, "events"), ["user_id"], "ts", [F.col("ts"), F.col("event_id")], "event_type").withColumn("island", F.col("island").cast("bigint"))


@register("interval_membership", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
d AS (SELECT TIMESTAMP '1996-06-30' AS as_of UNION ALL SELECT TIMESTAMP '1998-06-30' UNION ALL SELECT TIMESTAMP '2000-06-30')
SELECT as_of, COUNT(*) AS active, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum FROM s JOIN d ON valid_from <= as_of AND (valid_to IS NULL OR as_of < valid_to) GROUP BY as_of""")
def interval_membership(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spans = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))
    dates = spark.createDataFrame([("1996-06-30",), ("1998-06-30",), ("2000-06-30",)], "as_of string").select(F.col("as_of").cast("timestamp_ntz").alias("as_of"))
    joined = spans.join(F.broadcast(dates), T.within(F.col("as_of"), F.col("valid_from"), F.col("valid_to")))  # three dates
    return joined.groupBy("as_of").agg(F.count("*").alias("active"), F.sum("o_orderkey").alias("key_sum"))


@register("overlay_precedence", """
WITH e AS (
  SELECT 0 AS precedence, o_custkey AS who, o_orderdate AS seen, o_orderpriority AS value, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 1, o_custkey, o_orderdate, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 2, c_custkey, NULL, c_mktsegment, c_custkey FROM customer)
SELECT who, precedence, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY who ORDER BY precedence, seen DESC NULLS LAST, k) AS n FROM e) WHERE n = 1""")
def overlay_precedence(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("who"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("k"))
    evidence = [orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), customers]
    return T.overlay(evidence, ["who"], [F.desc_nulls_last("at"), F.col("k")]).select("who", "precedence", "value")


@register("fieldwise_coalesce_by_source", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p, ts, event_id, CASE WHEN value > 20 THEN value END AS a, CASE WHEN event_type <> 'purchase' THEN event_type END AS b FROM events)
SELECT user_id, day, ARG_MIN(a, (p, ts, event_id)) FILTER (WHERE a IS NOT NULL) AS a, ARG_MIN(b, (p, ts, event_id)) FILTER (WHERE b IS NOT NULL) AS b, COUNT(DISTINCT a) > 1 AS a_conflict, COUNT(DISTINCT b) > 1 AS b_conflict FROM s GROUP BY user_id, day""")
def fieldwise_coalesce_by_source(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = e.select("user_id", F.to_date("ts").alias("day"), p.alias("p"), "ts", "event_id", F.when(F.col("value") > 20, F.col("value")).alias("a"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("b"))
    return T.coalesce_by_source(rows, ["user_id", "day"], [F.col("p"), F.col("ts"), F.col("event_id")], ["a", "b"])


@register("tolerance_pair_match", """
SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b
ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey AND ABS(DATE_DIFF('day', a.o_orderdate, b.o_orderdate)) <= 21""")
def tolerance_pair_match(spark: SparkSession, sf: str) -> DataFrame:
    """Time buckets of the tolerance's width: a pair is in equal or neighbouring buckets, so a key's pairs are not all compared."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    bucket = F.floor(F.unix_date("d") / 22)
    a = o.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("left_key"), F.col("d").alias("da"), bucket.alias("b"))
    b = o.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("right_key"), F.col("d").alias("db"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    return a.join(b, ["o_custkey", "o_orderpriority", "b"]).filter((F.col("left_key") < F.col("right_key")) & (F.abs(F.datediff("da", "db")) <= 21)).select("left_key", "right_key")


@register("theta_budget_swap", """
SELECT c_custkey, p_partkey, p_retailprice FROM (
  SELECT c.c_custkey, p.p_partkey, p.p_retailprice, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY p_retailprice DESC, p_partkey) AS n
  FROM customer c JOIN part p ON p_size = c_custkey % 50 + 1 AND p_retailprice <= c_acctbal) WHERE n <= 3""")
def theta_budget_swap(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's three dearest parts of a size within the balance, met by their numbers along the prices, not by all pairs of a size."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 50 + 1).cast("int").alias("p_size"))
    parts = table(spark, sf, "part").select("p_size", "p_partkey", "p_retailprice")
    return ranks.last_below(c, parts, ["p_size"], "c_acctbal", "p_retailprice", "c_custkey", "p_partkey", 3).select("c_custkey", "p_partkey", "p_retailprice")


@register("home_away_unpivot", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey AS home, c_nationkey AS away, l_quantity AS home_v, l_discount AS away_v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT nation, side, COUNT(*) AS n, ROUND(SUM(v), 4) AS total FROM (SELECT home AS nation, 'home' AS side, home_v AS v FROM g UNION ALL SELECT away, 'away', away_v FROM g) GROUP BY nation, side""")
def home_away_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    g = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = g.select(F.col("s_nationkey").alias("home"), F.col("c_nationkey").alias("away"), F.col("l_quantity").alias("home_v"), F.col("l_discount").alias("away_v"))
    rows = R.both_sides(g, {"home": {"nation": "home", "v": "home_v"}, "away": {"nation": "away", "v": "away_v"}})
    return rows.groupBy("nation", "side").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("pivot_long_predictions", "SELECT l_suppkey, ROUND(SUM(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS \"A\", ROUND(SUM(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS \"N\", ROUND(SUM(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS \"R\" FROM lineitem GROUP BY l_suppkey")
def pivot_long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))


@register("unpivot_metrics", "SELECT l_returnflag, metric, ROUND(SUM(v), 2) AS total FROM (SELECT l_returnflag, UNNEST(['quantity', 'discount', 'tax']) AS metric, UNNEST([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY l_returnflag, metric")
def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot("l_returnflag", ["quantity", "discount", "tax"], "metric", "v")
    return long.groupBy("l_returnflag", "metric").agg(F.round(F.sum("v"), 2).alias("total"))


@register("shrinkage_prior", """
WITH p AS (SELECT p_brand, p_partkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey),
b AS (SELECT p_brand, SUM(r)::DOUBLE / SUM(n)::DOUBLE AS rate FROM p GROUP BY p_brand)
SELECT p_partkey, ROUND((r + 20 * rate) / (n + 20), 6) AS shrunk_rate FROM p JOIN b USING (p_brand)""")
def shrinkage_prior(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    part = joined.groupBy("p_brand", "p_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    brand = part.groupBy("p_brand").agg((F.sum("r").cast("double") / F.sum("n")).alias("rate"))
    return part.join(brand, "p_brand").select("p_partkey", F.round((F.col("r") + 20 * F.col("rate")) / (F.col("n") + 20), 6).alias("shrunk_rate"))


@register("quantile_summary", "SELECT l_returnflag, ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 4) AS median, ROUND(QUANTILE_CONT(l_extendedprice, 0.1), 4) AS p10, ROUND(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS p90, ROUND(AVG(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS probability FROM lineitem GROUP BY l_returnflag")
def quantile_summary(spark: SparkSession, sf: str) -> DataFrame:
    x, lines = F.col("l_extendedprice"), table(spark, sf, "lineitem")
    means = lines.groupBy("l_returnflag").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("probability"))
    places = ranks.percentiles(lines, ["l_returnflag"], x, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return means.join(places, "l_returnflag").select("l_returnflag", "mean", *[F.round(c, 4).alias(c) for c in ("median", "p10", "p90")], "probability")


@register("argmax_category", "SELECT o_custkey, ARG_MAX(o_orderpriority, (t, o_orderpriority)) AS favourite, ROUND(MAX(t), 2) AS spent FROM (SELECT o_custkey, o_orderpriority, SUM(o_totalprice) AS t FROM orders GROUP BY ALL) GROUP BY o_custkey")
def argmax_category(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("t"))
    return t.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("t", "o_orderpriority")).alias("favourite"), F.round(F.max("t"), 2).alias("spent"))


@register("collect_roles_ordered", "SELECT user_id, STRING_AGG(event_type, ',' ORDER BY n DESC, event_type) AS roles FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def collect_roles_ordered(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg((-F.count("*")).alias("n"))
    return n.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda x: x["event_type"]), ",").alias("roles"))


@register("duplicate_groups", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


@register("page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return R.page(done, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 25)


@register("latest_one", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_one(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderdate")


@register("topk_per_group", "SELECT p_brand, p_partkey, CAST(n AS INTEGER) AS rank FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 5")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "rank")


@register("seeded_draft", "SELECT s_suppkey, CAST(ROW_NUMBER() OVER (ORDER BY draw, s_suppkey) AS INTEGER) AS pick, draw FROM (SELECT s_suppkey, CAST('0x' || SUBSTR(MD5('draft:' || s_suppkey), 1, 13) AS BIGINT) AS draw FROM supplier ORDER BY draw, s_suppkey LIMIT 40)")
def seeded_draft(spark: SparkSession, sf: str) -> DataFrame:
    top = R.shuffled(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "draft").orderBy("draw", "s_suppkey").limit(40)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("draw", "s_suppkey")))  # 40 rows


@register("set_ops_lineage", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'union' AS op, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS s FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', COUNT(*), CAST(SUM(k) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', COUNT(*), CAST(SUM(k) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'symmetric', COUNT(*), CAST(SUM(k) AS BIGINT) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))""")
def set_ops_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """All four from one pass: a key's two memberships decide each set."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderstatus") == "P").alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = F.array(*[F.when(c, F.lit(n)) for n, c in (("union", a | b), ("intersect", a & b), ("except", a & ~b), ("symmetric", a != b))])
    return o.select("k", F.explode(F.array_compact(ops)).alias("op")).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("s"))


@register("array_set_functions", """
WITH r AS (SELECT user_id, LIST(DISTINCT event_type) FILTER (WHERE value > 40) AS a, LIST(DISTINCT event_type) FILTER (WHERE value < 5) AS b FROM events GROUP BY user_id),
s AS (SELECT user_id, COALESCE(a, []) AS a, COALESCE(b, []) AS b FROM r)
SELECT user_id, LIST_HAS_ANY(a, b) AS overlap, CAST(LEN(LIST_FILTER(a, lambda x: NOT LIST_CONTAINS(b, x))) AS INTEGER) AS only_a, LIST_HAS_ALL(a, b) AS covers, CAST(LEN(LIST_DISTINCT(LIST_CONCAT(a, b))) AS INTEGER) AS both FROM s""")
def array_set_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("b"))
    return e.select("user_id", F.arrays_overlap("a", "b").alias("overlap"), F.size(F.array_except("a", "b")).alias("only_a"), (F.size(F.array_except("b", "a")) == 0).alias("covers"), F.size(F.array_union("a", "b")).alias("both"))


@register("json_metric_extract", "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, COUNT(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS high, COUNT(json_extract(props, '$.missing')) AS missing FROM events GROUP BY event_type")
def json_metric_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count_if(k >= 50).alias("high"), F.count(F.get_json_object("props", "$.missing")).alias("missing"))


@register("map_prefix_split", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS home_rate, l_tax AS away_rate, CAST(2 AS INTEGER) AS n_home FROM lineitem")
def map_prefix_split(spark: SparkSession, sf: str) -> DataFrame:
    stats = F.create_map(F.lit("home_rate"), "l_discount", F.lit("home_units"), "l_quantity", F.lit("away_rate"), "l_tax")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.side_stats(stats, "home_").alias("h"), S.side_stats(stats, "away_").alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("h")["rate"].alias("home_rate"), F.col("a")["rate"].alias("away_rate"), F.size("h").alias("n_home"))


@register("observed_number_states", """
WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS s, value FROM events)
SELECT event_id, CASE s WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN NULL ELSE value END AS observed FROM r""")
def observed_number_states(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind, value = F.col("event_type"), F.col("value").cast("string")
    stats = F.when(kind == "view", F.create_map(F.lit("other"), value)).when(kind == "click", F.create_map(F.lit("total"), F.lit("n/a"))).when(kind == "signup", F.create_map(F.lit("sum"), value)).otherwise(F.create_map(F.lit("total"), value))
    return e.select("event_id", S.observed(kind != "error", stats, ["total", "sum"]).alias("observed"))


@register("date_parse_fallback", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse_fallback(spark: SparkSession, sf: str) -> DataFrame:
    formats = ["dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd", "yyyyMMdd"]
    written = F.date_format("o_orderdate", "dd/MM/yyyy")
    for i, f in enumerate(("yyyy-MM-dd", "yyyyMMdd"), 1):
        written = F.when(F.col("o_orderkey") % 3 == i, F.date_format("o_orderdate", f)).otherwise(written)
    return table(spark, sf, "orders").select("o_orderkey", S.first_date(written, formats).alias("parsed"))


@register("season_and_week", "SELECT o_orderkey, LPAD(CAST((y % 100) AS VARCHAR), 2, '0') || LPAD(CAST(((y + 1) % 100) AS VARCHAR), 2, '0') AS season, CAST(d - CAST((ISODOW(d) - 2 + 7) % 7 AS INTEGER) AS DATE) AS week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, YEAR(o_orderdate) - CASE WHEN MONTH(o_orderdate) >= 7 THEN 0 ELSE 1 END AS y FROM orders)")
def season_and_week(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", S.season_code(day).alias("season"), S.week_start(day).alias("week"))


@register("normalize_texts", "SELECT doc_id, TRIM(REGEXP_REPLACE(REPLACE(LOWER(STRIP_ACCENTS(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents")
def normalize_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document in normal form."""
    return table(spark, sf, "documents").select("doc_id", S.normalize_name(F.col("text")).alias("name"))


@register("rest_days", "SELECT event_id, DATE_DIFF('day', LAG(ts) OVER w, ts) AS rest_days FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rest_days(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.datediff("ts", F.lag("ts").over(w)).cast("bigint").alias("rest_days"))


@register("probability_transforms", "SELECT l_orderkey, l_linenumber, l_partkey, ROUND(1 - POW(1 - l_discount, 90 / l_quantity), 6) AS per_90, ROUND(LN(GREATEST(1e-7, LEAST(1 - 1e-7, l_discount)) / (1 - GREATEST(1e-7, LEAST(1 - 1e-7, l_discount)))), 6) AS logit, ROUND((l_tax - l_discount) / 2.5631, 6) AS sd FROM lineitem")
def probability_transforms(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.probability_per_90(p, F.col("l_quantity")), 6).alias("per_90"), F.round(S.logit(p), 6).alias("logit"), F.round(S.spread_to_sd(p, F.col("l_tax")), 6).alias("sd"))


@register("digests_and_seeds", "SELECT c_custkey, SHA256(c_name) AS digest, CAST('0x' || SUBSTR(SHA256(c_custkey || '|' || c_mktsegment), 1, 13) AS BIGINT) AS seed FROM customer")
def digests_and_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"), S.derived_seed(F.col("c_custkey"), F.col("c_mktsegment")).alias("seed"))


@register("cube_and_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_and_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("full_outer_nations", "SELECT COALESCE(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k")
def full_outer_nations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@register("guarded_upsert", """
WITH cur AS (SELECT o_orderkey AS k, o_orderdate AS available_at, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
inc AS (SELECT o_orderkey AS k, o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL (-5) DAY END AS available_at, -o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT COALESCE(inc.k, cur.k) AS k, CASE WHEN cur.k IS NULL OR inc.available_at >= cur.available_at THEN inc.available_at ELSE cur.available_at END AS available_at, CASE WHEN cur.k IS NULL OR inc.available_at >= cur.available_at THEN inc.v ELSE cur.v END AS v FROM cur FULL JOIN inc ON cur.k = inc.k""")
def guarded_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("available_at"), F.col("o_totalprice").alias("v"))
    moved = F.expr("available_at + CASE WHEN k % 2 = 0 THEN INTERVAL '5' DAY ELSE INTERVAL '-5' DAY END")
    incoming = o.filter("k % 5 <> 0").select("k", moved.alias("available_at"), (-F.col("v")).alias("v"))
    return R.upsert(o.filter("k % 3 <> 0"), incoming, ["k"], "available_at")


@register("insert_if_absent", "SELECT o_custkey AS k, 'old' AS origin FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("k"), F.lit("old").alias("origin")).distinct()
    return R.insert_if_absent(old, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("new").alias("origin")), ["k"])
