"""Point-in-time queries: features of an order from what was known before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import temporal as T
from ..sources.tables import staged, table
from .catalog import register


def _r(column, digits: int = 3):
    return F.round(column, digits)


def order_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a decision: customer, nation, the nation it faces, its priority desk, and its date as cutoff."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("customer"),
        F.col("c_nationkey").alias("nation"),
        F.pmod(F.col("c_nationkey") + 7, F.lit(25)).alias("opponent"),
        F.col("o_orderpriority").alias("desk"),
        F.col("o_orderdate").alias("cutoff"),
        F.col("o_totalprice").alias("price"),
    )


CANDIDATES = """candidates AS (
  SELECT o_orderkey AS row_id, o_custkey AS customer, c_nationkey AS nation, (c_nationkey + 7) % 25 AS opponent,
         o_orderpriority AS desk, o_orderdate AS cutoff, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _history(kind: str, on: str, key: str, limit: int) -> str:
    return f"""{kind} AS (
  SELECT c.row_id, h.price, h.cutoff AS event_time, c.cutoff AS at,
         ROW_NUMBER() OVER (PARTITION BY c.row_id ORDER BY h.cutoff DESC, h.row_id DESC) AS r
  FROM candidates c JOIN candidates h ON h.{key} = c.{on} AND h.cutoff < c.cutoff
  QUALIFY r <= {limit})"""


def _recent(contexts: DataFrame, events: DataFrame, key: str, of: str, limit: int, measures: dict[str, tuple]) -> DataFrame:
    """Measures of the last orders of a key before each context's cutoff."""
    fields = sorted({how[1] for how in measures.values()})
    return folds.recent_as_of(contexts, events, (key, of), "cutoff", "cutoff", None, [], fields, limit, tiebreak="row_id", measures=measures)


def customer_features(candidates: DataFrame) -> DataFrame:
    measures = {
        "price_last_1": ("sum", "price", 1),
        "price_last_5": ("sum", "price", 5),
        "price_ewma_10": ("ewma", "price", 10),
        "price_trend_5": ("trend", "price", 5),
        "price_volatility_10": ("stddev", "price", 10),
    }
    found = _recent(candidates.select("row_id", "customer", "cutoff"), candidates, "customer", "customer", 10, measures)
    return found.select("row_id", F.col("held").alias("history_count"), *[_r(F.col(m)).alias(m) for m in measures], F.col("last").alias("customer_max_available_at"))


CUSTOMER_SQL = """customer_features AS (
  SELECT c.row_id, COUNT(h.r) AS history_count,
    ROUND(SUM(h.price) FILTER (WHERE r <= 1), 3) AS price_last_1, ROUND(SUM(h.price) FILTER (WHERE r <= 5), 3) AS price_last_5,
    ROUND(SUM(h.price * EXP(-0.35::DOUBLE * (r - 1))) / SUM(EXP(-0.35::DOUBLE * (r - 1))), 3) AS price_ewma_10,
    ROUND(CASE WHEN COUNT(h.r) >= 2 THEN -REGR_SLOPE(h.price, r) FILTER (WHERE r <= 5) END, 3) AS price_trend_5,
    ROUND(STDDEV_SAMP(h.price), 3) AS price_volatility_10, MAX(h.event_time) AS customer_max_available_at
  FROM candidates c LEFT JOIN ch h USING (row_id) GROUP BY c.row_id)"""


@register("pit_customer_order_history", f"WITH {CANDIDATES}, {_history('ch', 'customer', 'customer', 10)}, {CUSTOMER_SQL} SELECT * FROM customer_features")
def pit_customer_order_history(spark: SparkSession, sf: str) -> DataFrame:
    return customer_features(order_candidates(spark, sf))


def nation_features(candidates: DataFrame) -> DataFrame:
    """Context features once for each (nation, cutoff): many orders share them."""
    contexts = candidates.select("nation", "cutoff").distinct()
    # A context asks twice: at its cutoff, and 14 days before, for how many orders there were by then.
    asks = contexts.select("nation", F.col("cutoff").alias("at"), F.explode(F.array(F.lit(0), F.lit(14))).alias("ago"))
    asks = asks.select("nation", "at", "ago", (F.col("at") - F.make_dt_interval(F.col("ago"))).alias("cutoff"))
    measures = {"nation_price_last_5": ("sum", "price", 5), "nation_price_ewma_10": ("ewma", "price", 10)}
    told = _recent(asks, candidates, "nation", "nation", 10, measures)
    now = F.col("ago") == 0
    found = told.groupBy("nation", F.col("at").alias("cutoff")).agg(*[F.max(F.when(now, F.col(c))).alias(c) for c in ("held", "last", *measures)], F.sum(F.when(now, F.col("events")).otherwise(-F.col("events"))).alias("congestion_14d"))
    return found.select(
        "nation",
        "cutoff",
        F.col("held").alias("nation_history_count"),
        *[_r(F.col(m)).alias(m) for m in measures],
        F.datediff(F.col("cutoff"), F.col("last")).cast("bigint").alias("rest_days"),
        "congestion_14d",
        F.col("last").alias("nation_max_available_at"),
    )


NATION_SQL = """nation_features AS (
  SELECT c.nation, c.cutoff, COUNT(r) AS nation_history_count,
    ROUND(SUM(price) FILTER (WHERE r <= 5), 3) AS nation_price_last_5,
    ROUND(SUM(price * EXP(-0.35::DOUBLE * (r - 1))) / SUM(EXP(-0.35::DOUBLE * (r - 1))), 3) AS nation_price_ewma_10,
    DATE_DIFF('day', MAX(event_time), c.cutoff) AS rest_days,
    (SELECT COUNT(*) FROM candidates k WHERE k.nation = c.nation AND k.cutoff < c.cutoff AND k.cutoff >= c.cutoff - INTERVAL 14 DAY) AS congestion_14d,
    MAX(event_time) AS nation_max_available_at
  FROM nation_contexts c LEFT JOIN nh ON nh.nation = c.nation AND nh.at = c.cutoff GROUP BY c.nation, c.cutoff),"""


def _context_history(kind: str, contexts: str, on: str, key: str, limit: int) -> str:
    return f"""{kind} AS (
  SELECT c.{on}, c.cutoff AS at, h.price, h.cutoff AS event_time,
         ROW_NUMBER() OVER (PARTITION BY c.{on}, c.cutoff ORDER BY h.cutoff DESC, h.row_id DESC) AS r
  FROM {contexts} c JOIN candidates h ON h.{key} = c.{on} AND h.cutoff < c.cutoff
  QUALIFY r <= {limit})"""


_NATION = f"nation_contexts AS (SELECT DISTINCT nation, cutoff FROM candidates), {_context_history('nh', 'nation_contexts', 'nation', 'nation', 10)}, {NATION_SQL[:-1]}"


@register("pit_context_nation", f"WITH {CANDIDATES}, {_NATION} SELECT * FROM nation_features")
def pit_context_nation(spark: SparkSession, sf: str) -> DataFrame:
    return nation_features(order_candidates(spark, sf))


def opponent_features(candidates: DataFrame) -> DataFrame:
    contexts = candidates.select("opponent", "cutoff").distinct()
    measures = {"opponent_price_last_5": ("sum", "price", 5), "opponent_price_ewma_10": ("ewma", "price", 10)}
    found = _recent(contexts, candidates, "opponent", "nation", 10, measures)
    return found.select("opponent", "cutoff", F.col("held").alias("opponent_history_count"), *[_r(F.col(m)).alias(m) for m in measures], F.col("last").alias("opponent_max_available_at"))


_OPPONENT = f"""opponent_contexts AS (SELECT DISTINCT opponent, cutoff FROM candidates), {_context_history('oh', 'opponent_contexts', 'opponent', 'nation', 10)},
opponent_features AS (
  SELECT c.opponent, c.cutoff, COUNT(r) AS opponent_history_count, ROUND(SUM(price) FILTER (WHERE r <= 5), 3) AS opponent_price_last_5,
    ROUND(SUM(price * EXP(-0.35::DOUBLE * (r - 1))) / SUM(EXP(-0.35::DOUBLE * (r - 1))), 3) AS opponent_price_ewma_10, MAX(event_time) AS opponent_max_available_at
  FROM opponent_contexts c LEFT JOIN oh ON oh.opponent = c.opponent AND oh.at = c.cutoff GROUP BY c.opponent, c.cutoff)"""


@register("pit_opponent_nation", f"WITH {CANDIDATES}, {_OPPONENT} SELECT * FROM opponent_features")
def pit_opponent_nation(spark: SparkSession, sf: str) -> DataFrame:
    return opponent_features(order_candidates(spark, sf))


#: Prior mean and strength of the smoothed rates, and how many events they look at.
DESK_PRIOR, DESK_STRENGTH, DESK_EVENTS = 0.25, 10.0, 20


def desk_features(candidates: DataFrame) -> DataFrame:
    """Share of large orders at the desk, smoothed towards a prior; a null desk matches nothing."""
    contexts = candidates.select("desk", "cutoff").distinct()
    large = candidates.withColumn("large", (F.col("price") > 400_000).cast("double"))
    found = _recent(contexts, large, "desk", "desk", DESK_EVENTS, {"large": ("sum", "large", DESK_EVENTS)})
    return found.select(
        "desk",
        "cutoff",
        F.col("held").alias("desk_history_count"),
        _r(T.smoothed(F.col("large"), F.col("held").cast("double"), DESK_PRIOR, DESK_STRENGTH)).alias("desk_large_rate_20"),
        F.col("last").alias("desk_max_available_at"),
    )


_DESK = f"""desk_contexts AS (SELECT DISTINCT desk, cutoff FROM candidates), {_context_history('dh', 'desk_contexts', 'desk', 'desk', 20)},
desk_features AS (
  SELECT c.desk, c.cutoff, COUNT(r) AS desk_history_count,
    ROUND((SUM(CASE WHEN price > 400000 THEN 1.0::DOUBLE WHEN price IS NOT NULL THEN 0.0::DOUBLE END) + 10.0::DOUBLE * 0.25::DOUBLE) / (COUNT(r) + 10.0::DOUBLE), 3) AS desk_large_rate_20,
    MAX(event_time) AS desk_max_available_at
  FROM desk_contexts c LEFT JOIN dh ON dh.desk = c.desk AND dh.at = c.cutoff GROUP BY c.desk, c.cutoff)"""


@register("pit_smoothed_desk_rate", f"WITH {CANDIDATES}, {_DESK} SELECT * FROM desk_features")
def pit_smoothed_desk_rate(spark: SparkSession, sf: str) -> DataFrame:
    return desk_features(order_candidates(spark, sf))


LINEAGE = ("customer_max_available_at", "nation_max_available_at", "opponent_max_available_at", "desk_max_available_at")
COUNTS = ("history_count", "nation_history_count", "opponent_history_count", "desk_history_count", "price_last_5", "nation_price_last_5", "opponent_price_last_5", "congestion_14d")


def full_snapshot(candidates: DataFrame) -> DataFrame:
    """All features of every candidate; counts and sums are zero where there is no history, rates stay null."""
    candidates = staged(candidates, "candidates")  # five feature families read them
    desks = desk_features(candidates).withColumnsRenamed({"desk": "_desk", "cutoff": "_at"})
    joined = (
        candidates.join(customer_features(candidates), "row_id", "left")
        .join(nation_features(candidates), ["nation", "cutoff"], "left")
        .join(opponent_features(candidates), ["opponent", "cutoff"], "left")
        .join(desks, F.col("desk").eqNullSafe(F.col("_desk")) & (F.col("cutoff") == F.col("_at")), "left")
        .drop("_desk", "_at")
    )
    return joined.fillna(0, subset=list(COUNTS))


_FULL = f"""WITH {CANDIDATES}, {_history('ch', 'customer', 'customer', 10)}, {CUSTOMER_SQL}, {_NATION}, {_OPPONENT}, {_DESK},
snapshot AS (
  SELECT c.*, COALESCE(f.history_count, 0) AS history_count, price_last_1, COALESCE(price_last_5, 0) AS price_last_5, price_ewma_10, price_trend_5, price_volatility_10, customer_max_available_at,
    COALESCE(nation_history_count, 0) AS nation_history_count, COALESCE(nation_price_last_5, 0) AS nation_price_last_5, nation_price_ewma_10, rest_days, COALESCE(congestion_14d, 0) AS congestion_14d, nation_max_available_at,
    COALESCE(opponent_history_count, 0) AS opponent_history_count, COALESCE(opponent_price_last_5, 0) AS opponent_price_last_5, opponent_price_ewma_10, opponent_max_available_at,
    COALESCE(desk_history_count, 0) AS desk_history_count, desk_large_rate_20, desk_max_available_at
  FROM candidates c LEFT JOIN customer_features f USING (row_id)
  LEFT JOIN nation_features n ON n.nation = c.nation AND n.cutoff = c.cutoff
  LEFT JOIN opponent_features o ON o.opponent = c.opponent AND o.cutoff = c.cutoff
  LEFT JOIN desk_features d ON d.desk IS NOT DISTINCT FROM c.desk AND d.cutoff = c.cutoff)"""


@register("pit_full_snapshot", f"{_FULL} SELECT * FROM snapshot")
def pit_full_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return full_snapshot(order_candidates(spark, sf))


@register(
    "leakage_audit_counts",
    f"{_FULL} " + " UNION ALL ".join(f"SELECT '{c}' AS lineage, COUNT({c}) AS rows_checked, COUNT(*) FILTER (WHERE {c} > cutoff) AS violations FROM snapshot" for c in LINEAGE),
)
def leakage_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.audit(full_snapshot(order_candidates(spark, sf)), "cutoff", LINEAGE)


@register(
    "pit_bitemporal_shipments",
    """
WITH h AS (SELECT o_custkey, o_orderdate AS event_time, l_shipdate AS available_at, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (
  SELECT c.o_orderkey AS row_id, h.*, ROW_NUMBER() OVER (PARTITION BY c.o_orderkey, h.event_time ORDER BY h.available_at DESC, h.o_orderkey DESC, h.l_linenumber DESC, h.l_partkey DESC, h.l_suppkey DESC, h.l_extendedprice DESC) AS version
  FROM orders c JOIN h ON h.o_custkey = c.o_custkey AND h.event_time < c.o_orderdate AND h.available_at <= c.o_orderdate
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY event_time DESC) AS r FROM v WHERE version = 1)
SELECT row_id, COUNT(*) AS events, ROUND(SUM(l_extendedprice) FILTER (WHERE r <= 5), 4) AS value_last_5,
  ROUND(90 * SUM(l_extendedprice) FILTER (WHERE r <= 10) / NULLIF(SUM(l_quantity) FILTER (WHERE r <= 10), 0), 6) AS value_per_90_units_10,
  ROUND(SUM(l_quantity * EXP(-0.35::DOUBLE * (r - 1))) FILTER (WHERE r <= 10) / SUM(EXP(-0.35::DOUBLE * (r - 1))) FILTER (WHERE r <= 10), 3) AS quantity_ewma_10,
  MAX(available_at) AS max_available_at
FROM r GROUP BY row_id""",
)
def pit_bitemporal_shipments(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    history = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("h_cust"), F.col("o_orderdate").alias("event_time"), F.col("l_shipdate").alias("available_at"), F.col("o_orderkey").alias("h_order"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    candidates = orders.select(F.col("o_orderkey").alias("row_id"), "o_custkey", F.col("o_orderdate").alias("cutoff"))
    newest = [F.desc(c) for c in ("available_at", "h_order", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    measures = {"value_last_5": ("sum", "l_extendedprice", 5), "value_per_90_units_10": ("rate", "l_extendedprice", "l_quantity", 10), "quantity_ewma_10": ("ewma", "l_quantity", 10)}
    found = folds.recent_as_of(candidates, history, ("o_custkey", "h_cust"), "cutoff", "event_time", "available_at", newest, ["l_quantity", "l_extendedprice"], 10, measures=measures)
    return found.filter("events > 0").select(
        "row_id",
        "events",
        F.round("value_last_5", 4).alias("value_last_5"),
        _r(F.col("value_per_90_units_10"), 6).alias("value_per_90_units_10"),
        _r(F.col("quantity_ewma_10")).alias("quantity_ewma_10"),
        F.col("known").alias("max_available_at"),
    )
