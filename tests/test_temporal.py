"""Temporal operators on the rows where such operators go wrong."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import temporal as T


def test_cutoff_is_strict_for_events_and_inclusive_for_availability(spark):
    h = spark.createDataFrame(
        [("a", D(2024, 1, 1), D(2024, 1, 5), 1, 10.0), ("a", D(2024, 1, 2), D(2024, 1, 6), 2, 20.0), ("a", D(2024, 1, 5), D(2024, 1, 5), 3, 30.0), ("b", D(2024, 1, 1), D(2024, 1, 1), 4, 40.0)],
        "k string, event_time timestamp, available_at timestamp, id int, v double",
    )
    c = spark.createDataFrame([(1, "a", D(2024, 1, 5)), (2, "none", D(2024, 1, 5))], "row int, who string, cutoff timestamp")
    out = T.history_as_of(c, h, "row", [("who", "k")], "cutoff", "event_time", "available_at", ["event_time"], [F.desc("available_at"), F.desc("id")], [F.desc("event_time")]).collect()
    assert [(r["row"], r["id"], r["recency"]) for r in out] == [(1, 1, 1)]


def test_latest_visible_version_counts(spark):
    h = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 1, 2), 1), ("a", D(2024, 1, 1), D(2024, 1, 3), 2), ("a", D(2024, 1, 1), D(2024, 1, 9), 3)], "k string, event_time timestamp, available_at timestamp, id int")
    c = spark.createDataFrame([(1, "a", D(2024, 1, 4))], "row int, who string, cutoff timestamp")
    out = T.history_as_of(c, h, "row", [("who", "k")], "cutoff", "event_time", "available_at", ["event_time"], [F.desc("available_at")], [F.desc("event_time")]).collect()
    assert [r["id"] for r in out] == [2]


def test_recent_before_handles_ties_and_no_history(spark):
    h = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("a", 2, 3, 3.0), ("a", 4, 4, 4.0), (None, 1, 5, 5.0)], "k string, t int, id int, v double")
    c = spark.createDataFrame([(1, "a", 4), (2, "a", 1), (3, "zzz", 9), (4, None, 9), (5, "a", 9)], "row int, who string, cutoff int")
    got = {r["row"]: [e["tb"] for e in r["recent"]] for r in T.recent_before(c, h, ("who", "k"), "cutoff", "t", "id", ["v"], 2).collect()}
    assert got == {1: [3, 2], 2: [], 3: [], 4: [], 5: [4, 3]}


def test_null_never_erases(spark):
    u = spark.createDataFrame([("m", 1, 1, 5.0, None), ("m", 2, 2, None, 7.0), ("m", 2, 3, None, None), ("m", 3, 4, 9.0, None)], "k string, at int, id int, a double, b double")
    got = [(r["at"], r["a"], r["b"]) for r in T.merge_versions(u, ["k"], "at", [F.col("id")], ["a", "b"]).orderBy("at").collect()]
    assert got == [(1, 5.0, None), (2, 5.0, 7.0), (3, 9.0, 7.0)]


def test_spans_of_a_player_who_returns(spark):
    e = spark.createDataFrame([(1, t, c) for t, c in ((1, "A"), (2, "A"), (3, "B"), (4, "A"))], "k int, t int, club string")
    got = [(r["club"], r["valid_from"], r["valid_to"], r["observations"]) for r in T.spans(e, ["k"], "t", [F.col("t")], "club").orderBy("valid_from").collect()]
    assert got == [("A", 1, 3, 2), ("B", 3, 4, 1), ("A", 4, None, 1)]


def test_asof_join_strict_and_inclusive(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), (None, 5, 3), ("a", None, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 3, 30), (None, 1, 99)], "k string, rt int, v int")
    take = lambda strict: {r["id"]: r["v"] for r in T.asof_join(left, right, ["k"], "t", "rt", ["v"], strict).collect()}
    assert take(False) == {1: 50, 2: None, 3: None, 4: None}
    assert take(True) == {1: 30, 2: None, 3: None, 4: None}


def test_audit_and_guard(spark):
    s = spark.createDataFrame([(1, 5, 4), (2, 5, 6), (3, 5, None)], "id int, cutoff int, seen int")
    assert [tuple(r) for r in T.audit(s, "cutoff", ["seen"]).collect()] == [("seen", 2, 1)]
    with pytest.raises(Exception, match="future information"):
        T.require_no_future(s, "cutoff", ["seen"]).collect()
    assert T.require_no_future(s.filter("id <> 2"), "cutoff", ["seen"]).count() == 2


def test_array_features_equal_aggregates(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, None, 5.0, 8.0], 1)], "k int, r int, v double")
    agg = rows.groupBy("k").agg(T.ewma(F.col("v"), F.col("r"), 3).alias("e"), T.trend(F.col("v"), F.col("r"), 4).alias("t"), F.stddev_samp("v").alias("s")).first()
    arr = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("a")).select(T.array_ewma("a", "v", 3).alias("e"), T.moments_trend(T.array_moments("a", "v", 4)).alias("t"), T.moments_stddev(T.array_moments("a", "v", 4)).alias("s")).first()
    assert [arr[c] for c in "ets"] == pytest.approx([agg[c] for c in "ets"])
