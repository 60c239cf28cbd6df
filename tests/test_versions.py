"""Commits of several tables at once: two writers, readers without a gap, units of work that fail, replays that are lost."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kairoframe.sources import replay, sinks, tables, versions

ROWS = "k int, v string, at int"


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, f"file://{tmp_path}/store")


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_of_two_writers_one_fails_cleanly(spark, store):
    with store.begin() as work:
        work.write("a", rows(spark, (1, "x", 1)))
    one, two = store.begin(), store.begin()
    one.append("a", rows(spark, (2, "y", 1)))
    two.append("a", rows(spark, (3, "z", 1)))
    two.write("b", rows(spark, (9, "b", 1)))
    assert one.commit() == 2
    with pytest.raises(versions.Conflict):
        two.commit()
    assert content(store.read("a")) == [(1, "x", 1), (2, "y", 1)]
    with pytest.raises(KeyError):
        store.read("b")
    data = two.store.folder.removeprefix("file://") + "/data"
    import os

    assert sum(len(os.listdir(f"{data}/{t}")) for t in os.listdir(data)) == 2  # the loser's data is gone


def test_the_loser_can_try_again_and_no_update_is_lost(spark, store):
    tried = []

    def add(work):
        tried.append(work.base)
        work.append("a", rows(spark, (len(tried), "mine", 1)))
        if len(tried) == 1:  # another writer is first
            with store.begin() as other:
                other.append("a", rows(spark, (7, "other", 1)))

    assert store.transact(add) == 2
    assert tried == [0, 1] and content(store.read("a")) == [(2, "mine", 1), (7, "other", 1)]
    with pytest.raises(versions.Conflict):
        store.transact(lambda w: (w.write("a", rows(spark, (0, "", 0))), versions.Store(spark, store.folder).transact(lambda o: o.append("a", rows(spark, (8, "", 0))))), attempts=2)


def test_a_unit_that_fails_between_two_writes_leaves_nothing(spark, store):
    versions.run_unit(store, "run-1", lambda w: w.write("a", rows(spark, (1, "x", 1))))

    def half(work):
        work.upsert("a", rows(spark, (1, "changed", 2)), ["k"])
        raise OSError("no connection")

    assert not versions.run_unit(store, "run-2", half)
    assert content(store.read("a")) == [(1, "x", 1)]
    assert content(store.read("runs")) == [("run-1", "succeeded", None), ("run-2", "failed", "OSError: no connection")]


def test_readers_keep_their_version_and_old_data_can_go(spark, store):
    for n in range(4):
        with store.begin() as work:
            work.write("a", rows(spark, (n, "x", n)))
    held = store.read("a", 3)
    assert store.vacuum(keep=2) == 2
    assert content(held) == [(2, "x", 2)] and content(store.read("a")) == [(3, "x", 3)]
    with store.begin() as work:
        pass
    assert store.head()[0] == 4  # nothing written, no commit


def test_tables_of_one_pointer(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    sinks.merge_into(spark, where, rows(spark, (1, "a", 1), (2, "b", 5)), ["k"], "at")
    sinks.merge_into(spark, where, rows(spark, (1, "a2", 2), (2, "old", 4), (3, "c", 1)), ["k"], "at")
    assert content(sinks.current(spark, where)) == [(1, "a2", 2), (2, "b", 5), (3, "c", 1)]
    sinks.refresh_where(spark, where, F.col("k") > 1, rows(spark, (9, "new", 0)))
    assert content(sinks.current(spark, where)) == [(1, "a2", 2), (9, "new", 0)]
    sinks.write_text(spark, f"{where}/note.txt", "one")
    sinks.write_text(spark, f"{where}/note.txt", "two")
    assert sinks.read_text(spark, f"{where}/note.txt") == "two"


# ------------------------------------------------------------------ replay


def at(day):
    return datetime(2024, 1, day)


RUNS = "run_id string, source string, scope string, status string, started_at timestamp, replay_of string"
SEEN = "run_id string, kind string, object_id string, content string, available_at timestamp"


def archive(spark, observations, runs=None):
    runs = runs or [("r1", "s", "x", "succeeded", at(1), None), ("r2", "s", "x", "succeeded", at(2), None), ("r3", "s", "x", "failed", at(3), None), ("r4", "s", "x", "succeeded", at(4), "r1"), ("r5", "bronze", "x", "succeeded", at(5), None)]
    seen = spark.createDataFrame(observations, SEEN).withColumn("sha256", F.sha2("content", 256))
    return spark.createDataFrame(runs, RUNS), seen


def parse(df):
    return df.select("*", F.from_json("content", "k int, v string").alias("j")).select(*df.columns, "j.*")


TARGETS = [replay.Target("fixtures", ("fixture:a",), ("k",), parse), replay.Target("shots", ("shots",), ("k",), parse)]


def test_replay_in_order_once_and_again(spark, store):
    runs, seen = archive(spark, [
        ("r1", "shots", "o1", '{"k":1,"v":"first"}', at(1)),
        ("r1", "fixture:a", "o1", '{"k":1,"v":"f1"}', at(1)),
        ("r2", "shots", "o1", '{"k":1,"v":"second"}', at(1)),  # as available as the first: the later in the replay counts
        ("r2", "shots", "o2", '{"k":2,"v":"newer"}', at(9)),
        ("r2", "shots", "o3", '{"k":2,"v":"older"}', at(2)),
        ("r2", "fixture:a", "o1", '{"k":1,"v":"f1"}', at(1)),  # an observation of r1 again
        ("r1", "shots", "bad", "{}", at(1)),  # no key; r2 has a valid answer to the same request
        ("r2", "shots", "bad", '{"k":3,"v":"mended"}', at(2)),
        ("r3", "shots", "o9", '{"k":9,"v":"of a failed run"}', at(3)),
        ("r4", "shots", "o9", '{"k":9,"v":"of a replay"}', at(3)),
        ("r5", "shots", "o9", '{"k":9,"v":"of a bronze source"}', at(3)),
    ])
    planned = replay.plan(runs, seen, ["bronze"], F.get_json_object("content", "$.k").isNotNull())
    assert sorted((r.reason, r.run_id) for r in planned.report.collect()) == [("bronze only", "r5"), ("repeated observation", "r1"), ("superseded payload", "r1"), ("unavailable run", "r3")]

    def lost(batch):
        if batch == 1:
            raise ConnectionError

    with pytest.raises(ConnectionError):
        replay.replay(store, planned, TARGETS, 2, lost)
    assert store.head()[0] == 1 and content(store.read("shots").select("k", "v")) == [(1, "first")]
    assert replay.replay(store, planned, TARGETS, 2) == {"batch 0": 0, "batch 1": 4}
    want = [(1, "second"), (2, "newer"), (3, "mended")]
    assert content(store.read("shots").select("k", "v")) == want and content(store.read("fixtures").select("k", "v")) == [(1, "f1")]
    number = store.head()[0]
    assert set(replay.replay(store, planned, TARGETS, 1).values()) == {0} and store.head()[0] == number
    fresh = versions.Store(spark, store.folder + "-again")
    replay.replay(fresh, planned, TARGETS, 1)
    assert content(fresh.read("shots")) == content(store.read("shots"))


def test_rejected_and_damaged_payloads_stop_the_plan(spark):
    runs, seen = archive(spark, [("r1", "shots", "ok", '{"k":1}', at(1)), ("r2", "shots", "bad", "{}", at(2)), ("r1", "shots", "bad", '{"k":2}', at(1))])
    valid = F.get_json_object("content", "$.k").isNotNull()
    with pytest.raises(Exception, match="no later valid answer"):
        replay.plan(runs, seen, valid=valid).observations.collect()
    with pytest.raises(Exception, match="damaged"):
        replay.plan(runs, seen.withColumn("sha256", F.lit("0")), valid=valid).observations.collect()


def test_priorities_of_kinds(spark):
    names = ["release-manifest", "Fixtures", "team_match_stats", "lineups", "shot-map", "event", "odds", "player shots"]
    df = spark.createDataFrame([(n,) for n in names], "kind string")
    assert [r[0] for r in df.select(replay.priority(F.col("kind"))).collect()] == [0, 1, 2, 3, 4, 5, 6, 2]


def test_appended_rows_are_one_more_folder_until_there_are_many(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "PARTS", 3)
    folders = []
    for k in range(5):
        with store.begin() as work:
            work.append("t", spark.createDataFrame([(k, str(k))], "k int, v string" if k % 2 else "k int, w string"))
        folders.append(versions._paths(store.head()[1]["tables"]["t"]))
        assert sorted(r.k for r in store.read("t").collect()) == list(range(k + 1))
    assert [len(f) for f in folders] == [1, 2, 3, 1, 2]
    assert folders[0] == folders[1][:1] == folders[2][:1] and folders[3] == folders[4][:1]
    assert {(r.k, r.v, r.w) for r in store.read("t").collect()} == {(0, None, "0"), (1, "1", None), (2, None, "2"), (3, "3", None), (4, None, "4")}
    store.vacuum(1)
    assert store.read("t").count() == 5


def test_a_plan_is_one_shuffle_and_a_lost_replay_leaves_nothing_staged(spark, store, monkeypatch):
    shuffles = []
    keep = replay.staged
    monkeypatch.setattr(replay, "staged", lambda df, name: shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or keep(df, name))
    runs = spark.range(2).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit("s").alias("source"), F.lit("x").alias("scope"), F.lit("succeeded").alias("status"), F.timestamp_seconds("id").alias("started_at"), F.lit(None).cast("string").alias("replay_of"))
    content = F.to_json(F.struct(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")))
    seen = spark.range(20).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.lit("shots").alias("kind"), F.col("id").cast("string").alias("object_id"), content.alias("content"), F.sha2(content, 256).alias("sha256"), F.timestamp_seconds("id").alias("available_at"))
    planned = replay.plan(runs, seen)
    assert shuffles == [1]

    def lost(batch):
        if batch == 1:
            raise ConnectionError

    before = {p for p in tables._staged[spark.sparkContext.applicationId] if "replay-batch" in p}
    with pytest.raises(ConnectionError):
        replay.replay(store, planned, TARGETS, 2, lost)
    assert {p for p in tables._staged[spark.sparkContext.applicationId] if "replay-batch" in p} == before
    assert replay.replay(store, planned, TARGETS, 2, keep=1) == {"batch 0": 0, "batch 1": 10}
    assert replay.replay(store, planned, TARGETS, 3, keep=1) == {"batch 1": 0, "batch 2": 0}
    assert store.read("shots").count() == 20 and not {"sha256", "identity"} & set(store.read("shots").columns)
    assert {len(r.identity) for r in store.read(replay.LEDGER).collect()} == {16}


def test_what_a_run_gains_after_its_replay_is_replayed_as_if_all_had_been_there(spark, store):
    one = [("r1", "shots", "o1", '{"k":1,"v":"a"}', at(1)), ("r1", "shots", "o7", '{"k":7,"v":"x"}', at(1)), ("r2", "shots", "o2", '{"k":2,"v":"b"}', at(1)), ("r2", "fixture:a", "o3", '{"k":3,"v":"c"}', at(3))]
    more = [("r1", "shots", "o1", '{"k":1,"v":"%s"}' % v, at(1)) for v in "bcdefg"] + [("r1", "shots", "o2", '{"k":2,"v":"b"}', at(1)), ("r2", "fixture:a", "o3", '{"k":3,"v":"d"}', at(3))]
    first, both = replay.plan(*archive(spark, one)), replay.plan(*archive(spark, one + more))
    assert replay.replay(store, first, TARGETS, 2) == {"batch 0": 2, "batch 1": 2}
    assert replay.replay(store, both, TARGETS, 2) == {"batch 0": 6, "batch 1": 1}  # r1 has o2's observation now, which is in the ledger by r2
    assert replay.replay(store, both, TARGETS, 1) == {"batch 0": 0}
    fresh = versions.Store(spark, store.folder + "-again")
    assert replay.replay(fresh, both, TARGETS, 1) == {"batch 0": 11}
    for name in ("shots", "fixtures"):
        assert content(store.read(name).select("k", "v")) == content(fresh.read(name).select("k", "v"))
    last = max("abcdefg", key=lambda v: hashlib.sha256(b'{"k":1,"v":"%s"}' % v.encode()).hexdigest())
    assert {r.k: r.v for r in fresh.read("shots").collect()} == {1: last, 2: "b", 7: "x"}
    assert not [p for p in tables._staged[spark.sparkContext.applicationId] if "replay-batch" in p]
