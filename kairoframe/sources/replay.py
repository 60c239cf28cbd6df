"""Rebuilding tables from the archive of raw payloads, in order, once, and as often as one likes.

Observations are what providers sent, kept as they came, and belong to runs.
`plan` decides what is replayed: runs that succeeded and are no replays
themselves, every immutable observation once (of equal ones the earliest
run's), and nothing that a parser rejects, if a later run has a valid answer
to the same request; if none has, the plan fails.  `replay` parses what is
planned, folds it by entity (an entity's last record is the one that was
available last, and of these the last in the order of the replay), and commits
tables and a ledger of what has been replayed together.  A replay that was
lost goes on with what the ledger lacks; a second one changes nothing.

Digests do not compress, so hardly any are moved or kept: two records are told
apart by them only where all else that places them is equal, and the ledger
is met as a whole, by number and sums of its runs' identities, before it is
met row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .tables import dropped_shuffles, staged, unstaged
from .versions import Store

#: Kinds by what their name holds, in the order in which a run's observations are replayed.
KINDS = (("manifest", 0), ("github-release", 0), ("original-response", 0), ("fixture", 1), ("schedule", 1), ("player", 2), ("team_match", 2), ("lineup", 3), ("shot", 4), ("event", 5))
LEDGER = "replayed"
#: Groups of objects that go to a task together; many more than there are tasks.
DEALT = 65_536
#: What places an observation in the replay; `digests` (sha256, identity) decide among equal ones and are null where there are none.
ORDER = ("started_at", "run_id", "priority", "object_id", "digests")


@dataclass(frozen=True)
class Target:
    """A table that observations of some kinds are parsed into; parse gives a row for each record, with the observation's columns."""

    name: str
    kinds: tuple[str, ...]
    keys: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]


def priority(kind: Column) -> Column:
    """The rank of the first token that the kind's name holds; unknown kinds come last."""
    out = F.lit(6)
    for token, rank in reversed(KINDS):
        out = F.when(F.contains(F.lower(kind), F.lit(token)), rank).otherwise(out)
    return out


@dataclass
class Plan:
    """observations: what is replayed, with `identity`, `priority` and `digests`; report: (reason, run_id, identity, replacement) of the rest."""

    observations: DataFrame
    report: DataFrame
    _runs: list[Row] | None = field(default=None, repr=False)

    def runs(self) -> list[Row]:
        """What is replayed of each run, in order: started_at, run_id, number and sums; counted once."""
        if self._runs is None:
            self._runs = _by_run(self.observations.withColumn("identity", _held_identity()), "started_at", "run_id").orderBy("started_at", "run_id").collect()  # as many as runs
        return self._runs


def plan(runs: DataFrame, observations: DataFrame, bronze_only: Sequence[str] = (), valid: Column | None = None) -> Plan:
    """What of an archive is replayed.

    runs: run_id, source, scope, status, started_at, replay_of; observations:
    run_id, kind, object_id, content, sha256, available_at.  valid: whether an
    observation's content can be parsed.  Reading a content that has not its
    digest fails.
    """
    broken = F.raise_error(F.concat(F.lit("archived content is damaged: "), F.coalesce("sha256", F.lit("no digest")))).cast("string")
    sound = observations.withColumn("content", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(broken))
    originals = runs.filter(F.col("replay_of").isNull() & ~F.col("source").isin(list(bronze_only)))
    skipped = originals.filter(F.coalesce(F.col("status") != "succeeded", F.lit(True))).select(F.lit("unavailable run").alias("reason"), "run_id")
    skipped = skipped.unionByName(runs.filter(F.col("replay_of").isNull() & F.col("source").isin(list(bronze_only))).select(F.lit("bronze only").alias("reason"), "run_id"))
    used = originals.filter("status = 'succeeded'").select("run_id", "source", "scope", "started_at")
    rows = sound.join(used, "run_id").select("run_id", "started_at", "source", "scope", "kind", "object_id", "available_at", "content")  # equal digests are equal contents
    rows = rows.withColumn("_valid", F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    # One shuffle, by object: what is equal, what answers a request and what has one place are all found inside it, and digests are made anew where they are needed.
    # The shuffle's key is a column of its own: Spark takes constants (a single source) out of the windows' keys, but not out of the shuffle's, and would shuffle again.
    dealt = rows.withColumn("_dealt", F.pmod(F.xxhash64("source", "scope", "object_id"), F.lit(DEALT)).cast("int")).repartition("_dealt")
    thing = ["_dealt", "source", "scope", "object_id"]  # the windows' keys and orders begin alike, so one sort serves all
    seen = Window.partitionBy(*thing, "kind", "available_at", "content").orderBy("started_at", "run_id")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    once = dealt.withColumns({"_place": F.row_number().over(seen), "_n": F.count("*").over(seen.rowsBetween(*whole))}).filter("_place = 1").drop("_place")
    along = Window.partitionBy(*thing).orderBy("kind", "available_at", "content")
    time = F.struct("kind", "available_at")
    alike = F.lag(time).over(along).eqNullSafe(time) | F.lead(time).over(along).eqNullSafe(time) | ~F.first("kind").over(along.rowsBetween(*whole)).eqNullSafe(F.last("kind").over(along.rowsBetween(*whole)))
    once = once.withColumns({"_alike": alike, "_asked": F.bool_or(~F.col("_valid")).over(along.rowsBetween(*whole))})
    answer = F.when(F.col("_asked") & F.col("_valid"), F.struct("started_at", _identity().alias("identity")))
    judged = once.withColumn("_answer", F.max(answer).over(Window.partitionBy(*thing, "kind")))
    late = F.coalesce(F.col("_answer.started_at") > F.col("started_at"), F.lit(False))
    lost = F.raise_error(F.concat(F.lit("no later valid answer to a rejected payload: "), _identity())).cast("string")
    judged = judged.withColumn("_replacement", F.when(F.col("_valid"), F.lit(None).cast("string")).when(late, F.col("_answer.identity")).otherwise(lost)).drop("_answer", "_asked")
    with dropped_shuffles(observations.sparkSession):
        held = staged(judged.drop("_dealt"), "replay-plan")
    repeats = held.filter("_n > 1").select(F.lit("repeated observation").alias("reason"), "run_id", _identity().alias("identity"), F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))).alias("_k")).drop("_k")
    quarantined = held.filter("NOT _valid").select(F.lit("superseded payload").alias("reason"), "run_id", _identity().alias("identity"), F.col("_replacement").alias("replacement"))
    report = quarantined.unionByName(skipped, allowMissingColumns=True).unionByName(repeats, allowMissingColumns=True)
    kept = held.filter("_valid").withColumns({"sha256": F.sha2("content", 256), "identity": _identity(), "priority": priority(F.col("kind"))})
    kept = kept.withColumn("digests", F.when(F.col("_alike"), F.unhex(F.concat("sha256", "identity"))))
    return Plan(kept.select(*ORDER, "sha256", "identity", "source", "scope", "kind", "content", "available_at"), report)


def _identity() -> Column:
    """The digest of what makes an observation."""
    return F.sha2(F.to_json(F.struct("source", "scope", "kind", "object_id", "available_at", F.sha2("content", 256).alias("sha256")), {"ignoreNullFields": "false"}), 256)


def _held_identity() -> Column:
    """The identity as the ledger has it: its first 128 bits."""
    return F.unhex(F.substring("identity", 1, 32))


def _by_run(rows: DataFrame, *keys: str) -> DataFrame:
    """How many identities there are of a run and 128 bits of sums that no order changes: equal for equal sets."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("identity")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "identity")).alias("other"))


def fold(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each entity: its record that was available last, and of these the last in the replay; aggregated before the shuffle."""
    place = ["available_at", *ORDER]
    rest = [c for c in records.columns if c not in (*keys, *place)]
    if any("map<" in kind for c, kind in records.dtypes if c in rest):  # maps have no order
        latest = F.max_by(F.struct(*place, *rest), F.struct(*place))
    else:
        latest = F.max(F.struct(*place, *rest))  # what places a record travels once
    held = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(latest.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in held])


def replay(store: Store, planned: Plan, targets: Sequence[Target], batches: int = 1, each: Callable[[int], None] | None = None, keep: int | None = None) -> dict[str, int]:
    """Brings the store to what the planned observations say; gives how many were new, by batch.

    Batches are of consecutive runs and are committed one by one, so a lost
    replay repeats one batch at most.  each: called before a batch is
    committed (a test loses the run there).  keep: for a store that nobody
    else uses, the newest commits whose data stays (`Store.vacuum`).

    A run with new observations is folded whole: that changes nothing of what
    the tables have of it, and gives digests to those that are no longer alone
    in their place.
    """
    spark = store.spark
    runs = planned.runs()
    done: dict[str, int] = {}
    for k in range(batches):
        some = runs[len(runs) * k // batches : len(runs) * (k + 1) // batches]
        if not some:
            continue
        of = lambda ids: planned.observations.filter(F.col("run_id").isin(list(ids)))
        lacking = None
        try:
            with dropped_shuffles(spark), store.begin() as work:
                ledger = work.read(LEDGER)
                known = {} if ledger is None else {r["run_id"]: r for r in _by_run(ledger, "run_id").collect()}
                told = {r["run_id"]: r for r in runs}
                alike = all(run in told and all(told[run][c] == held[c] for c in ("n", "one", "other")) for run, held in known.items())
                entries = lambda ids: of(ids).select(_held_identity().alias("identity"), "run_id", "source")
                if alike:  # the ledger's runs are planned as it has them; an identity is planned once, so it has nothing of the others
                    changed = [r["run_id"] for r in some if r["run_id"] not in known]
                    new, lines = sum(told[run]["n"] for run in changed), entries(changed)
                else:
                    lacking = staged(entries(r["run_id"] for r in some).join(ledger.select("identity"), "identity", "left_anti"), "replay-batch")
                    per_run = {r["run_id"]: r["count"] for r in lacking.groupBy("run_id").count().collect()}
                    changed, new, lines = list(per_run), sum(per_run.values()), lacking
                done[f"batch {k}"] = new
                if new:
                    for target in targets:
                        parsed = target.parse(of(changed).filter(F.col("kind").isin(list(target.kinds)))).drop("content", "kind", "scope", "sha256", "identity")
                        held = work.read(target.name)
                        work.write(target.name, fold(parsed if held is None else held.unionByName(parsed), target.keys))
                    work.append(LEDGER, lines)
                    work.note = f"replay of {new} observations"
                if each is not None:
                    each(k)
        finally:
            if lacking is not None:
                unstaged(lacking)
        if keep is not None and new:
            store.vacuum(keep)
    return done
