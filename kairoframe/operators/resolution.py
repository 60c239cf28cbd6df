"""Resolving what providers send against what is known: teams, players, matches, imports, absences and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relational import top_per_group

FINAL = ("finished", "awarded", "forfeited")


def new_id(*parts: Column) -> Column:
    """An id that the parts alone decide; a missing part is not an empty one, and bars within parts are kept apart."""
    marked = [F.coalesce(F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\0")) for p in parts]
    return F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", *marked), 256), 1, 16))


def get_or_create(incoming: DataFrame, known: DataFrame, name: str, key: str, known_name: str) -> DataFrame:
    """incoming with `key` and `state`: found, created, or blocked where several known entities have the name.

    Known rows that repeat a key are one entity.  Rows without a name are
    nobody in particular: they get no key and the state `unnamed`.
    """
    owners = known.filter(F.col(known_name).isNotNull()).groupBy(F.col(known_name).alias("_name")).agg(F.count_distinct(key).alias("_n"), F.min(key).alias("_key"))
    joined = incoming.join(owners, incoming[name] == owners["_name"], "left")
    state = F.when(incoming[name].isNull(), "unnamed").when(F.col("_n") > 1, "blocked").when(F.col("_n") == 1, "found").otherwise("created")
    made = F.when(F.col("_n") == 1, F.col("_key").cast("string")).when(F.col("_n").isNull() & incoming[name].isNotNull(), new_id(incoming[name]))
    return joined.select(*[incoming[c] for c in incoming.columns if c not in (key, "state")], made.alias(key), state.alias("state"))


def players_get_or_create(incoming: DataFrame, known: DataFrame, fixture: str = "match_id", team: str = "team_id", name: str = "name", key: str = "player_id") -> DataFrame:
    """incoming with `key`, `state` and `review`.

    A known player of the same fixture and team whose name corroborates is the
    one, if no second player does; otherwise a new player is made, to be
    reviewed if the fixture has a corroborating name twice or the name's last
    word once.  What is decided is the same for all rows of a fixture, team and
    name, so it is decided once for each and joined to the rows, repeated ones
    included; known rows that repeat a player are one.  Rows without a name
    get no key and the state `unnamed`.
    """
    cast = known.select(F.col(fixture).alias("_f"), F.col(team).alias("_t"), F.col(name).alias("_name"), F.col(key).cast("string").alias("_key")).distinct()
    asked = incoming.select(F.col(fixture).alias("_if"), F.col(team).alias("_it"), F.col(name).alias("_in")).filter("_in IS NOT NULL").distinct()
    pairs = asked.join(cast, (F.col("_if") == F.col("_f")) & (F.col("_it") == F.col("_t")), "left")
    fits = F.coalesce(S.corroborated(F.col("_in"), F.col("_name")), F.lit(False))
    surname = F.element_at(F.split("_in", " "), -1) == F.element_at(F.split("_name", " "), -1)
    judged = pairs.groupBy("_if", "_it", "_in").agg(F.count_distinct(F.when(fits, F.col("_key"))).alias("_fits"), F.min(F.when(fits, F.col("_key"))).alias("_one"), F.count_if(surname).alias("_like"))
    same = incoming[fixture].eqNullSafe(judged["_if"]) & incoming[team].eqNullSafe(judged["_it"]) & (incoming[name] == judged["_in"])
    joined = incoming.join(judged, same, "left")
    named, one = F.col("_in").isNotNull(), F.col("_fits") == 1
    state = F.when(~named, "unnamed").when(one, "found").otherwise("created")
    made = F.when(one, F.col("_one")).when(named, new_id(F.col("_if"), F.col("_it"), F.col("_in")))
    review = F.when(named & ~one & (F.col("_fits") > 1), "same name").when(named & ~one & (F.col("_like") > 0), "same surname")
    return joined.select(*[incoming[c] for c in incoming.columns if c not in (key, "state", "review")], made.alias(key), state.alias("state"), review.alias("review"))


def matches_get_or_create(incoming: DataFrame, known: DataFrame, mapping: DataFrame, sides: Sequence[str], kickoff: str, scores: Sequence[str], key: str = "match_id", record: str = "record_id", days: int = 21) -> DataFrame:
    """incoming with `key` and `state`: mapped, same day, same score within `days`, or created.

    mapping: (record, key).  Of several known matches the earliest kickoff
    counts, then the smallest key.  Days are joined in buckets, so no pair of
    teams brings all its matches together.
    """
    k = known.select(F.col(key).cast("string").alias("_key"), F.col(kickoff).alias("_at"), *[F.col(c).alias(f"_{c}") for c in (*sides, *scores)])
    bucket = lambda at: F.floor(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) / days)
    spread = k.withColumn("_b", F.explode(F.array(*[bucket(F.col("_at")) + d for d in (-1, 0, 1)])))
    i = incoming.withColumn("_b", bucket(F.col(kickoff)))
    same = i["_b"] == spread["_b"]
    for c in sides:
        same = same & (i[c] == spread[f"_{c}"])
    day = F.to_date(kickoff) == F.to_date("_at")
    score = F.lit(True)
    for c in scores:
        score = score & (F.col(c) == F.col(f"_{c}"))
    near = F.abs(F.unix_timestamp(F.col(kickoff).cast("timestamp")) - F.unix_timestamp(F.col("_at").cast("timestamp"))) <= days * 86400
    first = lambda c: F.min(F.when(c, F.struct("_at", "_key")))["_key"]
    found = i.join(spread, same).groupBy(record).agg(first(day).alias("_day"), first(score & near).alias("_score"))
    mapped = mapping.select(F.col(record), F.col(key).cast("string").alias("_mapped"))
    joined = incoming.join(mapped, record, "left").join(found, record, "left")
    state = F.when(F.col("_mapped").isNotNull(), "mapped").when(F.col("_day").isNotNull(), "same day").when(F.col("_score").isNotNull(), "same score").otherwise("created")
    return joined.select(*incoming.columns, F.coalesce("_mapped", "_day", "_score", new_id(F.col(record).cast("string"))).alias(key), state.alias("state"))


def first_owner(mappings: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the mappings of a source and entity the first in a total order."""
    return top_per_group(mappings, keys, order, 1, "_first").drop("_first")


def self_pairs(matches: DataFrame, keys: Sequence[str], key: str, source: str, scores: Sequence[str], at: str, days: int = 21) -> DataFrame:
    """(first, second, day): groups of exactly two rows of different sources, equal known scores and near times."""
    rows = matches.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(at, key, source, *scores)).alias("a"), F.max(F.struct(at, key, source, *scores)).alias("b"))
    alike = F.lit(True)
    for c in scores:
        alike = alike & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    close = F.unix_timestamp(F.col(f"b.{at}").cast("timestamp")) - F.unix_timestamp(F.col(f"a.{at}").cast("timestamp")) <= days * 86400
    return rows.filter((F.col("n") == 2) & (F.col(f"a.{source}") != F.col(f"b.{source}")) & alike & close).select(F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"), F.to_date(f"a.{at}").alias("day"))


def planned_roles(rows: DataFrame, player: str, role: Column, price: str, allowed: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per player its distinct listed roles in the list's order, whether one is not allowed, and whether prices disagree."""
    listed = F.array_sort(F.collect_list(F.when(role.isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], role.alias("role")))))
    g = rows.groupBy(player).agg(listed.alias("l"), F.count_distinct(price).alias("prices"))
    roles = F.array_distinct(F.transform("l", lambda x: x["role"]))
    return g.select(player, F.array_join(roles, "/").alias("roles"), F.exists(roles, lambda r: ~r.isin(list(allowed))).alias("refused"), (F.col("prices") > 1).alias("price_conflict"))


# ------------------------------------------------------- what was known when


def unavailable(absences: Sequence[DataFrame], cutoff: Column, day: Column, confirmed: DataFrame | None = None) -> DataFrame:
    """Distinct players that an absence known by the cutoff keeps out on the day.

    absences: player_id, source, started_on, ended_on, available_at, id and
    excluded (whether the status keeps a player out).  Of an absence's
    revisions the newest counts.  confirmed: player_id and confirmed_at of a
    sheet that overrides what was known before it.
    """
    out = []
    for a in absences:
        last = top_per_group(a.filter(F.col("available_at") <= cutoff), ["source", "player_id", "started_on"], [F.desc("available_at"), F.desc("id")], 1, "_n")
        active = (F.col("started_on").isNull() | (F.col("started_on") <= day)) & (F.col("ended_on").isNull() | (F.col("ended_on") >= day))
        out.append(last.filter(active & F.col("excluded")).select("player_id", "available_at"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = rows.groupBy("player_id").agg(F.max("available_at").alias("available_at"))
    if confirmed is not None:
        rows = rows.join(confirmed, "player_id", "left").filter(F.col("confirmed_at").isNull() | (F.col("available_at") > F.col("confirmed_at")))
    return rows.select("player_id")


def known_referee(referee: Column, available_at: Column, cutoff: Column) -> Column:
    return F.when(available_at <= cutoff, referee)


def closed_periods(periods: DataFrame, end: str, cutoff: Column) -> DataFrame:
    return periods.filter(F.col(end) < cutoff)


def upcoming(matches: DataFrame, kickoff: str, status: str, now: Column, days: int = 90) -> DataFrame:
    """Matches after now and within the horizon whose status is not final."""
    return matches.filter((F.col(kickoff) > now) & (F.col(kickoff) <= now + F.make_dt_interval(F.lit(days))) & ~F.col(status).isin(*FINAL))


def without_fixture(teams: DataFrame, matches: DataFrame, team: str, home: str, away: str) -> DataFrame:
    """Teams that none of the matches has on either side."""
    sides = matches.select(F.explode(F.array(home, away)).alias(team)).distinct()
    return teams.join(sides, team, "left_anti")


def eligible(rows: DataFrame, label: str, season: str, condition: Column | None = None) -> DataFrame:
    """Examples of a target: label and season known, and the target's own condition."""
    known = rows.dropna(subset=[label, season])
    return known if condition is None else known.filter(F.coalesce(condition, F.lit(False)))


def rescheduled(current: DataFrame, incoming: DataFrame, key: str, now: Column) -> DataFrame:
    """current with kickoffs moved by incoming records: key, kickoff_at, precision, available_at.

    A record moves a match that is not final if it gives the minute, lies in
    the future and is not older than what is known; one that agrees with a
    kickoff of unknown precision gives its precision.  Of a match's records
    the newest that moves it counts, then the latest kickoff.
    """
    c = current.select(key, F.col("kickoff_at").alias("_at"), F.col("precision").alias("_p"), F.col("available_at").alias("_known"), F.col("status").alias("_s"))
    j = incoming.join(c, key)
    moves = (F.col("precision") == "minute") & (F.col("kickoff_at") > now) & (F.col("available_at") >= F.col("_known")) & ~F.col("_s").isin(*FINAL)
    settles = (F.col("_p") == "unknown") & (F.col("_at") == F.col("kickoff_at"))
    best = j.groupBy(key).agg(
        F.max(F.when(moves, F.struct("available_at", "kickoff_at", "precision"))).alias("m"),
        F.max(F.when(~moves & settles, F.struct("available_at", "precision"))).alias("p"),
        F.max("available_at").alias("latest"),
    )
    return current.join(best, key, "left").select(
        *[x for x in current.columns if x not in ("kickoff_at", "precision", "available_at")],
        F.coalesce("m.kickoff_at", "kickoff_at").alias("kickoff_at"),
        F.coalesce("m.precision", "p.precision", "precision").alias("precision"),
        F.greatest("available_at", "latest").alias("available_at"),
    )


def consistent_sheets(stats: DataFrame, scores: DataFrame) -> DataFrame:
    """(match_id, team_id, consistent) from one row for each player and one score for each side.

    stats: match_id, team_id, started, covered, goals, own_goals; scores:
    match_id, team_id, opponent_id, score.  A side is consistent with eleven
    starters, all rows covered, and goals and the others' own goals that make
    its score.
    """
    s = stats.groupBy("match_id", "team_id").agg(F.count_if("started").alias("starters"), F.bool_and("covered").alias("covered"), F.sum("goals").alias("goals"), F.sum("own_goals").alias("own_goals"))
    other = s.select("match_id", F.col("team_id").alias("opponent_id"), F.col("own_goals").alias("given"))
    j = scores.join(s, ["match_id", "team_id"], "left").join(other, ["match_id", "opponent_id"], "left")
    fine = (F.col("starters") == 11) & F.col("covered") & (F.coalesce("goals", F.lit(0)) + F.coalesce("given", F.lit(0)) == F.col("score"))
    return j.select("match_id", "team_id", F.coalesce(fine, F.lit(False)).alias("consistent"))


def compatible_run(runs: DataFrame, references: DataFrame, models: DataFrame, schema: str) -> DataFrame:
    """The newest succeeded run, if its schema, cutoffs and all its models agree; else no row.

    runs: run_id, status, prediction_cutoff, data_cutoff, feature_schema;
    references: run_id, target, model_id, version (what the run says it used);
    models: model_id, target, version, feature_schema, trained_at, training_cutoff.
    """
    newest = runs.filter("status = 'succeeded'").orderBy(F.desc("prediction_cutoff"), F.desc("run_id")).limit(1)
    used = references.distinct().withColumnsRenamed({"target": "_target", "version": "_version"})
    m = newest.select("run_id", "prediction_cutoff", "data_cutoff").join(used, "run_id").join(models, "model_id", "left")
    good = (F.col("target") == F.col("_target")) & (F.col("version") == F.col("_version")) & (F.col("feature_schema") == schema) & (F.col("trained_at") <= F.col("prediction_cutoff")) & (F.col("training_cutoff") <= F.col("data_cutoff"))
    fine = m.groupBy("run_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("fine")).filter("fine").select("run_id")
    return newest.filter((F.col("feature_schema") == schema) & (F.col("data_cutoff") <= F.col("prediction_cutoff"))).join(fine, "run_id", "left_semi")


# ---------------------------------------------------------------- decisions


def signature_groups(rows: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """(signature, group, members): rows grouped by their flags, numbered in the order of the signature."""
    signed = rows.select(key, F.concat(*[F.when(F.col(c), "1").otherwise("0") for c in flags]).alias("signature"))
    counted = signed.groupBy("signature").agg(F.count("*").alias("members"), F.min(key).alias("first"))
    return counted.withColumn("group", F.row_number().over(Window.orderBy("signature")))  # at most 2 ** flags rows


def alternate_draft(rows: DataFrame, order: Sequence[Column], groups: Sequence[str]) -> DataFrame:
    """Each group's rows dealt to two sides by their rank: even and odd."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("rank", rank).withColumn("side", F.when(F.col("rank") % 2 == 1, "first").otherwise("second"))


def replay_order(rows: DataFrame, kind: str, priority: Sequence[str], at: str, tie: Sequence[Column]) -> DataFrame:
    """Observations in the order in which they are replayed: by time, kinds by priority, then a tie-break; numbered within a day."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0))
    place = F.when(place == 0, len(priority) + 1).otherwise(place)
    w = Window.partitionBy(F.to_date(at)).orderBy(at, place, *tie)
    return rows.withColumn("place", F.row_number().over(w))


def swaps_by_horizon(swaps: DataFrame, points: DataFrame, horizons: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Gain of each swap (give, take, price) over the first h periods, and what it costs.

    points: player, period (from 1), points.  Sums are made once for each
    player, then joined twice; budget efficiency is the gain of the longest
    horizon for a unit of price.
    """
    sums = points.groupBy("player").agg(*[F.sum(F.when(F.col("period") <= h, F.col("points")).otherwise(0.0)).alias(f"h{h}") for h in horizons])
    take = sums.select(F.col("player").alias("take"), *[F.col(f"h{h}").alias(f"t{h}") for h in horizons])
    give = sums.select(F.col("player").alias("give"), *[F.col(f"h{h}").alias(f"g{h}") for h in horizons])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = swaps.join(take, "take", "left").join(give, "give", "left")
    last = max(horizons)
    gain = zero(f"t{last}") - zero(f"g{last}")
    return j.select("give", "take", "price", *[(zero(f"t{h}") - zero(f"g{h}")).alias(f"gain_{h}") for h in horizons], F.when(F.col("price") > 0, gain / F.col("price")).alias("efficiency"))


def long_predictions(rows: DataFrame, key: str, targets: dict[str, tuple[Column, float, float, float]]) -> DataFrame:
    """(key, target, value, low, high, reliability): a row for each target.

    targets: name to (prediction, conformal radius, mean absolute error, upper
    bound); intervals stay within 0 and the bound, reliability is 1 / (1 + error).
    """
    made = [
        F.struct(
            F.lit(name).alias("target"),
            S.clip(value, 0.0, bound).alias("value"),
            S.clip(value - radius, 0.0, bound).alias("low"),
            S.clip(value + radius, 0.0, bound).alias("high"),
            F.lit(1 / (1 + error)).alias("reliability"),
        )
        for name, (value, radius, error, bound) in targets.items()
    ]
    return rows.select(key, F.inline(F.array(*made)))


def forecast_inputs(predictions: DataFrame, sheets: DataFrame, priors: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row for each player of a match with a simulation's inputs.

    predictions: match_id, player_id, target, value; sheets: match_id,
    player_id, is_starting (confirmed ones); priors: player_id, penalties_rate.
    A confirmed starter starts for certain, a player missing from its match's
    confirmed sheet does not play; a missing prior is 0.
    """
    # one aggregate for all targets: a pivot would keep a row for each target and player in memory besides
    wide = predictions.groupBy("match_id", "player_id").agg(*[F.first(F.when(F.col("target") == t, F.col("value")), ignorenulls=True).alias(t) for t in targets])
    confirmed = sheets.select("match_id").distinct().withColumn("confirmed", F.lit(True))
    j = wide.join(confirmed, "match_id", "left").join(sheets, ["match_id", "player_id"], "left").join(priors, "player_id", "left")
    named = F.coalesce("confirmed", F.lit(False))
    start = F.when(named, F.coalesce(F.col("is_starting").cast("double"), F.lit(0.0))).otherwise(F.col("start_probability"))
    appear = F.when(named & F.col("is_starting").isNull(), 0.0).when(named & F.col("is_starting"), 1.0).otherwise(F.greatest("appearance_probability", "start_probability"))
    return j.select("match_id", "player_id", start.alias("start"), appear.alias("appearance"), *[t for t in targets if t not in ("start_probability", "appearance_probability")], F.coalesce("penalties_rate", F.lit(0.0)).alias("penalty_weight"))
