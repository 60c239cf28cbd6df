"""Identity resolution and data quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ranks, similarity

#: Thresholds of the decision about the best candidate.
RESOLVED, CONSIDERED, MARGIN = 0.87, 0.70, 0.04


def identity_score(query_name: Column, candidate_name: Column, extra: Column | None = None, alike: Column | None = None) -> Column:
    """0.82 for equal normalized names, else 0.70 times their similarity (`alike` if it is known), with evidence added, within [0, 1], to 6 places."""
    base = F.when(query_name == candidate_name, 0.82).otherwise(0.70 * (S.similarity(query_name, candidate_name) if alike is None else alike))
    return F.round(S.clip(base + (F.lit(0.0) if extra is None else extra), 0.0, 1.0), 6)


def evidence(known: Column, agrees: Column, gain: float, loss: float) -> Column:
    """A weight for agreement, a penalty for disagreement, nothing where it is not known."""
    return F.when(known & agrees, gain).when(known, -loss).otherwise(0.0)


def decide(scored: DataFrame, query: str, candidate: str, score: str = "score") -> DataFrame:
    """Per query its best candidate and whether that settles it: resolved, ambiguous or unresolved."""
    w = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    best = scored.withColumns({"_n": F.row_number().over(w), "runner_up": F.lead(score).over(w)}).filter("_n = 1").drop("_n")
    close = (F.col(score) < RESOLVED) | (F.col(score) - F.coalesce("runner_up", F.lit(0.0)) <= MARGIN)
    return best.withColumn("decision", F.when(F.col(score) < CONSIDERED, "unresolved").when(close, "ambiguous").otherwise("resolved"))


#: The evidence beside the name: (column, gain where it agrees, loss where it does not, what agreement is called).
IDENTITY_EVIDENCE = (("born", 0.14, 0.30, "date_of_birth_match"), ("nationality", 0.03, 0.02, "nationality_match"), ("team", 0.08, 0.05, "temporal_team_match"), ("position", 0.02, 0.0, "position_match"))


def resolve_identities(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, mapping: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(query, status, selected, confidence, method, candidates): who each query is.

    queries: `query`, name, born, nationality, team, day, position; candidates:
    `candidate`, name, born, nationality, team, valid_from, valid_to, position.
    Names are normalized, what is not known is null.  A team counts for a
    candidate within its validity (both ends included, open ones too) and
    against one of another team.  mapping: (query, candidate) known before; if
    its candidate is among them, it is the one.  candidates: the k best, each
    with its confidence and evidence.  Names are searched by the edit-distance
    join, so not every query meets every candidate.  Validities are taken as
    the numbers of the days that are asked about: those that differ on none of
    these are one.
    """
    days = queries.agg(F.array_sort(F.collect_set("day")).alias("_days"))  # one row, the calendar days that are asked about
    dated = queries.crossJoin(F.broadcast(days))
    queries = dated.withColumns({"day": F.when(F.col("day").isNotNull(), F.array_position("_days", F.col("day")).cast("int")), "nationality": F.lower("nationality")}).drop("_days")
    first = F.coalesce(F.size(F.filter("_days", lambda d: d < F.col("valid_from"))) + 1, F.lit(1))
    last = F.when(F.col("valid_to").isNull(), F.size("_days")).otherwise(F.size(F.filter("_days", lambda d: d <= F.col("valid_to"))))
    spans = candidates.crossJoin(F.broadcast(days)).withColumns({"valid_from": first, "valid_to": last, "nationality": F.lower("nationality")}).drop("_days")
    never = F.col("valid_from") > F.col("valid_to")
    candidates = spans.withColumns({"valid_from": F.when(never, 1).otherwise(F.col("valid_from")), "valid_to": F.when(never, 0).otherwise(F.col("valid_to"))})
    both = lambda x: F.col(x).isNotNull() & F.col(f"_{x}").isNotNull()
    in_time = F.col("day").isNull() | ((F.col("_valid_from") <= F.col("day")) & (F.col("_valid_to") >= F.col("day")))
    agrees = {x: F.col(x) == F.col(f"_{x}") for x, *_ in IDENTITY_EVIDENCE}
    extra = F.lit(0.0)
    for x, gain, loss, _ in IDENTITY_EVIDENCE:
        counts = F.when(agrees[x] & (in_time if x == "team" else F.lit(True)), gain).when(~agrees[x], -loss).otherwise(0.0)
        extra = extra + F.when(both(x), counts).otherwise(0.0)
    most = sum(gain for _, gain, _, _ in IDENTITY_EVIDENCE)
    evidence, facts = ["born", "nationality", "team", "day", "position"], ["born", "nationality", "team", "valid_from", "valid_to", "position"]
    near = similarity.nearest(queries, candidates, query, candidate, "name", evidence, lambda a, b, alike: identity_score(a, b, extra, alike), lambda s: 0.70 * s + most, k, agree={x: (x, *(("valid_from", "valid_to") if x == "team" else ())) for x, *_ in IDENTITY_EVIDENCE})
    named = candidates.select(candidate, *[F.col(x).alias(f"_{x}") for x in ("name", *facts)])
    told = near.join(named, candidate).join(queries.select(query, "name", *evidence), query)
    labels = [F.when(F.col("name") == F.col("_name"), "exact_normalized_name").otherwise("fuzzy_name"), F.when(both("born") & ~agrees["born"], "date_of_birth_conflict")]
    labels += [F.when(both(x) & agrees[x] & (in_time if x == "team" else F.lit(True)), label) for x, _, _, label in IDENTITY_EVIDENCE]
    entry = F.struct((-F.col("score")).alias("_order"), F.col(candidate).alias("candidate"), F.col("score").alias("confidence"), F.array_sort(F.array_compact(F.array(*labels))).alias("evidence"))
    ranked = told.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["candidate"].alias("candidate"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence"))).alias("candidates"))
    out = queries.select(query).join(ranked, query, "left")
    best, second = F.get("candidates", 0), F.get("candidates", 1)
    confidence = F.coalesce(best["confidence"], F.lit(0.0))
    close = (confidence < RESOLVED) | (second.isNotNull() & (confidence - second["confidence"] <= MARGIN))
    status = F.when(confidence < CONSIDERED, "unresolved").when(close, "ambiguous").otherwise("resolved")
    method = F.when(F.array_contains(best["evidence"], "temporal_team_match"), "temporal_context").when(F.array_contains(best["evidence"], "exact_normalized_name"), "exact").otherwise("fuzzy")
    known = F.lit(None)
    if mapping is not None:
        owned = mapping.select(F.col(query), F.col(candidate).alias("_mapped")).join(candidates.select(F.col(candidate).alias("_mapped")), "_mapped", "left_semi")
        out, known = out.join(owned, query, "left"), F.col("_mapped")
    settled = F.when(known.isNotNull(), "resolved").otherwise(status)
    return out.select(
        query,
        settled.alias("status"),
        F.when(known.isNotNull(), known).when(status == "resolved", best["candidate"]).alias("selected"),
        F.when(known.isNotNull(), 1.0).otherwise(confidence).alias("confidence"),
        F.when(known.isNotNull(), "existing_mapping").when(status == "resolved", method).alias("method"),
        F.when(known.isNotNull(), F.array(F.struct(known.cast(dict(candidates.dtypes)[candidate]).alias("candidate"), F.lit(1.0).alias("confidence"), F.array(F.lit("existing_provider_mapping")).alias("evidence")))).otherwise(F.coalesce("candidates", F.filter("candidates", lambda x: F.lit(False)))).alias("candidates"),
    )


def corroborated_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, name: str, other_name: str, ranges: int | None = None) -> DataFrame:
    """(keys, pairs, corroborated): how many pairs with equal keys and at < other there are, and for how many of them `scalars.corroborated` holds of the two names.

    Nothing is paired.  Pairs with one of a set of equal names, or of equal
    tails and initials, are counted along the order of `at`: a row on the right
    has as many partners as rows on the left come before it.  Corroborated are
    pairs of equal names that no initial stands for, and pairs of equal tails
    and initials but those where both first names are written out.
    """
    def lines(df: DataFrame, place: str, text: str, is_left: int) -> DataFrame:
        words = F.split(F.col(text), " ")
        head, long = F.element_at(words, 1), F.size(words) > 1
        tail = F.concat_ws(" ", F.array(F.substring(head, 1, 1)), F.slice(words, 2, F.size(words)))
        line = lambda kind, match, plus, when=None: F.when(F.lit(True) if when is None else F.col(text).isNotNull() & when, F.struct(F.lit(kind).alias("kind"), match.alias("match"), F.lit(plus).alias("plus")))
        made = F.array(
            line("pair", F.lit(""), 0),
            line("name", F.col(text), 1, ~(long & (F.length(head) == 1))),
            line("tail", tail, 1, long),
            line("written out", tail, -1, long & (F.length(head) != 1)),
        )
        held = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, place)]))
        return held.select(*keys, F.col(place).alias("_place"), F.lit(is_left).cast("bigint").alias("_left"), F.explode(F.array_compact(made)).alias("_line")).select(*keys, "_place", "_left", "_line.*")

    both = lines(left, at, name, 1).unionByName(lines(right, other, other_name, 0))
    # equal rows may stand in any order: at one place the right ones come first and are the same to the sum
    counted = both.groupBy(*keys, "kind", "match", "plus", "_place", "_left").agg(F.count("*").alias("_n"))
    run = ranks.running(counted, [*keys, "kind", "match"], [F.col("_place"), F.col("_left")], {"_before": F.col("_n") * F.col("_left")}, ranges).filter("_left = 0")
    found = F.col("_n") * F.col("_before")
    return run.groupBy(*keys).agg(F.sum(F.when(F.col("kind") == "pair", found).otherwise(0)).alias("pairs"), F.sum(found * F.col("plus")).alias("corroborated"))


def redirects(df: DataFrame, key: str, same: Sequence[Column]) -> DataFrame:
    """(old, new) for the keys that stand for what a smaller key already stands for."""
    grouped = df.withColumn("new", F.min(key).over(Window.partitionBy(*same)))
    return grouped.filter(F.col(key) != F.col("new")).select(F.col(key).alias("old"), "new")


def redirect(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A foreign key rewritten by a redirect map."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, df[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def findings(df: DataFrame, key: Column, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(rule, severity, record) for every broken rule, in one pass; a rule's condition is true where it is broken."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("record"))) for name, (severity, c) in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*broken))).alias("f")).select("f.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def accepted_result(results: DataFrame, keys: Sequence[str], priority: str, available_at: str, complete: Column, tiebreak: Sequence[str]) -> DataFrame:
    """The record of each key that precedence keeps: complete ones first, then better priority (smaller), then the newest."""
    w = Window.partitionBy(*keys).orderBy(F.when(complete, 0).otherwise(1), priority, F.desc(available_at), *tiebreak)
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def freshness(last_success: Column, now: Column, stale_after_days: int, configured: Column) -> Column:
    return F.when(~configured, "unconfigured").when(last_success.isNull(), "unavailable").when(F.datediff(now, last_success) > stale_after_days, "stale").otherwise("available")


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of names, types and nullability; equal for tables of equal schema."""
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that depends on the set of rows, not on their order or files."""
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("digest"))


def secret_keys(df: DataFrame, json_column: str, pattern: str = "(password|secret|token|api_?key)") -> DataFrame:
    """Rows whose JSON has, at any depth, a key that looks like a secret's."""
    return df.filter(F.col(json_column).rlike(rf'(?i)"[^"\\]*{pattern}[^"\\]*"\s*:'))


def legal_rosters(roster: DataFrame, slots: dict[str, int], team: str = "team", roles: str = "roles") -> DataFrame:
    """(team, legal): whether all its players can be placed at once, each in one of their roles.

    A role without a limit in slots has room for all.  By Hall's theorem the
    others can be placed if and only if for every set of limited roles no more
    players have all their roles in it than it has slots; the counts per set of
    roles are one aggregate, whatever the roster's size.
    """
    names = sorted(slots)
    bit = F.aggregate(roles, F.lit(0), lambda m, r: m.bitwiseOR(F.coalesce(S.lookup(r, {n: str(1 << i) for i, n in enumerate(names)}).cast("int"), F.lit(0))))
    free = F.exists(roles, lambda r: ~r.isin(names))
    masks = roster.select(team, F.when(free, F.lit(-1)).otherwise(bit).alias("mask")).groupBy(team, "mask").agg(F.count("*").alias("n"))
    held = masks.groupBy(team).agg(F.collect_list(F.struct("mask", "n")).alias("masks"))  # at most one entry for each set of roles
    rooms = [(s, sum(slots[n] for i, n in enumerate(names) if s >> i & 1)) for s in range(1 << len(names))]
    sets = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(room).alias("room")) for s, room in rooms])
    inside = lambda s: F.aggregate(F.filter("masks", lambda m: (m["mask"] >= 0) & (m["mask"].bitwiseOR(s["set"]) == s["set"])), F.lit(0).cast("bigint"), lambda t, m: t + m["n"])
    return held.select(team, F.forall(sets, lambda s: inside(s) <= s["room"]).alias("legal"))


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); a condition that is null rejects."""
    good = F.coalesce(valid, F.lit(False))
    return df.filter(good), df.filter(~good)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
