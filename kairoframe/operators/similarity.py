"""Joins of texts by edit distance, and searches for the likest ones, without comparing all with all.

`edit_pairs` finds every pair of texts with similarity (1 - edit distance /
longer length) of at least `least`.  Of two such texts the longer one, of
length L, is at most e = floor((1 - least) L) edits from the other.  Cut it
into e + 1 segments: one of them stands unchanged in the shorter text, and
not far from its own place, as at most i edits lie before the i-th segment
or at most e - i behind it (Li and others, "Pass-Join", 2011).  So each text
is announced by its segments and asked for by the few substrings that could
be one; both are rows, a signature is a shuffle key, and only texts that
share one are compared.  A signature that very many texts share is a skewed
key of an equi-join, which Spark splits.

`nearest` finds for each query the best candidates by a score of name and
evidence.  It works on profiles, one for all rows with equal name and
evidence, and in rounds of falling similarity: a query is done when no
candidate that is still unseen could reach its k-th best.  Of the candidates
of a name it meets only the first few for each way to agree with the evidence,
which an index holds, so the work for a query does not grow with them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Similarities down to which the rounds of `nearest` look; queries that are open after the last meet every candidate.
ROUNDS = (0.8, 0.6, 0.4, 0.2)
#: Parts of the candidates that an open query meets after the last round.
BLOCKS = 16


def _edits(length: str, least: float) -> str:
    """The most edits between a text of this length and one that is no longer, at similarity `least`."""
    return f"cast(floor({1 - least + 1e-9!r} * {length}) as int)"


def _segments(texts: DataFrame, least: float) -> DataFrame:
    """(t, long_size, i, s): the segments of every text; the last ones are longer by one where it does not divide."""
    e = texts.filter("length(t) > 0").selectExpr("t", "length(t) as long_size", f"{_edits('length(t)', least)} as e")
    cut = "long_size - (e + 1) * cast(floor(long_size / (e + 1)) as int)"  # how many segments are longer
    rows = e.selectExpr("t", "long_size", "e", f"{cut} as more", "cast(floor(long_size / (e + 1)) as int) as size", "explode(sequence(0, e)) as i")
    start = "i * size + greatest(0, i - (e + 1 - more))"
    long = "if(i >= e + 1 - more, size + 1, size)"
    return rows.selectExpr("t", "long_size", "i", f"substring(t, {start} + 1, {long}) as s")


def _probes(texts: DataFrame, least: float) -> DataFrame:
    """(t, long_size, i, s): the substrings of every text that may be segment i of a text of length long_size, its own or a greater one."""
    longest = f"cast(floor(length(t) / {least - 1e-9!r}) as int)"
    rows = texts.filter("length(t) > 0").selectExpr("t", "length(t) as own_size", f"explode(sequence(length(t), {longest})) as long_size")
    rows = rows.selectExpr("t", "own_size", "long_size", f"{_edits('long_size', least)} as e")
    rows = rows.selectExpr("t", "own_size", "long_size", "e", "cast(floor(long_size / (e + 1)) as int) as size", "explode(sequence(0, e)) as i")
    rows = rows.selectExpr("t", "own_size", "long_size", "i", "e", "i * size + greatest(0, i - (e + 1 - (long_size - (e + 1) * size))) as start", "if(i >= e + 1 - (long_size - (e + 1) * size), size + 1, size) as long")
    # i edits at most before the segment, or e - i at most behind it, where the texts' ends differ by own_size - long_size
    low, high = "greatest(0, start - i, start + own_size - long_size - (e - i))", "least(own_size - long, start + i, start + own_size - long_size + (e - i))"
    at = rows.selectExpr("t", "long_size", "i", "long", f"{low} as low", f"{high} as high").filter("low <= high")
    return at.selectExpr("t", "long_size", "i", "long", "explode(sequence(low, high)) as p").selectExpr("t", "long_size", "i", "substring(t, p + 1, long) as s").distinct()


def edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, similarity): every pair of a text of `left` and one of `right` at least so alike, once.

    Nulls match nothing; an empty text is like an empty one only.  0 < least <= 1.
    """
    if not 0 < least <= 1:
        raise ValueError(f"similarity {least} is not above 0 and up to 1")
    ours, theirs = left.select(F.col(a).alias("t")).filter("t is not null").distinct(), right.select(F.col(b).alias("t")).filter("t is not null").distinct()
    on = ["long_size", "i", "s"]
    longer = _segments(ours, least).withColumnRenamed("t", a).join(_probes(theirs, least).withColumnRenamed("t", b), on)
    shorter = _probes(ours, least).withColumnRenamed("t", a).join(_segments(theirs, least).withColumnRenamed("t", b), on)
    met = longer.select(a, b).union(shorter.select(a, b)).distinct()
    empty = ours.filter("t = ''").select(F.col("t").alias(a)).join(theirs.filter("t = ''").select(F.col("t").alias(b)), F.col(a) == F.col(b))
    size = F.greatest(F.length(a), F.length(b))
    near = F.levenshtein(F.col(a), F.col(b))
    found = met.union(empty).withColumn("similarity", F.when(size == 0, 1.0).otherwise(1 - near / size))
    return found.filter(F.col("similarity") >= least - 1e-9)


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    query: str,
    candidate: str,
    name: str,
    evidence: Sequence[str],
    score: Callable[[Column, Column, Column], Column],
    bound: Callable[[float], float],
    k: int = 2,
    rounds: Sequence[float] = ROUNDS,
    agree: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(query, candidate, score): each query's k best candidates but itself, ties to the smaller candidate.

    queries: `query`, `name` and `evidence` columns; candidates: `candidate`,
    `name` and facts.  agree: for each evidence column that is held against
    facts those facts, the first of them being what it may be equal to (if not
    given, each evidence column is held against the one of its name).  score
    takes the name of the query, that of the candidate and the similarity, may
    use the query's evidence and the candidate's facts as `_<column>`, and for
    a similarity below s is at most bound(s).  Of the facts it may see only
    whether the first is equal, unequal or null, and the others where it is
    equal; equality counts no less than null and null no less than inequality,
    and whoever has no evidence sees no difference.
    """
    agree = {c: (c,) for c in evidence} if agree is None else agree
    facts = [c for each in agree.values() for c in each]
    # Of candidates that no score tells apart, a query needs its k best and one more, as it may be one of them itself.
    order = Window.partitionBy(name, *facts).orderBy(candidate)
    few = candidates.filter(F.col(name).isNotNull()).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    few = staged(few.select(F.col(candidate), F.col(name).alias("_name"), *[F.col(c).alias(f"_{c}") for c in facts]), "profiles")
    unknown = few.agg(*[F.coalesce(F.bool_or(F.col(f"_{of[0]}").isNull()), F.lit(False)).alias(c) for c, of in agree.items()]).first().asDict() if agree else {}
    index = staged(_index(few, candidate, agree, k + 1), "candidate-index")
    asked = queries.filter(F.col(name).isNotNull()).select(query, name, *evidence)
    rest = asked.select(name, *evidence).distinct()
    done = None
    for least in [*rounds, None]:
        found = staged(_best(_options(rest, agree, unknown), index, candidate, name, evidence, agree, score, k + 1, least), "likest")
        if least is not None:
            # One of the k + 1 best may be the query itself; what is unseen stays below the bound.
            scores = found.groupBy(name, *evidence).agg(F.sort_array(F.collect_list("score"), asc=False).alias("_s"))
            settled = scores.filter((F.size("_s") > k) & (F.get("_s", k) > bound(least))).drop("_s")
            alike = _alike(name, *evidence)
            found = found.alias("x").join(settled.alias("y"), alike, "left_semi")
            rest = staged(rest.alias("x").join(settled.alias("y"), alike, "left_anti"), "open-queries")
        done = found if done is None else done.unionByName(found)
        if least is not None and rest.isEmpty():
            break
    each = done.alias("x").join(asked.alias("y"), _alike(name, *evidence)).filter(F.col(query) != F.col(candidate)).select(query, candidate, "score")
    w = Window.partitionBy(query).orderBy(F.desc("score"), candidate)
    return each.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def _alike(*columns: str) -> Column:
    """Whether x and y agree in all of them, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns])


#: What is asked of a fact: anything, a value, or that it is null.
_ANY, _EQUAL, _NULL = 0, 1, 2


def _code(digits: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * 3 + b, digits, F.lit(0))


def _index(few: DataFrame, candidate: str, agree: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """The k smallest candidates for every name and every choice of what is asked of the facts: `_code`, `_key_<evidence>` and their facts."""
    masks = few.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit((1 << len(agree)) - 1))))
    kinds, keys, others = [], {}, []
    for i, (c, (first, *more)) in enumerate(agree.items()):
        asked, held = F.col("_m").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"_{first}")
        kinds.append(F.when(asked, F.when(held.isNull(), _NULL).otherwise(_EQUAL)).otherwise(_ANY))
        keys[f"_key_{c}"] = F.when(asked, held)
        others += [F.when(asked, F.col(f"_{x}")) for x in more]
    rows = masks.withColumns({"_code": _code(kinds), **keys})
    w = Window.partitionBy("_name", "_code", *keys, *others).orderBy(candidate)
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place", "_m")


def _options(queries: DataFrame, agree: Mapping[str, Sequence[str]], unknown: Mapping[str, bool]) -> DataFrame:
    """A row for each choice that a query asks the index for; of evidence that it does not have it asks nothing."""
    rows = queries
    for c in agree:
        kinds = [_ANY, _EQUAL, *([_NULL] if unknown[c] else [])]
        rows = rows.withColumn(f"_kind_{c}", F.explode(F.when(F.col(c).isNull(), F.array(F.lit(_ANY))).otherwise(F.array(*map(F.lit, kinds)))))
    rows = rows.withColumns({"_code": _code([F.col(f"_kind_{c}") for c in agree]), **{f"_key_{c}": F.when(F.col(f"_kind_{c}") == _EQUAL, F.col(c)) for c in agree}})
    return rows.drop(*[f"_kind_{c}" for c in agree])


def _best(options: DataFrame, index: DataFrame, candidate: str, name: str, evidence: Sequence[str], agree: Mapping[str, Sequence[str]], score: Callable[[Column, Column, Column], Column], k: int, least: float | None) -> DataFrame:
    """The k best candidates of each query profile among those at least so alike; without `least`, among all.

    A candidate that agrees with the query in some of the evidence is beaten by
    every smaller one of its name that agrees in as much, so one of the k best
    is among the k smallest of what the index has for just this agreement.
    """
    ours, theirs = options.select(name).distinct(), index.select("_name").distinct()
    if least is None:
        spread = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_b")
        pairs = ours.select(name, spread).join(theirs.withColumn("_b", F.pmod(F.xxhash64("_name"), F.lit(BLOCKS)).cast("int")), "_b").drop("_b")
        size = F.greatest(F.length(name), F.length("_name"))
        pairs = pairs.withColumn("similarity", F.when(size == 0, 1.0).otherwise(1 - F.levenshtein(name, "_name") / size))
    else:
        pairs = edit_pairs(ours, theirs, name, "_name", least)
    met = options.join(pairs, name).alias("x").join(index.alias("y"), _alike("_name", "_code", *[f"_key_{c}" for c in agree]))
    told = met.select(F.col("x._name").alias("_name"), name, *evidence, "similarity", candidate, *[f"_{x}" for of in agree.values() for x in of])
    scored = told.select(name, *evidence, candidate, score(F.col(name), F.col("_name"), F.col("similarity")).alias("score")).distinct()
    w = Window.partitionBy(name, *evidence).orderBy(F.desc("score"), candidate)
    return scored.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")
