"""The edit-distance join and the search by score against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import quality, similarity


def names(seed, n, letters="abcd", longest=14):
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, longest))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        word = list(draw.choice(base))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", draw.choice(letters), draw.choice(letters) * 2])
        out.append("".join(word))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("least", [1.0, 0.8, 0.75, 0.5, 0.34, 0.2])
def test_every_pair_at_least_so_alike(spark, least):
    left, right = names(1, 160), [*names(2, 120), *names(1, 40), "", "", None, "x" * 60, "x" * 55 + "y" * 5]
    left += ["", None, "x" * 58]
    found = similarity.edit_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b", least).collect()
    want = {(a, b) for a in set(left) - {None} for b in set(right) - {None} if alike(a, b) >= least - 1e-9}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert all(r.similarity == pytest.approx(alike(r.a, r.b)) for r in found)


def searched(spark, rows, asked, k, rounds=similarity.ROUNDS):
    c = spark.createDataFrame(rows, "candidate int, name string, kind string")
    q = spark.createDataFrame(asked, "query int, name string, kind string")
    extra = quality.evidence(F.col("kind").isNotNull() & F.col("_kind").isNotNull(), F.col("kind") == F.col("_kind"), 0.14, 0.30)
    score = lambda a, b, s: quality.identity_score(a, b, extra, s)
    out = similarity.nearest(q, c, "query", "candidate", "name", ["kind"], score, lambda s: 0.7 * s + 0.14, k, rounds)
    got: dict = {}
    for r in out.orderBy("query", F.desc("score"), "candidate").collect():
        got.setdefault(r.query, []).append((r.candidate, r.score))
    return got


def plain(rows, asked, k):
    out = {}
    for q, name, kind in asked:
        scored = []
        for c, other, other_kind in rows:
            if c != q and name is not None and other is not None:
                extra = 0 if kind is None or other_kind is None else 0.14 if kind == other_kind else -0.30
                base = 0.82 if name == other else 0.70 * alike(name, other)
                scored.append((-round(max(0.0, min(1.0, base + extra)), 6), c))
        if scored:
            out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("rounds", [similarity.ROUNDS, (0.8,), ()])
def test_search_equals_all_pairs(spark, rounds):
    """Near names, far names, equal profiles, missing names and kinds; open queries in every round."""
    draw = random.Random(3)
    rows = [(i, x, draw.choice(["a", "b", None])) for i, x in enumerate([*names(4, 150), *["abab"] * 9, None, "", "zzzz"])]
    asked = [r for r in rows if r[0] % 4 == 0] + [(1000, "qqqqqqqqqqq", "a"), (1001, "abab", "c")]
    want = plain(rows, asked, 3)
    got = searched(spark, rows, asked, 3, rounds)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6), q
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]], q


def test_five_thousand_rows_and_few_of_their_pairs(spark):
    """Names of a wider alphabet: the same best candidates as by comparing all pairs, most of which are not met."""
    rows = [(i, x, "a") for i, x in enumerate(names(5, 5000, "abcdefghijklmnopqrstuvwxyz", 16))]
    asked = [r for r in rows if r[0] % 20 == 0]
    got = searched(spark, rows, asked, 2)
    c, q = spark.createDataFrame(rows, "candidate int, name string, kind string"), spark.createDataFrame(asked, "query int, other string, k string")
    size = F.greatest(F.length("name"), F.length("other"))
    score = quality.identity_score(F.col("other"), F.col("name"), F.lit(0.14))
    every = q.join(c, F.col("query") != F.col("candidate")).select("query", F.struct((-score).alias("s"), "candidate").alias("x"), size)
    best = every.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 2).alias("best")).collect()
    assert {r.query: [(x.candidate, -x.s) for x in r.best] for r in best} == got
    met = similarity._segments(c.select(F.col("name").alias("t")).distinct(), 0.8).join(similarity._probes(q.select(F.col("other").alias("t")).distinct(), 0.8).withColumnRenamed("t", "p"), ["long_size", "i", "s"]).count()
    assert met < 0.01 * len(rows) * len(asked)


def test_of_a_names_many_candidates_a_query_meets_a_few_for_each_agreement(spark):
    """Facts that differ in nearly every row: the same best ones as by all pairs, and no more met as the candidates grow."""
    draw = random.Random(8)
    met = []
    for n in (200, 1600):
        rows = [(i, draw.choice(["anna", "anne"]), draw.choice([None, *map(str, range(n // 4))])) for i in range(n)]
        asked = [r for r in rows if r[0] % 100 == 7] + [(n, "anna", None), (n + 1, "anna", "none")]
        want, got = plain(rows, asked, 3), searched(spark, rows, asked, 3)
        assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items()}
        few = spark.createDataFrame(rows, "candidate int, _name string, _kind string")
        index = similarity._index(few, "candidate", {"kind": ("kind",)}, 4)
        options = similarity._options(spark.createDataFrame([("anna", "3")], "name string, kind string"), {"kind": ("kind",)}, {"kind": True})
        met.append(options.join(index, (F.col("name") == F.col("_name")) & options["_code"].eqNullSafe(index["_code"]) & options["_key_kind"].eqNullSafe(index["_key_kind"])).count())
    assert max(met) <= 12
