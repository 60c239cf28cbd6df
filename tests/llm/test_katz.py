"""Katz scores against counts and formulas in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from kairoframe.llm import chunks, katz, queries

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk int, score string, key int"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + [None]


def weights(counts):
    of = Counter(counts.values())
    d = {}
    for c in range(1, 6):
        d[c] = 1.0
        if of[1] and of[c] and 6 * of[6] != of[1]:
            x = ((c + 1) * of[c + 1] / (c * of[c]) - 6 * of[6] / of[1]) / (1 - 6 * of[6] / of[1])
            d[c] = x if 0 < x < 1 else 1.0
    return lambda c: c * d.get(c, 1.0)


class Plain:
    def __init__(self, texts):
        seqs = [tokens(t) for t in texts]
        self.one = Counter(w for s in seqs for w in s)
        self.two = Counter((a, b) for s in seqs for a, b in zip(["<s>", *s], s, strict=False))
        self.n, self.v = sum(self.one.values()), len(self.one)
        w = weights(self.one)
        lost = self.n - sum(map(w, self.one.values()))
        under = self.n if lost > 1e-12 else self.n + 1
        self.p1 = defaultdict(lambda: (lost if lost > 1e-12 else 1) / under, {x: w(c) / under for x, c in self.one.items()})
        self.w2 = weights(self.two)
        self.after = defaultdict(dict)
        for (a, b), c in self.two.items():
            self.after[a][b] = c

    def p(self, b, a):
        seen = self.after.get(a)
        if not seen:
            return self.p1[b]
        total = sum(seen.values())
        lost = sum(c - self.w2(c) for c in seen.values())
        under = total if lost > 1e-12 else total + 1
        if b in seen:
            return self.w2(seen[b]) / under
        return (lost if lost > 1e-12 else 1) / under / (1 - sum(self.p1[x] for x in seen)) * self.p1[b]

    def row(self, text):
        s = tokens(text)
        base = sum(math.log10((self.one.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in s)
        return len(s), sum(w in self.one for w in s), self.n, base, sum(math.log10(self.p(b, a)) for a, b in zip(["<s>", *s], s, strict=False))


def out_of_sample(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def same(found, rows):
    plain = Plain([t for i, t in rows if not out_of_sample(i)])
    key = lambda x: (x[0] is None, x[0] or 0, x[2:])
    want = sorted(((i, not out_of_sample(i), *plain.row(t)) for i, t in rows), key=key)
    got = sorted((tuple(r) for r in found), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"tokens": 5000, "entries": 3000, "chunk": 2000}, {"tokens": 300, "entries": 500, "chunk": 700}])
def test_scores_of_given_documents(spark, sf, sizes):
    """One bucket or many, words dealt to several buckets or not: the same scores."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    model = katz.Katz(docs, ~katz.held_out(), **sizes)
    assert (len(model.sliced[0]) > 0) == (sizes.get("tokens") == 300)
    same(model.scores().collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_defined_cases(spark):
    rows = [(1, "A b a B\x1cc"), (1, "A b a B\x1cc"), (2, None), (3, ""), (None, "a  b\ta\vc"), (4, " ".join(f"w{i % 997} x{i % 13}" for i in range(60_000))), (5, "never seen ünseen")]
    rows += [(i, "the cat sat on the mat " * (i % 4)) for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 1, "x", 1) for r in rows], WIDE)
    same(katz.score(docs, ~katz.held_out()).collect(), rows)


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None, None, None, None)], WIDE)
    [row] = katz.score(docs, katz.F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert katz.score(docs.limit(0), ~katz.held_out()).collect() == []


@pytest.mark.parametrize("sizes", [{}, {"tokens": 300}])
def test_probabilities_sum_to_one(spark, sf, sizes):
    """Over all words, the end and the unseen class, after every word."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    model = katz.Katz(docs, ~katz.held_out(), **sizes)
    known = model.unigrams
    every = katz.np.arange(known.distinct + 1)
    p1 = known.probability(every)
    assert p1.sum() == pytest.approx(1, abs=1e-12)
    after = model.after().filter("n > 0").toPandas()
    assert len(after) > 1000
    for _, seen in after.groupby("before"):
        assert seen.weight.nunique() == 1
        rest = 1 - p1[seen.word].sum()
        assert seen.p.sum() + seen.weight.iloc[0] * rest == pytest.approx(1, abs=1e-9)


def test_held_out_texts_are_better_told_than_by_single_words(spark):
    found = queries.op11_katz_backoff(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum() and len(found) > 100


def test_packed_numbers_and_words_come_back():
    for values in ([], [0], [1, 255, 256], [2**40, 5], [0.5, -1.25]):
        array = katz.np.array(values)
        assert chunks.unpack(chunks.pack(array if len(values) else array.astype(int))).tolist() == values
    for found in ([], [b""], [b"", b"a"], ["é".encode()] * 3):
        assert chunks.unpack_words(chunks.pack_words(found)) == found
