"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import pytest

from kairoframe.llm import collocations

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk int, a string, size int"


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def plain(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in cut(text):
            n[lang or "und"] += len(piece)
            f.update((lang or "und", tuple(piece[i : i + m])) for m in range(1, longest + 1) for i in range(len(piece) - m + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = []
    for lang in sorted({k[0] for k in f}):
        mine = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1}
        scored = []
        for p, a in mine.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in mine.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 1, "x", 1) for i, (t, lang) in enumerate(rows)], WIDE)
    return sorted(tuple(r) for r in collocations.mine(docs, **how).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = ["a", "b", "ab", "B", "é", "c" * 40, "x\x1cy", "d'", "\x00"]
    texts = [("".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", " ", ". ", "\n"]) for _ in range(draw.randrange(60))), draw.choice(["en", "de", None, "und", "e"])) for _ in range(120)]
    return texts + [(None, "en"), ("", "en"), ("a b", None), (" ".join(["a b ab"] * 30_000), "long"), *[("The cat, the CAT sat", "en")] * 30]


@pytest.mark.parametrize("how", [{}, {"chunk": 500, "entries": 20}, {"chunk": 3000, "cells": 50}, {"cells": 3}, {"longest": 2}, {"longest": 3, "top": 4}])
def test_all_phrases_counted(spark, rows, how):
    """Whatever the chunks and however small the sketch: the same phrases and numbers."""
    want = plain(rows, 12, how.get("longest", 5), how.get("top", 2000))
    assert len(want) > (15 if "top" in how else 40)
    assert mined(spark, rows, least=12, **how) == sorted(want)


def test_one_occurrence_decides(spark):
    rows = [("one two three", "en")] * 99
    assert mined(spark, rows) == []
    [row] = mined(spark, [*rows, ("zero one two three four", "en")])
    assert row[2:] == ("one two three", 100, 100, 100, 302, 3020)


def test_empty_table_and_numbers_beyond_64_bits(spark):
    docs = spark.createDataFrame([], WIDE)
    assert collocations.mine(docs).collect() == []
    got = spark.sql("select cast(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) as decimal(38, 0)) * 1000 div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as s from values (3000000000000L, 90000000000000L, 5000000000000L, 7000000000007L) as t(a, n, l, r)").first().s
    assert got == 3 * 10**12 * 9 * 10**13 * 1000 // (5 * 10**12 * 7000000000007)


def test_sketch_never_drops_a_candidate(spark, rows):
    """With three cells nothing is dropped, with many nearly all that is rare; the frequent ones stay in both."""
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 1, "x", 1) for i, (t, lang) in enumerate(rows)], WIDE)
    wide, narrow = (sorted(collocations.candidates(docs, least=12, cells=n)[0].collect()) for n in (1 << 16, 3))
    assert wide == narrow and len(wide) > 60
