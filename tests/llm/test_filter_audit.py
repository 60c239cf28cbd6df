"""The filter audit against every order applied row by row."""

from itertools import permutations

import numpy as np
import pytest

from kairoframe.llm import filter_audit

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, shard int, step int, counts string, id string"


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    seen = []
    for doc_id, text, lang, *_ in docs:
        body = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in body).split(" ") if w]
        fails = {f for f, bad in zip("ABCD", (
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in body) > 10 * len(body),
            any(c in body for c in "#$%&*|"),
        ), strict=True) if bad}
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == body for d, t, *_ in docs):
            fails.add("E")
        seen.append((doc_id, lang or "", fails))
    rows = {}
    for part in {p for _, p, _ in seen}:
        mine = [(d, f) for d, p, f in seen if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                removed_by[name] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name,
                ]
        for (p, _, _), row in rows.items():
            if p == part:
                row[6] = removed_by[row[6]]
    return rows


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(spark, docs, labels):
    table = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], WIDE)
    out = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in out.collect()}


def test_every_order_row_by_row(spark):
    many = " ".join(f"w{i}" for i in range(120))
    texts = [many, many + " #", many.upper(), many + " #", "short", "", None, "a " * 150, LONG, "é" * 30 + " X\x1cY", many, " ".join("ab" * 60)]
    docs = [(i, t, (None, "en", "de", "")[i % 4], "s", 1, "x", 1) for i, t in enumerate(texts)]
    docs += [docs[0], (None, many, "en", None, None, None, None), (-3, "short", "de", None, None, None, None)]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (2, None, 1), (3, 1, None), (4, 1, 0), (None, 1, 1), (99, 1, 1), (10, 1, 0)]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_empty_table(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}


def test_parts_of_any_number_are_added_up(spark, monkeypatch):
    docs = [(i, f"text {i % 7}", f"part{i % 40}", "s", 1, "x", 1) for i in range(400)]
    assert found(spark, docs, []) == plain(docs, [])


@pytest.mark.parametrize("fails", [0, 1, 0b10110, 31])
def test_table_of_first_failures(fails):
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for n, order in enumerate(filter_audit.ORDERS):
        first = next((s for s, f in enumerate(order, 1) if fails >> "ABCDE".index(f) & 1), 0)
        assert table[fails, n] == first


def test_removals_keep_labels_apart():
    counts = np.zeros((4, 32), dtype=np.int64)
    counts[1, 1], counts[2, 2], counts[3, 3], counts[0, 0] = 5, 7, 11, 13
    table = filter_audit.first_failures()
    out = filter_audit.place_counts(counts, np.arange(120) * 6 + table, 720).reshape(3, 120, 6)
    assert out[0].sum(axis=1).tolist() == [36] * 120
    assert out[1].sum(axis=1).tolist() == [16] * 120
    assert out[2].sum(axis=1).tolist() == [18] * 120
