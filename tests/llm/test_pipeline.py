"""The pipeline's stages: columns, decisions, and the whole run."""

import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_similar, check_packing

import corpus_pipeline
from kairoframe.llm import language_id, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    extra = spark.createDataFrame([(10**6, "1234 5678", None, "src0", 9), (10**6 + 1, None, None, None, None)], docs.schema)
    copies = docs.orderBy("doc_id").limit(5).withColumn("doc_id", F.col("doc_id") + 10**7)
    current = docs.unionByName(extra).unionByName(copies)
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(f"file://{tmp_path}/{i}")
        out = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert out.columns == COLUMNS
        counts.append(out.count())
        if i == 0:
            assert out.filter(F.col("doc_id").isin(10**6, 10**6 + 1)).count() == 0
            assert counts[0] == docs.count() + 5
        if i == 2:
            assert out.filter("doc_id >= 10000000").count() == 0
        current = out
    total = current.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert total <= 2048 and counts[2] <= counts[1] <= counts[0]


def brute_kept(rows):
    """Ids that the near-dedup stage keeps, by all pairs of shingle sets."""
    best = brute_similar([(r.doc_id, r.text) for r in rows])
    first: dict = {}
    for i, r in enumerate(rows):
        first.setdefault(best[i], min((x.doc_id for k, x in enumerate(rows) if best[k] == best[i])))
    return sorted(set(first.values()))


def test_stages_equal_brute_force(spark, sf, tmp_path):
    """Each stage against a plain version of it, run on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    copies = docs.orderBy("doc_id").limit(15).withColumn("doc_id", F.col("doc_id") + 10**7).withColumn("text", F.concat("text", F.lit(" one more word")))
    foreign = spark.createDataFrame([(5 * 10**7, "qxz vkwj zzxq " * 30, None, "src0", 420), (5 * 10**7 + 1, "12 34", None, "src0", 5)], docs.schema)
    current = docs.unionByName(copies).unionByName(foreign)
    held = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(f"file://{tmp_path}/{i}")
        held.append((current.collect(), spark.read.parquet(f"file://{tmp_path}/{i}").collect()))
        current = spark.read.parquet(f"file://{tmp_path}/{i}")

    before, after = held[0]  # language: the model's familiar trigrams, letter by letter
    model = language_id.train(docs.unionByName(copies).unionByName(foreign))
    for r in before:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        usual = 0
        for w in words:
            grams = [f"^{w}$"[k : k + 3] for k in range(len(w))]
            usual += len(w) * (sum(g in model.trigrams for g in grams) >= 0.75 * len(grams))
        fine = bool(words) and usual / sum(map(len, words)) >= 0.5
        assert fine == (r.doc_id in {x.doc_id for x in after})

    before, after = held[1]
    lines = dict(brute_lines([(r.doc_id, r.text) for r in before]))
    assert {r.doc_id: r.text for r in after} == {k: t for k, t in lines.items() if t.strip(" ") or t == {r.doc_id: r.text for r in before}[k]}

    before, after = held[2]
    assert sorted(r.doc_id for r in after) == brute_kept(before) and len(after) < len(before)

    before, after = held[3]  # mixing: the inverse of the distribution function, term by term
    size: dict = {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(r.text or "") + 1
    weight = {k: v**0.7 for k, v in size.items()}
    copies_of: dict = {}
    for r in after:
        copies_of[r.doc_id] = copies_of.get(r.doc_id, 0) + 1
    for r in before:
        rate = sum(size.values()) * weight[r.source] / sum(weight.values()) / size[r.source]
        u = int(hashlib.md5(f"count-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        assert copies_of.get(r.doc_id, 0) == k

    before, after = held[4]  # packing: copies of a document are packed one by one
    texts = {r.doc_id: r.text for r in before}
    assert sum(r.length for r in after if r.start == 0) and {r.doc_id for r in after} == set(texts)
    assert sum(r.length for r in after) == sum(next(x.doc_tokens for x in after if x.doc_id == r.doc_id) for r in before)
    one = {k: [r for r in after if r.doc_id == k] for k in texts if copies_of[k] == 1}
    check_packing([r for rows in one.values() for r in rows], {k: texts[k] for k in one}, offsets=False)


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    done = c.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == columns
    assert sorted(str([r[x] for x in columns]) for r in df.collect()) == sorted(str([r[theirs.index(x)] for x in columns]) for r in done.fetchall())
