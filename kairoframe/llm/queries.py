"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, filter_audit, katz, language_id, line_dedup, media_chunks, mixing, packing, secrets, simhash, toxicity
from .common import table


def op1_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_read(table(spark, sf_dir, "documents"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")  # noqa: E731
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.digest(F.filter("spans", lambda s: s["kind"] != "learned")), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["bits"])).alias("best_bits"),
    )


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources brought to tempered shares (sizes to the power 0.7) at the corpus' own size."""
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.7, size_factor=1.0, seed=1)


OP4_SQL = """
WITH RECURSIVE size AS (
  SELECT source, CAST(SUM(COALESCE(LENGTH(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), weighed AS (SELECT source, size, POW(size, 0.7) AS weight FROM size),
total AS (SELECT SUM(size) AS size, SUM(weight) AS weight FROM weighed),
rate AS (SELECT w.source, t.size * (w.weight / t.weight) / w.size AS rate FROM weighed w, total t),
cdf(source, rate, k, lp, c) AS (
  SELECT source, rate, 0, -rate, EXP(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, lp + LN(rate) - LN(CAST(k + 1 AS DOUBLE)), c + EXP(lp + LN(rate) - LN(CAST(k + 1 AS DOUBLE)))
  FROM cdf WHERE k < CEIL(rate + 12 * SQRT(rate) + 40)
), curve AS (SELECT source, LIST(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, LEN(LIST_FILTER(curve.cdf, lambda x: x < CAST('0x' || SUBSTR(MD5('count-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))) AS n
  FROM documents d JOIN curve ON d.source IS NOT DISTINCT FROM curve.source
), copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(UNNEST(RANGE(1, n + 1)) AS INTEGER) AS copy FROM drawn)
SELECT *, CAST('0x' || SUBSTR(MD5('place-1:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS shuffle_key
FROM copies
"""


#: A text that looks like the template's own marks.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, LAG(role) OVER o AS before, ROW_NUMBER() OVER o AS n,
    REPLACE(REPLACE(REPLACE(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS safe,
    REPLACE(REPLACE(REPLACE(REPLACE(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\:') AS safe_role
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'tool') THEN role = CASE before WHEN 'system' THEN 'user' ELSE 'assistant' END
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE FALSE END AS fine
  FROM marked
)
SELECT conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY n)) AS turns_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  SHA256(COALESCE(STRING_AGG(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(LENGTH(safe_role) + LENGTH(safe) + 4 + 2 + 8) AS BIGINT) AS formatted_chars,
  BOOL_AND(fine) AS valid, BOOL_AND(fine) AND MAX_BY(role, n) = 'assistant' AS final
FROM judged GROUP BY conv_id
"""


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities for the categories that the labels give, in the chain's order."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    chain = toxicity.train(docs, labels, {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic})
    return toxicity.score(docs, chain).withColumnRenamed("is_toxic", "toxic")


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


OP8_SQL = """
WITH l AS (
  SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, UNNEST(RANGE(LEN(STRING_SPLIT(text, CHR(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, i AS pos, line AS a, LEAD(line) OVER o AS b, LEAD(line, 2) OVER o AS c
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT doc_id, pos, ROW_NUMBER() OVER g AS n, FIRST_VALUE(doc_id) OVER g AS first_doc, FIRST_VALUE(pos) OVER g AS first_pos
  FROM w WHERE c IS NOT NULL AND TRIM(a || b || c, ' ') <> '' WINDOW g AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
), covered AS (
  SELECT DISTINCT doc_id, UNNEST(RANGE(CASE WHEN first_doc = doc_id THEN GREATEST(pos, first_pos + 3) ELSE pos END, pos + 3)) AS i
  FROM f WHERE n > 1
), kept AS (
  SELECT l.doc_id, STRING_AGG(l.line, CHR(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text, COUNT(c.i) AS n
  FROM l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text, CAST(COALESCE(k.n, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    scored = katz.score(table(spark, sf_dir, "documents"), ~katz.held_out())
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(STRING_SPLIT_REGEX(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents
), words AS (SELECT lang, LIST_FILTER(STRING_SPLIT_REGEX(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM words),
spans AS (SELECT lang, m, ARRAY_TO_STRING(w[i:i + m - 1], ' ') AS phrase FROM spots, (SELECT UNNEST(RANGE(1, 6)) AS m) WHERE i + m - 1 <= LEN(w)),
f AS (SELECT lang, phrase, m, COUNT(*) AS a FROM spans GROUP BY lang, phrase, m HAVING COUNT(*) >= 100),
total AS (SELECT lang, SUM(LEN(w)) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, STRING_SPLIT(c.phrase, ' ') AS w FROM f c, (SELECT UNNEST(RANGE(1, 5)) AS k) WHERE k < c.m
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, t.n,
    CAST(1000 AS HUGEINT) * c.a * CAST(t.n AS HUGEINT) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = ARRAY_TO_STRING(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = ARRAY_TO_STRING(c.w[c.k + 1:c.m], ' ') JOIN total t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = s.lang AND x.m > s.m AND 100 * x.a >= 100 * s.a AND CONTAINS(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, CAST(ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text,
    LIST_FILTER(STRING_SPLIT_REGEX(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), bits AS (
  SELECT doc_id, part,
    [LEN(words) < 100, 100 * LEN(LIST_DISTINCT(words)) < 80 * LEN(words),
     100 * LENGTH(REGEXP_REPLACE(text, '[^A-Z]', '', 'g')) > 10 * LENGTH(text), REGEXP_MATCHES(text, '[#$%&*|]'),
     COALESCE(doc_id > MIN(doc_id) OVER (PARTITION BY text), FALSE)] AS fails
  FROM texts
), labelled AS (
  SELECT b.part, b.fails, COALESCE(l.good, FALSE) AS good, COALESCE(l.toxic, FALSE) AS toxic
  FROM bits b LEFT JOIN (SELECT doc_id, BOOL_OR(COALESCE(quality = 1, FALSE)) AS good, BOOL_OR(COALESCE(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id) l ON b.doc_id = l.doc_id
), counts AS (
  SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (WHERE good) AS good, COUNT(*) FILTER (WHERE toxic) AS toxic FROM labelled GROUP BY part, fails
), orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || letter FROM orders, (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT CONTAINS(filter_order, letter)
), steps AS (
  SELECT filter_order, CAST(UNNEST(RANGE(1, 6)) AS INTEGER) AS step FROM orders WHERE LENGTH(filter_order) = 5
), judged AS (
  SELECT c.*, s.filter_order, s.step, ASCII(filter_order[s.step]) - 64 AS filter,
    LIST_BOOL_OR(LIST_TRANSFORM(RANGE(1, s.step), lambda i: c.fails[ASCII(s.filter_order[i]) - 64])) IS TRUE AS gone
  FROM counts c, steps s
), told AS (
  SELECT *, NOT gone AND fails[filter] AS here, fails[filter] AND LEN(LIST_FILTER(fails, lambda f: f)) = 1 AS alone FROM judged
), summed AS (
  SELECT part, filter_order, step, filter, COALESCE(SUM(n) FILTER (WHERE NOT gone AND NOT here), 0) AS kept, COALESCE(SUM(n) FILTER (WHERE here), 0) AS removed,
    COALESCE(SUM(n) FILTER (WHERE gone AND fails[filter]), 0) AS redundant, COALESCE(SUM(n) FILTER (WHERE alone), 0) AS unique_fails,
    COALESCE(SUM(good) FILTER (WHERE here), 0) AS good_lost, COALESCE(SUM(toxic) FILTER (WHERE here), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM summed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": OP4_SQL, "op5_chat_machine": OP5_SQL, "op8_line_windows": OP8_SQL, "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL}
