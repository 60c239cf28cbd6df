"""Line deduplication by overlapping windows of three lines; DataFrame functions only.

Every run of three consecutive lines of a text is a window, known by a
128-bit hash.  A window that occurs more than once anywhere keeps its first
occurrence, in the order of (document id, hash of the text, line number); the
lines that later occurrences cover are removed, overlapping occurrences being
merged.  Where a later occurrence overlaps the first one inside the same text,
the lines of the first stay.

Plan: windows are 16-byte hashes and positions, grouped with partial
aggregation; the repeated ones are a table in the shared folder, so that both
sides of the join that finds their occurrences are plain scans and Spark can
split a passage that very many documents share.  Covered lines are gathered
per document (no more than it has lines) and meet the texts in one hash join,
named so that small and large inputs run alike and texts are not sorted.

Defined cases: a null text stays null; a text of fewer than three lines is
never changed; windows whose lines hold only spaces do not count; rows with
equal id and text are one document and get the same text; a null id sorts
first; an empty table gives an empty result; other columns are kept as they
are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def windows(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, th, pos, w1, w2) for every window of `size` lines."""
    lines = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines")).filter(F.size("lines") >= size)
    hashed = lines.select("id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) != "").alias("full"))).alias("l"))

    def window(i):
        at = [F.get("l", i + k) for k in range(size)]
        full = at[0]["full"]
        for a in at[1:]:
            full = full | a["full"]
        return F.struct(i.alias("pos"), F.xxhash64(*[a["h"] for a in at]).alias("w1"), F.xxhash64(F.lit(size), *[a["h"] for a in at]).alias("w2"), full.alias("full"))

    found = F.transform(F.sequence(F.lit(0), F.size("l") - size), window)
    return hashed.select("id", "th", F.inline(F.filter(found, lambda w: w["full"]))).drop("full")


def dedup_lines(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text replaced and lines_removed (int) added."""
    found = windows(docs, size, key, text)
    first = found.groupBy("w1", "w2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = common.staged(first, "repeated-windows")
    at = F.struct("id", "th", "pos")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = (
        found.join(first.hint("merge"), ["w1", "w2"])
        .filter(at > F.col("first"))
        .select("id", "th", F.when(same, F.greatest("pos", F.col("first.pos") + size)).otherwise(F.col("pos")).alias("lo"), (F.col("pos") + size - 1).alias("hi"))
        .filter("lo <= hi")
    )
    covered = later.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("covered"))
    covered = common.staged(covered.select(F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th"), _mask("covered").alias("_ld_mask")), "covered-lines")
    same_text = docs[key].eqNullSafe(F.col("_ld_id")) & (F.xxhash64(docs[text]) == F.col("_ld_th"))
    joined = docs.join(covered.hint("shuffle_hash"), same_text, "left")
    kept = F.expr(f"filter(split(`{text}`, '\\n', -1), (l, i) -> coalesce(substring(_ld_mask, i + 1, 1) <> X'31', true))")
    renewed = F.when(F.col("_ld_mask").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.length(F.translate(F.col("_ld_mask").cast("string"), "0", "")), F.lit(0))
    return joined.select(*[renewed.alias(text) if c == text else docs[c] for c in docs.columns if c != "lines_removed"], removed.cast("int").alias("lines_removed"))


def _mask(covered: str) -> F.Column:
    """Bytes '0' and '1', one for each line up to the last covered one, from (lo, hi) in the order of lo.

    lo need not rise with hi: it is raised where a window overlaps its own first occurrence.
    """
    return F.expr(
        f"""cast(aggregate(
              {covered},
              named_struct('next', 0, 'mask', ''),
              (s, c) -> named_struct(
                'next', greatest(s.next, c.hi + 1),
                'mask', concat(s.mask, repeat('0', greatest(0, c.lo - s.next)), repeat('1', greatest(0, c.hi - greatest(c.lo, s.next) + 1)))),
              s -> s.mask) as binary)"""
    )
