"""Packing token sequences into windows by non-negative least squares.

1. Texts become token ids, an end id last, and are written to the shared
   folder.  A document of n ids gives n div W full windows and a rest of
   n mod W ids.
2. The histogram of the rests, in classes of `unit` ids (W / unit classes,
   whatever the input), is fitted by combinations of at most `depth` classes
   that fill a window: non-negative least squares (Lawson and Hanson) for how
   often to use each, rounded down.
3. What is left is packed greedily: largest class first, then the largest
   that still fits, as long as such a pattern fills `least_fill` of a window;
   the remaining rests are laid end to end and cut at window borders.
4. A rest's number within its class tells the window and the place.  Numbers
   are counted in buckets of about `bucket_rows` rows, so one class that holds
   a third of all rows is not numbered by one task.

Ids are kept as two bytes where the vocabulary's size allows it, else as four;
a document's ids move once, to meet its placement.

The public vocabulary comes in two forms, JSON for `tokenizers` and the same
merges as ranks for `tiktoken`.  The ids are those of the JSON form; the ranks
give the same ones three times as fast (5.4 against 1.8 MB a second): both
forms split a text by the same pattern into pieces, start from the bytes of a
piece and merge the adjacent pair of least rank until none is left, and ranks
and merges are in the same order.  Tests compare them over whole texts.

Defined cases: a null or empty text is its end id alone; repeated rows are
separate documents; ids need not be unique or present; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


# -------------------------------------------------------------- tokenizing


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary in two forms: tokenizers' JSON and the same as ranks.

    The ranks are several times faster and give the same ids; the JSON form is
    used where the fast one fails on a text.
    """

    json_path: str
    ranks_path: str
    pattern: str
    special: dict[str, int] = field(default_factory=dict)
    size: int = 1 << 32

    @staticmethod
    def public(name: str = "byte_bpe_50k") -> "Vocabulary":
        import public_tokenizers

        return Vocabulary(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, 50257)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a special token's string in it gives that token, as tokenizers does it."""
        for string, number in self.special.items():
            if string in text:
                parts = [self.encode(part) for part in text.split(string)]
                return np.concatenate([x for part in parts for x in (part, np.array([number], np.uint32))][:-1])
        cache = common.process_cache()
        fast = cache.get(("ranks", self.ranks_path))
        if fast is None:
            import tiktoken

            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = cache["ranks", self.ranks_path] = tiktoken.Encoding(self.ranks_path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except Exception:  # noqa: BLE001  its matcher gives up on some very long runs
            slow = cache.get(("json", self.json_path))
            if slow is None:
                from tokenizers import Tokenizer

                slow = cache["json", self.json_path] = Tokenizer.from_file(self.json_path)
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def tokenized(docs: DataFrame, vocabulary: Vocabulary, end_id: int, key: str, text: str) -> DataFrame:
    """Staged (row, key, n, ids): ids are unsigned little-endian numbers, as wide as `width` says."""
    kind = dict(docs.dtypes)[key]
    dtype = width(vocabulary, end_id)

    def run(batches):
        for rows in batches:
            ids = [np.append(vocabulary.encode(t or ""), np.uint32(end_id)) for _, t in rows]
            yield {key: [k for k, _ in rows], "n": [len(x) for x in ids], "ids": [x.astype(dtype).tobytes() for x in ids]}

    out = common.map_rows(docs.select(key, text), run, f"{key} {kind}, n bigint, ids binary")
    return common.staged(out.withColumn("row", F.monotonically_increasing_id()), "tokens")


def width(vocabulary: Vocabulary, end_id: int) -> str:
    return "<u2" if max(vocabulary.size - 1, end_id) <= 0xFFFF else "<u4"


# -------------------------------------------------------------- the fitting


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that makes a @ x close to b in the least-squares sense (Lawson and Hanson)."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds or 3 * m):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= 1e-9 * (1 + abs(b).max()):
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            gram = a[:, at].T @ a[:, at]
            s = np.linalg.lstsq(gram + 1e-10 * np.eye(len(at)), a[:, at].T @ b, rcond=None)[0] if len(at) < 3 else np.linalg.solve(gram + 1e-8 * np.eye(len(at)), a[:, at].T @ b)
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = min(1.0, (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min())
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low][:1]
            x[gone] = 0
            passive[gone] = False
    return x


def combinations(present: list[int], total: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most `depth` of the present numbers that add up to total."""
    have, out = set(present), []

    def extend(prefix: tuple[int, ...], left: int, most: int) -> None:
        if left in have and left <= most:
            out.append((*prefix, left))
        if len(prefix) + 2 <= depth:
            for k in present:
                if k <= most and k < left and (depth - len(prefix)) * k >= left:
                    extend((*prefix, k), left - k, k)

    extend((), total, total)
    return out


def plan(histogram: dict[int, int], classes: int, depth: int = 3, least_fill: float = 0.99) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (classes in a window, largest first) and how often to use each; never more than the histogram has."""
    left = dict(histogram)
    present = sorted((k for k, v in left.items() if v), reverse=True)
    combos = combinations(present, classes, depth)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        counts = {k: pattern.count(k) for k in pattern}
        times = min(times, *(left[k] // m for k, m in counts.items()))
        if times > 0:
            out.append((pattern, times))
            for k, m in counts.items():
                left[k] -= m * times

    if combos:
        row = {k: i for i, k in enumerate(present)}
        a = np.zeros((len(present), len(combos)))
        for c, combo in enumerate(combos):
            for k in combo:
                a[row[k], c] += 1
        x = nnls(a, np.array([histogram[k] for k in present], dtype=float))
        for c in np.argsort(-x, kind="stable"):
            if x[c] < 1:
                break
            use(combos[c], int(x[c]))
    for _ in range(4 * classes):  # each pattern uses up a class
        pattern: list[int] = []
        room, spare = classes, dict(left)
        for k in present:
            while spare[k] > 0 and k <= room:
                pattern.append(k)
                room -= k
                spare[k] -= 1
        if classes - room < least_fill * classes:
            break
        use(tuple(pattern), 1 << 62)
    return out


# ---------------------------------------------------------------- placement


def _placed(rests: DataFrame, window: int, unit: int, depth: int, least_fill: float, bucket_rows: int) -> tuple[DataFrame, int, int]:
    """Staged (row, full, full_at, seq, offset, left_at) for rows (row, n), and the numbers of full and planned windows.

    full_at is the number of the first full window; a rest has seq and offset,
    or left_at, its place in the line of those that are cut.
    """
    spark = rests.sparkSession
    total = rests.count()
    buckets = total // bucket_rows + 1
    base = rests.select("row", F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest"), F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    base = base.withColumn("class", F.ceil(F.col("rest") / unit).cast("int"))
    counts = common.staged(base.groupBy("class", "bucket").agg(F.count("*").alias("n")), "class-counts")
    histogram = {r[0]: r[1] for r in counts.filter("class > 0").groupBy("class").agg(F.sum("n")).collect()}
    patterns = plan(histogram, window // unit, depth, least_fill)
    slots, used, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in patterns:
        place = 0
        for k in dict.fromkeys(pattern):
            m = pattern.count(k)
            slots.append((k, used[k], used[k] + m * times, m, first, place))
            used[k] += m * times
            place += m
        first += times
    slot_table = spark.createDataFrame(slots, "class int, lo bigint, hi bigint, m bigint, first bigint, place bigint")  # as many rows as classes and patterns allow
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")).hint("merge")  # grows with the input
    inside = Window.partitionBy("class", "bucket").orderBy("row")
    ranked = base.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["class", "bucket"]).withColumn("k", F.col("k") + F.col("skip")).drop("skip")
    slot_table = F.broadcast(slot_table.withColumnRenamed("class", "c"))
    seated = ranked.join(slot_table, (F.col("class") == F.col("c")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")), "left").select(
        "row", "bucket", "full", "rest", F.expr("first + (k - lo) div m").alias("seq"), F.expr("place + (k - lo) % m").alias("place")
    )
    seated = common.staged(seated, "seats")
    loose = F.when(F.col("seq").isNull(), F.col("rest")).otherwise(F.lit(0))
    sums = common.staged(seated.groupBy("bucket").agg(F.sum("full").alias("f"), F.sum(loose).alias("l")), "bucket-sums")
    full_windows = sums.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    skips = _skipped(sums).hint("merge")
    line = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lined = seated.withColumns({"_f": F.coalesce(F.sum("full").over(line), F.lit(0)), "_l": F.coalesce(F.sum(loose).over(line), F.lit(0))}).join(skips, "bucket")
    mates = Window.partitionBy("seq", "_alone").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.when(F.col("seq").isNull(), F.col("row"))  # rests without a window do not meet
    placed = lined.withColumn("_alone", alone).select(
        "row", "full", "rest", (F.col("fs") + F.col("_f")).alias("full_at"), "seq", F.coalesce(F.sum("rest").over(mates), F.lit(0)).alias("offset"), F.when(F.col("seq").isNull(), F.col("ls") + F.col("_l")).alias("left_at")
    )
    return common.staged(placed, "placement"), full_windows, first


def _skipped(sums: DataFrame, group: int = 1000) -> DataFrame:
    """(bucket, fs, ls): the sums of f and l over all earlier buckets, in two steps: within a group of buckets, and of groups."""
    in_group = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row for each `group` buckets
    so_far = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    grouped = sums.withColumn("g", (F.col("bucket") / group).cast("bigint"))
    groups = grouped.groupBy("g").agg(F.sum("f").alias("f"), F.sum("l").alias("l")).select("g", so_far("f", earlier).alias("gf"), so_far("l", earlier).alias("gl"))
    inside = grouped.select("g", "bucket", so_far("f", in_group).alias("f"), so_far("l", in_group).alias("l"))
    return inside.join(groups, "g").select("bucket", (F.col("f") + F.col("gf")).alias("fs"), (F.col("l") + F.col("gl")).alias("ls"))


def pack(docs: DataFrame, window: int = 2048, vocabulary: Vocabulary | None = None, end_id: int = 1, unit: int = 8, depth: int = 3, least_fill: float = 0.99, bucket_rows: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    The pieces of a document cover its ids without a gap or overlap, and the
    pieces of a sequence lie end to end from offset 0; no sequence is longer
    than the window.
    """
    vocabulary = vocabulary or Vocabulary.public()
    dtype = width(vocabulary, end_id)
    tokens = tokenized(docs, vocabulary, end_id, key, text)
    placed, full_windows, planned = _placed(tokens.select("row", "n"), window, unit, depth, least_fill, bucket_rows)
    w, f, p = window, full_windows, planned
    pieces = F.expr(
        f"""concat(
          transform(sequence(0, full), i -> named_struct('start', i * {w}, 'length', if(i < full, {w}L, 0L), 'sequence_id', full_at + i, 'offset', 0L)),
          array(named_struct('start', full * {w}, 'length', if(seq IS NULL, least(rest, {w} - left_at % {w}), rest),
                             'sequence_id', if(seq IS NULL, {f + p} + left_at div {w}, {f} + seq), 'offset', if(seq IS NULL, left_at % {w}, offset))),
          array(named_struct('start', full * {w} + least(rest, {w} - left_at % {w}), 'length', if(seq IS NULL, greatest(0L, rest - ({w} - left_at % {w})), 0L),
                             'sequence_id', {f + p} + left_at div {w} + 1, 'offset', 0L)))"""
    )
    cut = placed.select("row", F.filter(pieces, lambda x: x["length"] > 0).alias("pieces"))
    joined = tokens.join(cut, "row").select(key, "n", "ids", "pieces")
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for rows in batches:
            out: dict[str, list] = {x: [] for x in (key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for k, n, ids, parts in rows:
                ids = np.frombuffer(ids, dtype=dtype).astype("<u4")
                for x in parts:
                    out[key].append(k)
                    out["ids"].append(ids[x["start"] : x["start"] + x["length"]].tobytes())
                    out["doc_tokens"].append(n)
                    for c in ("start", "length", "sequence_id", "offset"):
                        out[c].append(x[c])
            yield out

    return common.map_rows(joined, run, f"{key} {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
