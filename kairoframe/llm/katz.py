"""Language-model scores of texts by Katz backoff over words.

    P(w | h) = d(c) c(h w) / D(h)            if h w was seen
             = a(h) P(w)                     else
    P(w)     = d(c) c(w) / D                 if w was seen
             = what is left                  for all unseen words together

d are Good-Turing discounts of counts up to five, from the counts of counts
of each order over the whole corpus; larger counts, and counts whose discount
would not lie between 0 and 1, are not discounted.  D(h) is the count of h,
plus one if nothing after h is discounted, so something is always left.
a(h) is what is left after h over the P of the words not seen after h, so
that P(. | h) sums to one exactly over the known words, the end of the text
and the unseen class.  The word before the first is a start mark.

Plan.  Texts are read once, into chunks of numbered words (`chunks`).  Words
are counted by an exchange and ranked by count, frequent ones first, so that
a rank is short and tells its count (a broadcast list of the counts that
occur: N words have at most sqrt(2N) different ones).  Every token then goes,
as (word before, word, document), to a bucket of the word before; buckets are
the partitions of the bigram table, hold about as many tokens each, and are
written once.  A word before that has more than a bucket's share of all
tokens is dealt to several by the next word; only for these (no more than
buckets, and never more than 2^20) are sums over the slices gathered.  Each
bucket evaluates its own tokens and returns one sum for each document.

Defined cases: a null text is empty (its one token is the end); a document
without an id is scored and learned from; repeated rows are documents of
their own, each counted; with nothing to learn from, all tokens are unseen
and both scores are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C
from . import common

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Tokens in a bucket of the bigram table.
TOKENS = 1 << 21
#: At most so many words are dealt to several buckets.
MOST_SLICED = 1 << 20


def words(text: bytes) -> list[bytes]:
    """The words of a text and its end; A to Z in lower case."""
    return [*text.translate(C.LOWER).split(), b""]


def held_out(key: str = "doc_id") -> F.Column:
    """True for the fifth of the ids that the model does not learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[c] for c up to DISCOUNTED, from the numbers of n-grams that occur 1, 2, ... DISCOUNTED + 1 times."""
    n = [0, *counts_of_counts]
    d = np.ones(DISCOUNTED + 1)
    if n[1] == 0:
        return d
    common_share = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
    for c in range(1, DISCOUNTED + 1):
        if n[c] and common_share != 1:
            found = ((c + 1) * n[c + 1] / (c * n[c]) - common_share) / (1 - common_share)
            if 0 < found < 1:
                d[c] = found
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c of each count."""
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


class Unigrams:
    """All that a word's rank tells: ranks run from the most frequent word; then come the unseen class and the start mark."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, starts: int):
        """counts: the different counts, largest first; sizes: how many words have each; starts: texts learned from."""
        self.counts, self.starts = counts.astype(np.int64), starts
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.distinct, self.total = int(self.first[-1]), int((counts * sizes).sum())
        n = dict(zip(counts.tolist(), sizes.tolist(), strict=True))
        self.d = discounts([n.get(c, 0) for c in range(1, DISCOUNTED + 2)])
        mass = discounted(self.counts, self.d)
        lost = float(((self.counts - mass) * sizes).sum())
        under = self.total if lost > 0 else self.total + 1
        self.p = mass / under
        self.p_unseen = (lost if lost > 0 else 1.0) / under
        self.unseen, self.start = self.distinct, self.distinct + 1

    def _class(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, np.minimum(ranks, max(self.distinct - 1, 0)), "right") - 1

    def count(self, ranks: np.ndarray) -> np.ndarray:
        """Occurrences of each word; of the start mark, the texts; of the unseen class, 0."""
        known = ranks < self.distinct
        out = np.where(ranks == self.start, self.starts, 0)
        out[known] = self.counts[self._class(ranks[known])]
        return out

    def probability(self, ranks: np.ndarray) -> np.ndarray:
        out = np.full(len(ranks), self.p_unseen)
        known = ranks < self.distinct
        out[known] = self.p[self._class(ranks[known])]
        return out


def _mixed(values: np.ndarray) -> np.ndarray:
    h = (values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def slices(count: np.ndarray, total: int, buckets: int) -> np.ndarray:
    """Over how many buckets the bigrams of a word with this count are dealt."""
    return 1 + count.astype(np.float64) * min(buckets, MOST_SLICED) // max(total, 1)


def bucket_of(before: np.ndarray, word: np.ndarray, count: np.ndarray, total: int, buckets: int) -> np.ndarray:
    piece = _mixed(word) % slices(count, total, buckets).astype(np.uint64)
    return (_mixed(_mixed(before) + piece) % np.uint64(buckets)).astype(np.int64)


class Katz:
    """A model of the texts that `learned` marks, and the scores of all texts.

    `words` and `bigrams` are its tables, in the shared folder, a row for each
    bucket; `scores()` has a row for each document.
    """

    def __init__(self, docs: DataFrame, learned: F.Column, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, entries: int = C.ENTRIES, chunk: int = C.TOKENS):
        self.spark, self.key, self.key_type = docs.sparkSession, key, docs.schema[key].dataType.simpleString()
        self.chunks = common.staged(C.build(docs, text, words, key, learned, most=chunk), "katz-chunks")
        size = self.chunks.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
        self.word_buckets = max(1, -(-(size.distinct or 0) // entries))
        self.buckets = max(1, -(-(size.tokens or 0) // tokens))
        self.words = common.staged(C.count_words(self.chunks, self.word_buckets), "katz-words")
        self.unigrams, ranks = self._ranked()
        self.known = common.Shipped(self.spark, self.unigrams)
        self.bigrams = common.staged(self._bigrams(ranks), "katz-bigrams")
        common.release(ranks)
        self.d, self.sliced = self._discounts()

    # ------------------------------------------------------------- unigrams

    def _ranked(self) -> tuple[Unigrams, DataFrame]:
        """The unigram model, and each chunk's ranks: (chunk, bucket, ranks)."""
        having = self.words.select("bucket", F.inline(F.arrays_zip(F.col("values").alias("count"), F.col("sizes").alias("n")))).filter("count > 0")
        end = self.words.filter(F.col("bucket") == C.dealt([b""], "", self.word_buckets)[1].argmax()).select("words", "counts").collect()
        starts = next((int(C.unpack(r["counts"])[C.unpack_words(r["words"]).index(b"")]) for r in end), 0)
        found = having.groupBy("count").agg(F.sum("n").alias("n")).orderBy(F.desc("count")).collect()
        unigrams = Unigrams(np.array([r["count"] for r in found], dtype=np.int64), np.array([r["n"] for r in found], dtype=np.int64), starts)
        so_far = Window.partitionBy("count").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = having.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).groupBy("bucket").agg(F.collect_list(F.struct("count", "before")).alias("before"))
        known = common.Shipped(self.spark, unigrams)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = known.value
            first = dict(zip(model.counts.tolist(), model.first.tolist(), strict=False))
            for b in batches:
                for row in b.to_pylist():
                    counts, offset = C.unpack(row["counts"]), {x["count"]: x["before"] for x in row["before"] or ()}
                    ranks = np.full(len(counts), model.unseen, dtype=np.int64)
                    order = np.argsort(counts, kind="stable")
                    for c, at in zip(*(x.tolist() for x in np.unique(counts[order], return_index=True)), strict=True):
                        if c:
                            same = order[at : np.searchsorted(counts[order], c, "right")]
                            ranks[same] = first[c] + offset[c] + np.arange(len(same))
                    out = list(C.told(row, ranks))
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in out], pa.int64()), "bucket": pa.array([row["bucket"]] * len(out), pa.int64()), "ranks": pa.array([C.pack(r) for _, r in out], pa.binary())})

        told = self.words.join(before, "bucket", "left").select("bucket", "counts", "chunks", "places", "lengths", "before")
        return unigrams, common.staged(told.mapInArrow(tell, "chunk bigint, bucket bigint, ranks binary"), "katz-ranks")

    # -------------------------------------------------------------- bigrams

    def _bigrams(self, ranks: DataFrame) -> DataFrame:
        """A row for each bucket: its bigrams with their counts, and where each occurs."""
        known, buckets, word_buckets = self.known, self.buckets, self.word_buckets

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            model, out = known.value, []
            for row in left.to_pylist():
                rank = C.heard(C.unpack_words(row["words"]), "", word_buckets, [(x["bucket"], x["ranks"]) for x in right.to_pylist()])
                word, sizes = rank[C.unpack(row["ids"])], C.unpack(row["sizes"])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                before = np.concatenate([[model.start], word[:-1]])
                before[np.cumsum(sizes) - sizes] = model.start
                count = model.count(word)
                base = np.bincount(doc, np.log10((count + 0.5) / (model.total + 0.5 * (model.distinct + 1))), len(sizes))
                plain = {"base": C.pack(base), "n_known": C.pack(np.bincount(doc[count > 0], minlength=len(sizes)))}
                bucket = bucket_of(before, word, model.count(before), model.total, buckets)
                order = np.lexsort((word, before, bucket))
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                for k, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if a == z and k:
                        continue
                    at = order[a:z]
                    out.append({"bucket": k, "chunk": row["chunk"], "docs": len(sizes), "flags": row["flags"], "before": C.pack(np.diff(before[at], prepend=0)), "word": C.pack(word[at]), "doc": C.pack(doc[at])} | (plain if not k else {"base": None, "n_known": None}))
            return pa.Table.from_pylist(out, schema=pa.schema([(n, pa.int64() if n in ("bucket", "chunk", "docs") else pa.binary()) for n in ("bucket", "chunk", "docs", "flags", "before", "word", "doc", "base", "n_known")]))

        def count(key: tuple, table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            docs = np.array([r["docs"] for r in rows])
            first = np.cumsum(docs) - docs
            learned = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["docs"]) for r in rows])
            before = np.concatenate([np.cumsum(C.unpack(r["before"])) for r in rows])
            word = np.concatenate([C.unpack(r["word"]) for r in rows])
            doc = np.concatenate([C.unpack(r["doc"]) + f for r, f in zip(rows, first, strict=True)])
            order = np.lexsort((doc, word, before))
            before, word, doc = before[order], word[order], doc[order]
            new = np.ones(len(word), dtype=bool)
            new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
            at = np.flatnonzero(new)
            counts = np.add.reduceat(learned[doc].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            return pa.table({
                "bucket": pa.array([key[0].as_py()], pa.int64()), "before": [C.pack(np.diff(before[at], prepend=0))], "word": [C.pack(word[at])], "counts": [C.pack(counts)],
                "uses": [C.pack(np.diff(np.append(at, len(word))))], "docs": [C.pack(doc)],
                "having": pa.array([np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()], pa.list_(pa.int64())),
                "chunks": pa.array([[{"chunk": r["chunk"], "docs": r["docs"], "base": r["base"], "n_known": r["n_known"]} for r in rows]], pa.list_(pa.struct([("chunk", pa.int64()), ("docs", pa.int64()), ("base", pa.binary()), ("n_known", pa.binary())]))),
            })

        asked = self.chunks.select("chunk", "flags", "sizes", "ids", "words").groupBy("chunk").cogroup(ranks.groupBy("chunk"))
        sent = asked.applyInArrow(send, "bucket bigint, chunk bigint, docs bigint, flags binary, before binary, word binary, doc binary, base binary, n_known binary")
        schema = "bucket bigint, before binary, word binary, counts binary, uses binary, docs binary, having array<bigint>, chunks array<struct<chunk: bigint, docs: bigint, base: binary, n_known: binary>>"
        return sent.groupBy("bucket").applyInArrow(count, schema)

    def _discounts(self) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The bigrams' discounts, and the sums over words after the words that are dealt to several buckets."""
        n = self.bigrams.agg(*[F.sum(F.col("having")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 1)]).first()
        d = discounts([x or 0 for x in n])
        known, buckets = self.known, self.buckets

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = known.value
            for b in batches:
                for row in b.to_pylist():
                    before, lost, p = sums_after(model, d, row)[:3]
                    hot = slices(model.count(before), model.total, buckets) > 1
                    yield pa.RecordBatch.from_pydict({"before": before[hot], "lost": lost[hot], "p": p[hot]})

        found = self.bigrams.select("before", "word", "counts").mapInArrow(partial, "before bigint, lost double, p double")
        rows = found.groupBy("before").agg(F.sum("lost"), F.sum("p")).orderBy("before").collect()
        return d, tuple(np.array([r[i] for r in rows]) for i in range(3))

    # --------------------------------------------------------------- scores

    def after(self) -> DataFrame:
        """The bigram table in rows: word before, word (as ranks), count, probability; backoff weight of the word before."""
        known, d, sliced = self.known, self.d, common.Shipped(self.spark, self.sliced)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    before, word, counts, p, weight = evaluated(known.value, d, sliced.value, row)
                    yield pa.RecordBatch.from_pydict({"before": before, "word": word, "n": counts, "p": p, "weight": weight})

        return self.bigrams.select("before", "word", "counts").mapInArrow(decode, "before bigint, word bigint, n bigint, p double, weight double")

    def scores(self) -> DataFrame:
        """(key, learned, n_tokens, n_known, train_tokens, base_score, score), a row for each document."""
        known, d, sliced = self.known, self.d, common.Shipped(self.spark, self.sliced)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    p = evaluated(known.value, d, sliced.value, row)[3]
                    docs = np.array([c["docs"] for c in row["chunks"]])
                    score = np.bincount(C.unpack(row["docs"]), np.repeat(np.log10(p), C.unpack(row["uses"])), docs.sum())
                    parts = np.split(score, np.cumsum(docs)[:-1])
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([c["chunk"] for c in row["chunks"]], pa.int64()), "score": pa.array([C.pack(x) for x in parts], pa.binary()),
                        **{n: pa.array([c[n] for c in row["chunks"]], pa.binary()) for n in ("base", "n_known")},
                    })

        def gather(left: pa.Table, right: pa.Table) -> pa.Table:
            model, row, sums = known.value, left.to_pylist()[0], right.to_pylist()
            plain = next(x for x in sums if x["base"] is not None)
            sizes = C.unpack(row["sizes"])
            return pa.table({
                "key": left["keys"].combine_chunks().flatten(), "learned": pa.array(np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(sizes)).astype(bool)),
                "n_tokens": sizes, "n_known": C.unpack(plain["n_known"]), "train_tokens": np.full(len(sizes), model.total, np.int64),
                "base_score": C.unpack(plain["base"]), "score": sum(C.unpack(x["score"]) for x in sums),
            })

        sums = self.bigrams.mapInArrow(weigh, "chunk bigint, score binary, base binary, n_known binary")
        both = self.chunks.select("chunk", "keys", "flags", "sizes").groupBy("chunk").cogroup(sums.groupBy("chunk"))
        found = both.applyInArrow(gather, f"key {self.key_type}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        return found.withColumnRenamed("key", self.key)


def sums_after(model: Unigrams, d: np.ndarray, row: dict) -> tuple[np.ndarray, ...]:
    """For each word before in a bucket's row: what discounts take from its count and the P of the words seen after it.

    Also the words before by bigram (as places among them), the words and their counts.
    """
    before, word, counts = np.cumsum(C.unpack(row["before"])), C.unpack(row["word"]), C.unpack(row["counts"])
    unique, place = np.unique(before, return_inverse=True)
    lost = np.bincount(place, counts - discounted(counts, d), len(unique))
    p = np.bincount(place, np.where(counts > 0, model.probability(word), 0.0), len(unique))
    return unique, lost, p, place, word, counts


def evaluated(model: Unigrams, d: np.ndarray, sliced: tuple[np.ndarray, ...], row: dict) -> tuple[np.ndarray, ...]:
    """Word before, word, count, P(word | before) and backoff weight of the word before, for each bigram of a bucket's row."""
    unique, lost, seen, place, word, counts = sums_after(model, d, row)
    if len(sliced[0]) and len(unique):
        at = np.minimum(np.searchsorted(sliced[0], unique), len(sliced[0]) - 1)
        whole = sliced[0][at] == unique
        lost[whole], seen[whole] = sliced[1][at[whole]], sliced[2][at[whole]]
    total = model.count(unique)
    some = lost > 0
    under = np.where(some, total, total + 1)
    weight = np.where(total > 0, np.where(some, lost, 1.0) / under / np.maximum(1.0 - seen, 1e-300), 1.0)
    p = np.where(counts > 0, discounted(counts, d) / under[place], weight[place] * model.probability(word))
    return unique[place], word, counts, p, weight[place]


def score(docs: DataFrame, learned: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Katz scores of all texts by a model of those that `learned` marks; see `Katz.scores`."""
    return Katz(docs, learned, key, text).scores()
