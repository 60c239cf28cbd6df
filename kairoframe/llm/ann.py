"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several
full-dimensional codebooks.  Codebooks start as residual k-means and are then
refitted together by least squares; codes are found by beam search over the
codebooks.  With the stored norm of the approximation y, the distance to a
query q is |q|^2 + |y|^2 - 2 q.y, and q.y is a sum of table lookups.  The best
of each shard by that score are ranked again by exact Euclidean distance.

The index holds every row that takes part.  Shards have about `shard_rows`
rows whatever the input, and each contributes its own shortlist, so the share
of the rows that is ranked exactly (`shortlist / shard_rows`), and with it the
recall, does not fall as tables grow.  Queries go over the shards in blocks of
at most `block` queries; a block is the only thing broadcast.

Defined cases: vectors that are null, zero, or hold a null or a non-finite
component take no part, neither as queries nor as candidates; a null id takes
no part; vectors of several dimensions are searched among those of their own;
each row is a query and a candidate by itself, so rows that repeat an id are
each other's candidates and each has its own result; ties go to the smaller
id; fewer candidates than k give fewer rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


class Quantiser:
    """Additive codebooks of shape (books, words, dimension)."""

    def __init__(self, books: np.ndarray, beam: int = 4):
        self.books, self.beam = books.astype(np.float32), beam

    @staticmethod
    def fit(x: np.ndarray, n_books: int = 32, n_words: int = 64, beam: int = 8, rounds: int = 2, seed: int = 5) -> "Quantiser":
        rng = np.random.default_rng(seed)
        residual, books = x.astype(np.float32), []
        for _ in range(n_books):
            words = residual[rng.choice(len(x), n_words, replace=len(x) < n_words)].copy()
            for _ in range(8):
                near = _nearest(residual, words)
                sums = np.zeros_like(words)
                np.add.at(sums, near, residual)
                counts = np.bincount(near, minlength=n_words)
                words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
            residual = residual - words[_nearest(residual, words)]
            books.append(words)
        q = Quantiser(np.stack(books), beam)
        for _ in range(rounds):  # least squares for all codewords at once, given the codes
            codes = q.encode(x)
            hot = np.zeros((len(x), n_books * n_words), dtype=np.float32)
            hot[np.arange(len(x))[:, None], codes + np.arange(n_books) * n_words] = 1
            solved = np.linalg.solve((hot.T @ hot).astype(np.float64) + 0.1 * np.eye(hot.shape[1]), hot.T @ x)
            q = Quantiser(solved.reshape(n_books, n_words, -1), beam)
        return q

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: after each codebook the `beam` best partial sums of each row stay."""
        n, d = x.shape
        out = np.empty((n, len(self.books)), dtype=np.int64)
        for start in range(0, n, 1024):
            rows = x[start : start + 1024].astype(np.float32)
            residual, codes = rows[:, None, :], np.zeros((len(rows), 1, 0), dtype=np.int64)
            for words in self.books:
                error = (residual**2).sum(axis=2)[:, :, None] - 2 * (residual.reshape(-1, d) @ words.T).reshape(len(rows), -1, len(words)) + (words**2).sum(axis=1)
                flat = error.reshape(len(rows), -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = np.divmod(best, len(words))
                at = np.arange(len(rows))[:, None]
                residual = residual[at, parent] - words[word]
                codes = np.concatenate([codes[at, parent], word[:, :, None]], axis=2)
            best = (residual**2).sum(axis=2).argmin(axis=1)
            out[start : start + len(rows)] = codes[np.arange(len(rows)), best]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): the rows that take part, v an array of doubles."""
    v = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, key: str, sample: int = 4000, shard_rows: int = 4096) -> tuple[DataFrame, Quantiser]:
    """Staged index (shard, row, key, v, codes, norm) of every row of rows (row, key, v; of one dimension), and the quantiser.

    The quantiser is fitted on at most `sample` rows, those first by a hash.
    """
    n = rows.count()
    order = F.xxhash64(F.lit("fit"), "row")
    picked = rows.filter(F.pmod(order, F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * sample / n)).orderBy(order).limit(sample).select("v").collect()
    x = np.array([r[0] for r in picked])
    quantiser = Quantiser.fit(x, n_words=min(64, max(2, len(x) // 32)))
    held = common.Shipped(rows.sparkSession, quantiser)
    kind = dict(rows.dtypes)[key]

    def encode(batches):
        for part in batches:
            v = np.array([r[2] for r in part])
            codes = held.value.encode(v)
            norm = (held.value.decode(codes).astype(np.float64) ** 2).sum(axis=1)
            yield {"row": [r[0] for r in part], key: [r[1] for r in part], "v": [x.tobytes() for x in v], "codes": [c.tobytes() for c in codes.astype(np.uint8)], "norm": norm}

    coded = common.map_rows(rows.select("row", key, "v"), encode, f"row bigint, {key} {kind}, v binary, codes binary, norm double")
    shards = coded.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n // shard_rows + 1)).cast("int"))
    return common.staged(shards.repartition("shard").sortWithinPartitions("shard", key, "row"), "index"), quantiser


def _first(scores: np.ndarray, count: int) -> np.ndarray:
    """Columns of the `count` smallest of each row; among equals the first columns."""
    if scores.shape[1] <= count:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argsort(scores, axis=1, kind="stable")[:, :count] if scores.shape[1] <= 2 * count else _partitioned(scores, count)


def _partitioned(scores: np.ndarray, count: int) -> np.ndarray:
    bound = np.partition(scores, count - 1, axis=1)[:, count - 1 : count]
    rank = np.where(scores < bound, 0, np.where(scores == bound, 1, 2)).astype(np.int8)
    short = np.argsort(rank, axis=1, kind="stable")
    return short[:, :count]


def search(index: DataFrame, quantiser: Quantiser, queries: list[tuple[int, int, bytes]], k: int, shortlist: int, key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, score) for one block of queries (row, id, vector bytes)."""
    spark = index.sparkSession
    common.prepare(spark)
    kind = dict(index.dtypes)[key]
    held = common.Shipped(spark, (np.array([r for r, _, _ in queries]), np.array([q for _, q, _ in queries]), np.stack([np.frombuffer(v) for _, _, v in queries]), quantiser))

    def run(batches):
        own, ids, q, books = held.value
        tables = np.einsum("qd,mwd->qmw", q.astype(np.float32), books.books)
        best_d = np.full((len(ids), k), np.inf)
        best_id = np.zeros((len(ids), k), dtype=np.int64)
        shard, rows = None, []

        def look(rows):
            nonlocal best_d, best_id
            numbers, keys = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            v = np.stack([np.frombuffer(r[3]) for r in rows])
            codes = np.stack([np.frombuffer(r[4], dtype=np.uint8) for r in rows])
            norm = np.array([r[5] for r in rows], dtype=np.float32)
            for start in range(0, len(ids), 256):
                part = slice(start, start + 256)
                approx = np.tile(norm, (len(ids[part]), 1))
                for m in range(codes.shape[1]):
                    approx -= 2 * tables[part, m][:, codes[:, m]]
                approx[own[part][:, None] == numbers] = np.inf
                near = _first(approx, shortlist)
                d = np.sqrt(((v[near] - q[part, None]) ** 2).sum(axis=2))
                d[own[part][:, None] == numbers[near]] = np.inf
                all_d = np.concatenate([best_d[part], d], axis=1)
                all_id = np.concatenate([best_id[part], keys[near]], axis=1)
                order = np.lexsort((all_id, all_d), axis=1)[:, :k]
                at = np.arange(len(order))[:, None]
                best_d[part], best_id[part] = all_d[at, order], all_id[at, order]

        for batch in batches:
            for r in batch:
                if r[0] != shard and rows:
                    look(rows)
                    rows = []
                shard = r[0]
                rows.append(r)
        if rows:
            look(rows)
        found = np.isfinite(best_d)
        repeated = lambda x: np.repeat(x, k).reshape(len(ids), k)[found]
        yield {"query": repeated(own), "query_id": repeated(ids), key: best_id[found], "score": best_d[found]}

    hits = common.map_rows(index.select("shard", "row", key, "v", "codes", "norm"), run, f"query bigint, query_id {kind}, {key} {kind}, score double")
    order = Window.partitionBy("query").orderBy("score", key)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shortlist: int = 200, shard_rows: int = 4096, block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of every row whose key is divisible by `every`: (query_id, rank, key, score).

    Each block's hits are appended to one table in the shared folder, so the
    plan of the result is one scan however many blocks there are.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]
    folder = common.new_folder(spark, "hits")
    schema = f"query_id {kind}, rank int, {key} {kind}, score double"
    spark.createDataFrame([], schema).write.parquet(folder)
    rows = valid(vectors, key, vector).withColumn("row", F.monotonically_increasing_id())
    rows = common.staged(rows.withColumn("d", F.size("v")), "vectors")
    for (dimension,) in rows.select("d").distinct().orderBy("d").collect():  # hardly ever more than one
        index, quantiser = build_index(rows.filter(F.col("d") == dimension), key, shard_rows=shard_rows)
        queries = index.filter(F.col(key) % every == 0).select("row", key, "v")
        blocks = -(-queries.count() // block)
        queries = common.staged(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))), "queries")
        for b in range(blocks):
            asked = [(r[0], r[1], bytes(r[2])) for r in queries.filter(F.col("block") == b).orderBy(key, "row").select("row", key, "v").collect()]
            if asked:
                search(index, quantiser, asked, k, shortlist, key).write.mode("append").parquet(folder)
        common.release(index, queries)
    common.release(rows)
    return spark.read.schema(schema).parquet(folder)
