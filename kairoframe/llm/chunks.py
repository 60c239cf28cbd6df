"""Texts as chunks of numbered words, and an exchange that counts every word over all chunks.

A chunk is some two million tokens of whole documents from one scan task: its
distinct words once, and for each token the number of its word within the
chunk, packed.  Counting over the corpus then moves one entry for each
distinct word of a chunk instead of each occurrence: entries go to a bucket
by the word, buckets add them up, and each chunk is told about its own words.
Words are compared as themselves, never by a hash alone.

A bucket's size is set by the number of entries, so tasks stay alike however
many chunks there are; a word in every chunk is one entry in each of them.

Bytes that are not UTF-8 are read as U+FFFD.  Token b"" is a mark: the end of
a text, or of a piece of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a chunk, entries of a bucket.
TOKENS, ENTRIES = 1 << 21, 1 << 20
#: A byte that UTF-8 never has, between words that are packed together.
BETWEEN = b"\xff"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ----------------------------------------------------------------- packing


def pack(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as their largest needs, plane by plane, compressed; integers are not negative."""
    if values.dtype.kind != "f":
        most = int(values.max(initial=0))
        values = values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return values.dtype.char.encode() + len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(packed: bytes) -> np.ndarray:
    kind, n = np.dtype(chr(packed[0])), int.from_bytes(packed[1:9], "little")
    if not n:
        return np.zeros(0, np.float64 if kind.kind == "f" else np.int64)
    planes = np.frombuffer(pa.decompress(packed[9:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    values = planes.reshape(kind.itemsize, n).T.copy().view(kind).ravel()
    return values if kind.kind == "f" else values.astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    joined = BETWEEN.join(words)
    return len(words).to_bytes(8, "little") + len(joined).to_bytes(8, "little") + pa.compress(joined, "zstd", asbytes=True)


def unpack_words(packed: bytes) -> list[bytes]:
    n, size = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    return pa.decompress(packed[16:], size, "zstd", asbytes=True).split(BETWEEN) if n else []


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


# ------------------------------------------------------------------ chunks


class _Open:
    """A chunk that is being filled."""

    def __init__(self):
        self.numbers = Numbers({b"": 0})
        self.ids, self.keys, self.flags, self.total = [], [], [], 0

    def add(self, key, flag: bool, words: list[bytes]) -> None:
        self.ids.append(self.numbers.of(words))
        self.keys.append(key)
        self.flags.append(flag)
        self.total += len(words)

    def row(self, chunk: int, part: str) -> dict:
        sizes = np.fromiter(map(len, self.ids), dtype=np.int64, count=len(self.ids))
        ids, flags = np.concatenate(self.ids), np.array(self.flags, dtype=bool)
        found = np.bincount(ids, minlength=len(self.numbers))
        found[0] = self.total + 1  # the mark stays first; the frequent words' numbers are small
        order = np.argsort(-found, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids = place[ids]
        learned = np.bincount(ids[np.repeat(flags, sizes)], minlength=len(order))
        words = list(self.numbers)
        return {
            "chunk": chunk, "part": part, "keys": self.keys, "flags": np.packbits(flags).tobytes(), "sizes": pack(sizes), "ids": pack(ids),
            "words": pack_words([words[i] for i in order]), "counts": pack(learned), "tokens": self.total, "distinct": len(order),
        }


def build(docs: DataFrame, text: str, split: Callable[[bytes], list[bytes]], key: str | None = None, learned: F.Column | None = None, part: F.Column | None = None, most: int = TOKENS) -> DataFrame:
    """A row for each chunk; texts of different parts are in different chunks.  `learned` marks the texts that counts are of."""
    kind = docs.schema[key].dataType.simpleString() if key else "int"
    schema = f"chunk bigint, part string, keys array<{kind}>, flags binary, sizes binary, ids binary, words binary, counts binary, tokens bigint, distinct bigint"
    from pyspark.sql.types import StructType

    common.prepare(docs.sparkSession)
    arrow = common._arrow_schema(StructType.fromDDL(schema))
    rows = docs.select(
        (F.col(key) if key else F.lit(0)).alias("key"),
        F.coalesce(learned if learned is not None else F.lit(True), F.lit(True)).alias("learned"),
        F.coalesce(part if part is not None else F.lit(""), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[str, _Open] = {}
        made = 0

        def close(name: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([held.pop(name).row(first + made, name)], schema=arrow)

        for b in batches:
            for key, flag, name, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if BETWEEN in body:
                    body = body.decode("utf-8", "replace").encode()
                held.setdefault(name, _Open()).add(key, flag, split(body))
                if sum(c.total for c in held.values()) >= most or len(held) > 64:
                    yield close(max(held, key=lambda x: held[x].total))
        for name in list(held):
            yield close(name)

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------- word exchange


def dealt(words: list[bytes], part: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' places in the order of their buckets, and how many each bucket gets."""
    start = zlib.crc32(part.encode())
    bucket = np.fromiter((zlib.crc32(w, start) for w in words), dtype=np.int64, count=len(words)) % buckets
    return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket and part: its words, their counts, and which of them each chunk has, chunk by chunk.

    `values` and `sizes`: the counts that occur, and how many words have each.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, counts = unpack_words(row["words"]), unpack(row["counts"])
                order, sizes = dealt(words, row["part"], buckets)
                ends = np.cumsum(sizes)
                at = np.flatnonzero(sizes)
                cuts = [order[ends[k] - sizes[k] : ends[k]] for k in at]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(at, pa.int64()), "part": [row["part"]] * len(at), "chunk": pa.array([row["chunk"]] * len(at), pa.int64()),
                    "words": pa.array([pack_words([words[i] for i in c]) for c in cuts], pa.binary()), "counts": pa.array([pack(counts[c]) for c in cuts], pa.binary()),
                })

    names = ["part", "words", "counts", "chunks", "places", "lengths"]

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        rows, asked = [], table.to_pylist()
        for part in sorted({row["part"] for row in asked}):
            mine = [row for row in asked if row["part"] == part]
            numbers, chunk_ids, counts = Numbers(), [row["chunk"] for row in mine], [unpack(row["counts"]) for row in mine]
            places = [numbers.of(unpack_words(row["words"])) for row in mine]
            at, n = np.concatenate(places), np.zeros(len(numbers), dtype=np.int64)
            np.add.at(n, at, np.concatenate(counts))
            rows.append([part, pack_words(list(numbers)), pack(n), chunk_ids, pack(at), pack(np.array([len(p) for p in places])), *(x.tolist() for x in np.unique(n, return_counts=True))])
        columns = dict(zip([*names, "values", "sizes"], map(list, zip(*rows, strict=True)), strict=True))
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int64())} | {
            k: pa.array(v, pa.string() if k == "part" else pa.list_(pa.int64()) if k in ("chunks", "values", "sizes") else pa.binary()) for k, v in columns.items()
        })

    common.prepare(chunks.sparkSession)
    asked = chunks.select("chunk", "part", "words", "counts").mapInArrow(ask, "bucket bigint, part string, chunk bigint, words binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(add_up, "bucket bigint, part string, words binary, counts binary, chunks array<bigint>, places binary, lengths binary, values array<bigint>, sizes array<bigint>")


def told(row: dict, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each chunk of a bucket's row, the values of its words in the order in which it asked."""
    places, ends = unpack(row["places"]), np.cumsum(unpack(row["lengths"]))
    for chunk, part in zip(row["chunks"], np.split(values[places], ends[:-1]), strict=True):
        yield chunk, part


def heard(words: list[bytes], part: str, buckets: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """A chunk's values, in the order of its words, from (bucket, packed values)."""
    order, _ = dealt(words, part, buckets)
    out = np.zeros(len(words), dtype=np.int64)
    out[order] = np.concatenate([unpack(v) for _, v in sorted(answers)])
    return out
