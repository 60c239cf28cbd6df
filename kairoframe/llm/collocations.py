"""Collocations: phrases of two to five words that occur together more than their halves suggest.

Texts are cut into pieces at punctuation and line ends and pieces into words.
A phrase is a candidate if it occurs `least` times in its part (language).
Candidates are found in three steps, and none is lost on the way:

1. Words are counted exactly (`chunks.count_words`); a phrase with a rarer
   word cannot be a candidate, so rarer words become breaks.
2. Count-min sketches give upper bounds: every phrase of frequent words adds
   to one cell in each of two rows, and is dropped if either sum is below
   `least`.  First pairs, then the longer phrases all of whose pairs are left.
   Cells are as many as an eighth of the words; they are dealt to tasks by
   range, a chunk sends each of its cells once and gets back a bit for each,
   so neither tasks nor messages grow with the corpus, and nothing is broadcast.
3. What is left of a chunk's phrases is compiled into an Aho-Corasick
   automaton, each phrase between two spaces, so that only whole words match.
   The automaton reads the chunk's words and counts all matches, overlapping
   ones included; an automaton is never larger than its chunk.  Counts are
   summed by part and phrase in buckets, and only then is `least` applied.

Every cut of a candidate into two gives 1000 a n / (l r), whole numbers only
(decimals of 38 digits); the lowest counts.  A candidate inside a longer one
that is as frequent is dropped, whether or not the longer one is dropped too.

Plan: one read of the texts; what is moved then is chunks of packed numbers.
Candidates are joined with their halves by merge joins that Spark can split;
the first `top` of a part are taken by tasks before they meet.

Defined cases: a null text is empty; a null part is `und`; repeated rows
count each; a tie of cuts goes to the shortest first half, a tie of phrases
to the smaller in bytes; a part without candidates has no rows; an empty
table gives no rows; bytes that are not UTF-8 are read as U+FFFD; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C
from . import common

UNDETERMINED = "und"
#: Cells that one task adds up; rows of a sketch.
RANGE, ROWS = 1 << 20, 2
_CUT = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), b" " + C.BETWEEN * 10 + bytes(range(97, 123)))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, A to Z in lower case, and a mark after each piece."""
    cut = text.translate(_CUT).replace(C.BETWEEN, b" " + C.BETWEEN + b" ")
    return [*(b"" if w == C.BETWEEN else w for w in cut.split()), b""]


# ------------------------------------------------------------------ sketch


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


class Phrases:
    """The phrases of a chunk, by the position of their first word; word 0 is a break."""

    def __init__(self, row: dict):
        self.words = C.unpack_words(row["words"])
        self.ids = C.unpack(row["ids"])
        hashed = [hashlib.blake2b(row["part"].encode() + C.BETWEEN + w, digest_size=8).digest() for w in self.words]
        self.hash = np.frombuffer(b"".join(hashed), dtype=np.uint64)[self.ids] if hashed else np.zeros(0, np.uint64)
        self.left = {1: self.ids > 0}
        for n, bits in sorted(dict(row["left"] or ()).items()):
            self.left[n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.ids)).astype(bool)

    def possible(self, n: int) -> np.ndarray:
        """Positions of phrases of n words whose shorter phrases are all left."""
        have = self.left[max(k for k in self.left if k < n)]
        width = max(k for k in self.left if k < n)
        out = have.copy()
        for shift in range(1, n - width + 1):
            out[:-shift] &= have[shift:]
            out[len(out) - shift :] = False
        return np.flatnonzero(out)

    def cells(self, n: int, at: np.ndarray, cells: int) -> list[np.ndarray]:
        """The cell of each phrase in each row; rows lie one after the other."""
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + k])
        return [(_mixed(h + np.uint64(2 * r + 1)) % np.uint64(cells)).astype(np.int64) + r * cells for r in range(ROWS)]

    def named(self, lengths: tuple[int, ...]) -> list[str]:
        """The different phrases that are left, as text."""
        found = []
        words = [w.decode("utf-8", "replace") for w in self.words]
        for n in lengths:
            at = np.flatnonzero(self.left[n])
            code = self.ids[at]
            for k in range(1, n):
                _, code = np.unique(code * len(words) + self.ids[at + k], return_inverse=True)
            _, first = np.unique(code, return_index=True)
            found += [" ".join([words[i] for i in self.ids[p : p + n]]) for p in at[first]]
        return found

    def text(self) -> str:
        words = ["\n", *(w.decode("utf-8", "replace") for w in self.words[1:])]
        return " " + " ".join([words[i] for i in self.ids.tolist()]) + " "


def _asked(phrases: Phrases, lengths: tuple[int, ...], cells: int) -> tuple[list[tuple[int, np.ndarray, list[np.ndarray]]], np.ndarray, np.ndarray]:
    """Positions and cells of the possible phrases by length; the different cells and their counts."""
    by_length = [(n, at, phrases.cells(n, at, cells)) for n in lengths for at in [phrases.possible(n)]]
    every = [c for _, _, rows in by_length for c in rows]
    unique, counts = np.unique(np.concatenate(every), return_counts=True)
    return by_length, unique, counts


def sketched(state: DataFrame, lengths: tuple[int, ...], cells: int, least: int) -> DataFrame:
    """state with the phrases of these lengths that the sketch leaves: (chunk, part, words, ids, left)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, unique, counts = _asked(Phrases(row), lengths, cells)
                edges = np.flatnonzero(np.diff(unique // RANGE, prepend=-1))
                parts = list(zip(np.split(unique, edges[1:]), np.split(counts, edges[1:]), strict=True)) if len(edges) else []
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([int(u[0]) // RANGE for u, _ in parts], pa.int64()), "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()),
                    "cells": pa.array([C.pack(np.diff(u % RANGE, prepend=0)) for u, _ in parts], pa.binary()), "counts": pa.array([C.pack(c) for _, c in parts], pa.binary()),
                })

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        at = [np.cumsum(C.unpack(r["cells"])) for r in rows]
        sums = np.zeros(RANGE, dtype=np.int64)
        for where, r in zip(at, rows, strict=True):
            sums[where] += C.unpack(r["counts"])  # a chunk names a cell once
        bits = [np.packbits(sums[where] >= least).tobytes() for where in at]
        return pa.table({"range": pa.array([r["range"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "n": pa.array([len(w) for w in at], pa.int64()), "bits": pa.array(bits, pa.binary())})

    def hear(left: pa.Table, right: pa.Table) -> pa.Table:
        [row] = left.to_pylist()
        phrases, answers = Phrases(row), sorted((r["range"], r["n"], r["bits"]) for r in right.to_pylist())
        by_length, unique, _ = _asked(phrases, lengths, cells)
        enough = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, n, bits in answers)])
        kept = dict(row["left"] or ())
        for n, at, rows in by_length:
            bits = np.zeros(len(phrases.ids), dtype=bool)
            bits[at[np.logical_and.reduce([enough[np.searchsorted(unique, c)] for c in rows])]] = True
            kept[n] = np.packbits(bits).tobytes()
        return pa.Table.from_pylist([row | {"left": list(kept.items())}], schema=_STATE)

    asked = state.mapInArrow(ask, "range bigint, chunk bigint, cells binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(add_up, "range bigint, chunk bigint, n bigint, bits binary")
    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(hear, STATE)


STATE = "chunk bigint, part string, words binary, ids binary, left map<int, binary>"
_STATE = pa.schema([("chunk", pa.int64()), ("part", pa.string()), ("words", pa.binary()), ("ids", pa.binary()), ("left", pa.map_(pa.int32(), pa.binary()))])


# -------------------------------------------------------------- candidates


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """(part, phrase, a) for every word that occurs `least` times; phrase null: how many occurrences the part has."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                names, counts = C.unpack_words(row["words"]), C.unpack(row["counts"])
                counts[[i for i, w in enumerate(names) if not w]] = 0
                at = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * (len(at) + 1), pa.string()), "phrase": pa.array([None, *(names[i].decode("utf-8", "replace") for i in at)], pa.string()),
                    "a": pa.array([int(counts.sum()), *counts[at].tolist()], pa.int64()),
                })

    return words.select("part", "words", "counts").mapInArrow(tell, "part string, phrase string, a bigint")


def thinned(chunks: DataFrame, words: DataFrame, buckets: int, least: int) -> DataFrame:
    """The chunks with only the words that occur `least` times in their part; runs of others are one break."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = list(C.told(row, np.minimum(C.unpack(row["counts"]), least)))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in out], pa.int64()), "bucket": pa.array([row["bucket"]] * len(out), pa.int64()), "counts": pa.array([C.pack(n) for _, n in out], pa.binary())})

    def thin(left: pa.Table, right: pa.Table) -> pa.Table:
        [row] = left.to_pylist()
        names = C.unpack_words(row["words"])
        keep = C.heard(names, row["part"], buckets, [(x["bucket"], x["counts"]) for x in right.to_pylist()]) >= least
        keep[0] = False
        number = np.where(keep, np.cumsum(keep), 0)
        ids = number[C.unpack(row["ids"])]
        ids = ids[(ids > 0) | (np.concatenate([[1], ids[:-1]]) > 0)]
        kept = {"words": C.pack_words([b"", *(w for w, k in zip(names, keep, strict=True) if k)]), "ids": C.pack(ids), "left": []}
        return pa.Table.from_pylist([{"chunk": row["chunk"], "part": row["part"]} | kept], schema=_STATE)

    told = words.select("bucket", "counts", "chunks", "places", "lengths").mapInArrow(tell, "chunk bigint, bucket bigint, counts binary")
    return chunks.select("chunk", "part", "words", "ids").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(thin, STATE)


def counted(state: DataFrame, lengths: tuple[int, ...], buckets: int, least: int) -> DataFrame:
    """(part, phrase, size, a): the phrases that the chunks' automata find `least` times in all.

    A chunk sends its counts packed, by bucket of the phrase; buckets add them up.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                phrases = Phrases(row)
                names = phrases.named(lengths)
                if not names:
                    continue
                automaton = ahocorasick.Automaton()
                for i, name in enumerate(names):
                    automaton.add_word(f" {name} ", i)
                automaton.make_automaton()
                found = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(phrases.text())), dtype=np.int64), minlength=len(names))
                names = [name.encode() for name in names]
                order, sizes = C.dealt(names, row["part"], buckets)
                cuts = [(k, c) for k, c in enumerate(np.split(order, np.cumsum(sizes)[:-1])) if len(c)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _ in cuts], pa.int64()), "part": [row["part"]] * len(cuts),
                    "phrases": pa.array([C.pack_words([names[i] for i in c]) for _, c in cuts], pa.binary()), "counts": pa.array([C.pack(found[c]) for _, c in cuts], pa.binary()),
                })

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        totals: dict[str, dict[bytes, int]] = {}
        for row in table.to_pylist():
            total = totals.setdefault(row["part"], {})
            for name, n in zip(C.unpack_words(row["phrases"]), C.unpack(row["counts"]).tolist(), strict=True):
                total[name] = total.get(name, 0) + n
        kept = [(part, name.decode(), n) for part, total in totals.items() for name, n in total.items() if n >= least]
        return pa.table({k: pa.array([x[i] for x in kept], t) for i, (k, t) in enumerate((("part", pa.string()), ("phrase", pa.string()), ("a", pa.int64())))})

    sent = state.mapInArrow(scan, "bucket bigint, part string, phrases binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(add_up, "part string, phrase string, a bigint")
    return found.select("part", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a")


def candidates(docs: DataFrame, text: str = "text", part: str = "lang", least: int = 100, longest: int = 5, chunk: int = C.TOKENS, entries: int = C.ENTRIES, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All phrases of two words and more that occur `least` times in their part, and `frequent_words`; cells: of a sketch's row."""
    common.prepare(docs.sparkSession)
    chunks = common.staged(C.build(docs, text, pieces, part=F.coalesce(F.col(part), F.lit(UNDETERMINED)), most=chunk), "phrase-chunks")
    size = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    buckets = max(1, -(-(size.distinct or 0) // entries))
    cells = cells or 1 << max(16, ((size.tokens or 0) // 8).bit_length())
    words = common.staged(C.count_words(chunks, buckets), "phrase-words")
    state = common.staged(thinned(chunks, words, buckets, least), "phrase-state")
    common.release(chunks)
    for lengths in ((2,), tuple(range(3, longest + 1))):
        if lengths:
            before, state = state, common.staged(sketched(state, lengths, cells, least), "phrase-state")
            common.release(before)
    found = counted(state, tuple(range(2, longest + 1)), max(1, -(-(size.tokens or 0) // (8 * entries))), least)
    out = common.staged(found, "phrases"), common.staged(frequent_words(words, least), "frequent-words")
    common.release(state, words)
    return out


# ------------------------------------------------------------------ scores


def mine(docs: DataFrame, text: str = "text", part: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each part."""
    phrases, words = candidates(docs, text, part, least, longest, **sizes)
    totals = words.filter("phrase is null").groupBy("part").agg(F.sum("a").alias("n"))
    every = phrases.select("part", "phrase", "a").union(words.filter("phrase is not null"))
    side = lambda name, count: every.select("part", F.col("phrase").alias(name), F.col("a").alias(count)).hint("merge")
    split = F.split("phrase", " ")
    cuts = phrases.select("part", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(split, F.col("k") + 1, F.col("size")), " ").alias("rest"))
    cuts = cuts.join(side("first", "l"), ["part", "first"]).join(side("rest", "r"), ["part", "rest"]).join(totals.hint("shuffle_hash"), "part")
    exact = F.expr("cast(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) as decimal(38, 0)) * 1000 div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cuts.withColumn("score", exact).groupBy("part", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = phrases.filter("size > 2").select("part", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("part", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer.hint("merge"), ["part", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("part").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("part").alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))
