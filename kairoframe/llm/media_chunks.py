"""Media columns by content-defined chunking.

A payload is stored losslessly as 8-bit samples in a WAV file.  A rolling gear
hash over the file's bytes places cuts where the content says so; chunks are
known by their SHA-256, a chunk that occurs anywhere is stored once, and a
file is an ordered list of digests.  Reading back joins the lists with the
store, puts the chunks in order, verifies the file against its own digest and
decodes the samples.

Plan.  One pass cuts every payload and keeps the lists (digests only, no
bytes).  Equal payloads have equal files: they are one file from here on, so a
large group of copies costs one row.  A second pass sends each chunk's
compressed bytes to its digest, where one copy stays; the lists join there.  A
file of one chunk is verified at once, a longer one after its chunks have come
together under its key, sorted by position and read as a stream.  Digests that
very many files share are salted: at most `HOT_DIGESTS` of them by
construction.

Defined cases: a null text is empty; an empty payload is padded to one unit;
equal texts give equal values; repeated rows give repeated rows; a null id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Sizes of chunks in bytes: least, mean beyond the least (a power of two), most.
LEAST, MEAN, MOST = 2048, 8192, 65536
#: Bytes to whose multiples payloads are padded.
UNIT = 192
HOT_DIGESTS, SALTS = 1000, 16
_HEADER = "<4sI4s4sIHHIIHH4sI"
_HEADER_BYTES = 44


def _gear() -> np.ndarray:
    """256 pseudo-random numbers by the splitmix rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of data.

    The hash after byte i is the sum of GEAR[byte j] << (i - j), 32 bits wide,
    so it sees the last 32 bytes; sums of windows of 1, 2, 4 ... 32 bytes give
    it for all places at once.  A cut falls where its top bits are zero, at
    least `least` bytes after the last one, and after `most` bytes at the
    latest.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    mask = np.uint32((mean - 1) << (32 - (mean - 1).bit_length()))
    places: list[np.ndarray] = []
    step = 1 << 22
    for start in range(0, n, step):
        begin = max(0, start - 31)
        h = GEAR[np.frombuffer(data, dtype=np.uint8, count=min(n, start + step) - begin, offset=begin)]
        width = 1
        while width < 32:
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        found = np.flatnonzero((h & mask) == 0) + begin + 1
        places.append(found[found > start])
    places_all = np.concatenate(places)
    ends, last = [], 0
    while n - last > least:
        k = int(np.searchsorted(places_all, last + least))
        cut = int(places_all[k]) if k < len(places_all) else n
        last = min(cut, last + most, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    return struct.pack(_HEADER, b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def decode(media: bytes) -> bytes:
    """The samples of a file that encode made."""
    riff, size, wave, fmt, _, kind, channels, _, _, align, bits, data, n = struct.unpack_from(_HEADER, media)
    if (riff, wave, fmt, data, kind, channels, align, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 1, 8) or n != len(media) - _HEADER_BYTES or size != 36 + n:
        raise ValueError("not a file of 8-bit mono samples")
    return media[_HEADER_BYTES :]


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def features(samples: bytes) -> str:
    """Whole numbers about the waveform: samples, sum and energy about the mid value, sign changes, least, most."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={int((np.diff(np.signbit(x).astype(np.int8)) != 0).sum())};min={x.min()};max={x.max()}"


def _read(media: bytes, key: bytes) -> tuple:
    if hashlib.sha256(media).digest() != key:
        raise ValueError(f"the chunks of {key.hex()} do not make up the file")
    payload = decode(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), key.hex(), features(payload)


_RESULT = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def manifests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged (key, n_bytes, file, digests): the file's SHA-256 and its ordered list of chunks."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for rows in batches:
            for part in common.by_size(rows, lambda r: len(r[1] or "")):
                raw = [(t or "").encode() for _, t in part]
                media = [encode(padded(x)) for x in raw]
                yield {
                    key: [k for k, _ in part],
                    "n_bytes": [len(x) for x in raw],
                    "file": [hashlib.sha256(x).digest() for x in media],
                    "digests": [[hashlib.sha256(c).digest() for c in chunks(x)] for x in media],
                }

    return common.staged(common.map_rows(docs.select(key, text), run, f"{key} {kind}, n_bytes bigint, file binary, digests array<binary>"), "manifests")


def stored_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, data): compressed chunks, repeats within a batch left out; the store keeps one of each digest."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=9)
        for rows in batches:
            for part in common.by_size(rows, lambda r: len(r[0] or "")):
                seen: dict[bytes, bytes] = {}
                for (t,) in part:
                    for c in chunks(encode(padded((t or "").encode()))):
                        d = hashlib.sha256(c).digest()
                        if d not in seen:
                            seen[d] = pack.compress(c)
                yield {"digest": list(seen), "data": list(seen.values())}

    return common.map_rows(docs.select(text), run, "digest binary, data binary")


def reconstruct(docs: DataFrame, lists: DataFrame, text: str = "text") -> DataFrame:
    """Staged (file, features of the file read back) for every file of the lists."""
    files = lists.groupBy("file").agg(F.first("digests").alias("digests"))
    refs = common.staged(files.select("file", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest")), "chunk-references")
    bound = max(1000, refs.count() // HOT_DIGESTS + 1)
    hot = F.broadcast(refs.groupBy("digest").count().filter(F.col("count") > bound).select("digest", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    store = stored_chunks(docs, text).join(hot, "digest", "left").select("digest", "data", F.explode(salts).alias("salt"))
    store = store.groupBy("digest", "salt").agg(F.first("data").alias("data"))
    salted = refs.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("file"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")
    met = store.join(salted, ["digest", "salt"]).select("file", "n", "pos", "digest", "data")

    def alone(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for rows in batches:
            out: dict[str, list] = {k: [] for k in ("file", "pos", "digest", "data", *_NAMES)}
            for file, n, pos, digest, data in rows:
                read = _read(unpack.decompress(data), file) if n == 1 else (None,) * len(_NAMES)
                for k, v in zip(out, (file, pos, digest, None if n == 1 else data, *read), strict=True):
                    out[k].append(v)
            yield out

    parts = common.map_rows(met, alone, f"file binary, pos int, digest binary, data binary, {_RESULT}")

    def together(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        current, held = None, []

        def put(out, file, read):
            for k, v in zip(("file", *_NAMES), (file, *read), strict=True):
                out[k].append(v)

        for rows in batches:
            out: dict[str, list] = {k: [] for k in ("file", *_NAMES)}
            for file, _, digest, data, *read in rows:
                if data is None:
                    put(out, file, read)
                    continue
                if file != current and current is not None:
                    put(out, current, _read(b"".join(held), current))
                    held = []
                current = file
                piece = unpack.decompress(data)
                if hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                held.append(piece)
            yield out
        if current is not None:
            out = {k: [] for k in ("file", *_NAMES)}
            put(out, current, _read(b"".join(held), current))
            yield out

    gathered = parts.repartition("file").sortWithinPartitions("file", "pos")
    return common.staged(common.map_rows(gathered, together, f"file binary, {_RESULT}"), "read-back")


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_chunks, what the file read back gives) for every row of docs."""
    lists = manifests(docs, key, text)
    read = reconstruct(docs, lists, text)
    rows = lists.select(key, "n_bytes", "file", F.size("digests").alias("n_chunks"))
    return rows.join(read, "file").select(key, "n_bytes", *_NAMES, "n_chunks")
