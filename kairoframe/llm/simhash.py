"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

A fingerprint bit is 1 if it is set in over half of the document's shingle
hashes (XXH64, seed 42; repeated shingles count repeatedly).  Fingerprints
that differ in at most `radius` bits are linked.

Search.  The distinct fingerprints are cut into m bit blocks (m at least
radius + 1); two fingerprints within the radius agree in at least m - radius
whole blocks, so every choice of that many blocks makes a shard key and each
link lies in a shard.  m and the bits used of each key follow from the number
of fingerprints alone, so that a shard holds about `SHARD` of them whatever the
input.  Every shard has BK-trees: children are keyed by their Hamming distance
to the parent, and a search follows only edges whose key is within the radius
of the query's distance to the parent; every fingerprint of the shard is
searched.  The fingerprints of a corpus have no size bound and must not pass
through the driver, so trees are built where a shuffle has dealt their shard
and are not broadcast.

Hot shards (many different fingerprints that agree in a key, as in a large
group of near copies) are cut into blocks by interleaved parts of their other
bits, one of which agrees for every link, before the shuffle and again before
their trees are built, so that a tree's size stays bounded.

A shard gives a spanning forest of its links, not all pairs: as many rows as
fingerprints at most, and no component is lost.

Defined cases: null or wordless text has fingerprint zero and links like any
other; repeated rows give repeated rows; a row without an id takes part and
gets the smallest id reachable (null if none has one); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Fingerprints that a shard holds on average, and those that a tree holds before it is cut by further parts.
SHARD, TREE = 64, 512


# ------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    counts, total = np.zeros(2048), 0
    for start in range(0, n, 200_000):
        part = words[start : start + 200_000 + shingle - 1]
        m = max(1, min(200_000, n - start))
        grams = map(b" ".join, zip(*(part[k : k + m] for k in range(shingle)), strict=True)) if n > 1 or len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((hash_of(g, seed) for g in grams), dtype=np.uint64, count=m)
        octets = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        counts += np.bincount(octets.ravel(), minlength=2048)
        total += m
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones > total / 2, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for rows in batches:
            fps = np.array([fingerprint(t, shingle) for _, t in rows], dtype=np.uint64).view(np.int64)
            yield {key: [k for k, _ in rows], "fp": fps}

    kind = dict(docs.dtypes)[key]
    return common.map_rows(docs.select(key, text), run, f"{key} {kind}, fp bigint")


# ------------------------------------------------------------------ BK-tree


class BKTree:
    """64-bit values, each once; a node's children are keyed by their distance to it."""

    def __init__(self, values):
        it = iter(values)
        self.root = (next(it), {})
        for value in it:
            self.add(value)

    def add(self, value: int) -> None:
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root]
        while stack:
            at, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            if children:
                low, high = d - radius, d + radius
                stack.extend(child for edge, child in children.items() if low <= edge <= high)


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among distinct values that share a shard."""
    root = {v: v for v in values}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for group in _trees(values, radius):
        if len(group) < 2:
            continue
        tree = BKTree(group)
        for v in group:
            for w in tree.within(v, radius):
                a, b = find(v), find(w)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((max(v, w), min(v, w)))
    return out


def _trees(values: list[int], radius: int, depth: int = 0) -> Iterator[list[int]]:
    """Groups that hold every link between the values, none much over TREE unless its values agree nearly everywhere."""
    if len(values) <= TREE or depth == 3:
        yield values
        return
    varying = 0
    for v in values:
        varying |= v ^ values[0]
    places = [i for i in range(64) if varying >> i & 1]
    parts = [sum(1 << p for p in places[k :: radius + 1]) for k in range(radius + 1)]  # one of them agrees
    for mask in parts:
        groups: dict[int, list[int]] = {}
        for v in values:
            groups.setdefault(v & mask, []).append(v)
        for group in groups.values():
            if len(group) > 1:
                yield from _trees(group, radius, depth + 1)


def _blocks(n: int) -> list[int]:
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


# ------------------------------------------------------------------- shards


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks_for(rows: int, radius: int) -> list[int]:
    """Bit masks, one of which two values within the radius always agree in; rows values make shards of about SHARD."""
    from itertools import combinations

    bits = max(1, (max(rows, 1) // SHARD).bit_length())
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < bits and blocks < 2 * radius + 2:
        blocks += 1
    out = []
    for chosen in combinations(_blocks(blocks), blocks - radius):
        places = [p for p in range(64) if sum(chosen) >> p & 1]
        out.append(sum(1 << places[k * len(places) // min(bits, len(places))] for k in range(min(bits, len(places)))))
    return out


def shard_keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(shard, fp): a row for each mask."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("shard"))


def refined(shards: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """Deals shards of more than `block` rows out again, by radius + 1 interleaved parts of all bits, one of which agrees for every link."""
    hot = shards.groupBy("shard").count().filter(F.col("count") > block).select("shard", F.lit(True).alias("hot"))
    parts = [_signed(sum(1 << p for p in range(k, 64, radius + 1))) for k in range(radius + 1)]
    again = F.array(*[F.xxhash64(F.col("shard"), F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(parts)])
    return shards.join(hot.hint("merge"), "shard", "left").select("fp", F.explode(F.when(F.col("hot"), again).otherwise(F.array("shard"))).alias("shard"))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints of column fp: same components as all links."""
    common.prepare(fps.sparkSession)
    distinct = common.staged(fps.select("fp").distinct(), "fingerprints")
    shards = shard_keys(distinct, masks_for(distinct.count(), radius))
    dealt = refined(shards, radius).repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        shard, held = None, []

        def flush(groups):
            pairs = [p for g in groups for p in _forest(sorted(set(g)), radius)]
            flat = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=schema)

        for batch in batches:
            keys, values = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "fp"))
            if not len(keys):
                continue
            values = values.view(np.uint64).tolist()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            groups = []
            for a, z in zip(edges, edges[1:], strict=False):
                if shard is not None and keys[a] == shard:
                    held += values[a:z]
                else:
                    if len(held) > 1:
                        groups.append(held)
                    shard, held = keys[a], values[a:z]
            if groups:
                yield flush(groups)
        if len(held) > 1:
            yield flush([held])

    return dealt.select("shard", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (key, fp, component_id), component_id the smallest key of its component."""
    marked = common.staged(fingerprints(docs, shingle, key, text), "simhash")
    least = common.staged(marked.groupBy("fp").agg(F.min(key).alias("least")), "least")
    joined = components(links(least, radius))
    of = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = common.staged(of, "members")
    top = common.staged(of.groupBy("root").agg(F.min("least").alias("component_id")), "tops")
    named = common.staged(of.join(top, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(key, "fp", "component_id")


# ----------------------------------------------- links by text similarity

#: Odd multipliers of the min-hash permutations.
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD1B54A32D192ED03 << k) % 2**64 | 1 for k in range(16)], dtype=np.uint64)
#: Bins of a one-permutation sketch, a byte each.
BINS = 256
#: Nodes of a shard that a task compares with each other, and leaders that go to each block of a shard of several blocks.
BLOCK, LEADERS = 2000, 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of one text in its order, repeats included; a shorter text is one shingle."""
    import xxhash

    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k : k + n] for k in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=n)


def signature(text: str | None, shingle: int, rows: int = 2) -> tuple[int, list[int], bytes, int]:
    """Fingerprint, band keys, sketch and a hash of the shingle set of one text.

    A band key joins `rows` min-hashes of the shingle set; the sketch keeps a
    byte of the smallest hash in each of 256 bins (0: empty), from which the
    similarity of two sets is estimated.
    """
    import xxhash

    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0, [0] * (len(_MULTIPLIERS) // rows), bytes(BINS), 0
    counts, least, smallest = np.zeros(2048), np.full(len(_MULTIPLIERS), 2**64 - 1, dtype=np.uint64), np.full(BINS, 2**64 - 1, dtype=np.uint64)
    for start in range(0, n, 100_000):
        h = hashes[start : start + 100_000]
        octets = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        counts += np.bincount(octets.ravel(), minlength=2048)
        least = np.minimum(least, (h[:, None] * _MULTIPLIERS).min(axis=0))
        np.minimum.at(smallest, (h >> np.uint64(56)).astype(np.int64), h)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    fp = int(np.packbits(ones > n / 2, bitorder="little").view("<u8")[0])
    sketch = np.where(smallest == 2**64 - 1, 0, smallest % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()
    bands = [xxhash.xxh64_intdigest(least[k : k + rows].tobytes(), k) for k in range(0, len(least), rows)]
    return fp, bands, sketch, xxhash.xxh64_intdigest(np.unique(hashes).tobytes())


def similarity_of(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a sketch to each of others (rows)."""
    filled = (one > 0) | (others > 0)
    same = (one == others) & filled
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, same.sum(axis=1) / np.maximum(n, 1))


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Exact similarity of two sets, given as sorted distinct values."""
    both = np.intersect1d(one, other, assume_unique=True).size
    return both / (one.size + other.size - both) if one.size or other.size else 1.0


def _similar(nodes: list[tuple], radius: int, least: float, similarity: float | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links in one shard; nodes are (node, fp, sketch) or (node, fp, sketch, shingle set).

    A link is a pair whose sketches give `least`; with `similarity`, one whose
    sets have that similarity besides.  Nodes are searched and added one by
    one.  Those of the main component (the first link's) have a tree of their
    own, in which what is already linked is passed over, since more links would
    change nothing; so a shard of thousands of near copies takes little more
    than a search for each.  The trees only give near fingerprints first: what
    is not linked then is compared too, whatever its fingerprint.
    """
    label = np.arange(len(nodes))
    find = label.__getitem__
    tried: set[int] = set()

    def confirmed(i: int, j: int) -> bool:
        if similarity is None:
            return True
        if j in tried:
            return False
        tried.add(j)
        one, other = (np.frombuffer(nodes[k][3], dtype=np.uint64) for k in (i, j))
        return min(one.size, other.size) >= similarity * max(one.size, other.size) and jaccard(one, other) >= similarity

    sketches = np.frombuffer(b"".join(n[2] for n in nodes), dtype=np.uint8).reshape(len(nodes), -1)
    trees: dict[bool, BKTree | None] = {True: None, False: None}
    held: dict[bool, dict[int, list[int]]] = {True: {}, False: {}}
    members: dict[int, list[int]] = {}
    main, out = -1, []

    def put(i: int, part: bool) -> None:
        fp = nodes[i][1]
        if trees[part] is None:
            trees[part] = BKTree([fp])
        elif fp not in held[part]:
            trees[part].add(fp)
        held[part].setdefault(fp, []).append(i)

    def linked(i: int, part: bool) -> Iterator[int]:
        if trees[part] is None:
            return
        near = (j for v in trees[part].within(nodes[i][1], radius) for j in held[part][v] if find(j) != find(i))
        while some := list(islice(near, 16)):
            for j, s in zip(some, similarity_of(sketches[i], sketches[some]), strict=True):
                if s >= least and find(j) != find(i) and confirmed(i, j):
                    yield j

    def others(i: int) -> Iterator[int]:
        rest = np.flatnonzero(label[:i] != label[i])
        for k in range(0, len(rest), 512):
            some = rest[k : k + 512]
            some = some[label[some] != label[i]]
            for j in some[similarity_of(sketches[i], sketches[some]) >= least].tolist():
                if find(j) != find(i) and confirmed(i, j):
                    yield j

    for i, (node, *_) in enumerate(nodes):
        members[i] = [i]
        tried.clear()
        for found in (linked(i, True), linked(i, False), others(i)):
            for j in found:
                a, b = sorted((int(find(i)), int(find(j))))
                label[label == b] = a
                out.append((max(node, nodes[j][0]), min(node, nodes[j][0])))
                rest = members.pop(b)
                if main < 0 or main in (a, b):
                    moved = [*rest, *members[a]] if main < 0 else rest if main == a else members[a]
                    for k in moved:
                        if k != i:
                            put(k, True)
                    main = a
                members[a] += rest
        put(i, find(i) == main)
    return out


def dealt_in_blocks(keys: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """keys (shard, node) with `lead` and `part`, the task's key, and the number of blocks of each shard of several.

    A shard of n nodes makes ceil(n / block) blocks by a hash of the node.  Its
    leaders (the smallest node of each of LEADERS hash classes) go to every
    block.  Shards of one block have no leaders.
    """
    sizes = keys.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("shard", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sizes = common.staged(sizes, "large-shards")
    spread = F.pmod(F.xxhash64("node"), F.lit(LEADERS))
    leaders = keys.join(sizes, "shard").groupBy("shard", spread.alias("class")).agg(F.min("node").alias("node")).select("shard", "node", F.lit(True).alias("lead"))
    marked = keys.join(sizes, "shard", "left").join(common.staged(leaders, "leaders"), ["shard", "node"], "left")
    own = F.array(_block(F.col("node"), F.coalesce("blocks", F.lit(1))))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = marked.withColumn("block", F.explode(F.when(F.col("lead"), every).otherwise(own)))
    return dealt.select("shard", "node", F.coalesce("lead", F.lit(False)).alias("lead"), F.xxhash64("shard", "block").alias("part")), sizes


def _block(node: F.Column, blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("block"), node), blocks).cast("int")


def shard_links(keys: DataFrame, described: Callable[[DataFrame], DataFrame], radius: int, least: float, exact: float | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) whose components are those of all links inside the shards of keys (shard, node).

    described adds fp, sketch and, for exact links, grams to rows with a node.

    No task holds more than about two blocks of a shard.  First, each block
    with the shard's leaders: in a large group of near copies nearly all nodes
    get connected to the first leader there.  Two such nodes need no link of
    their own, so only the nodes that were not connected are left; they are
    compared, in blocks, with every block of their shard.  No link is lost.
    """
    extra = [c for c in ("grams",) if exact is not None]
    dealt, sizes = dealt_in_blocks(keys, block)

    def found(held: list[tuple], large: bool) -> tuple[list, list]:
        """Links of a part, and its nodes that are not connected to its first leader."""
        pairs = _similar([h[1:] for h in held], radius, least, exact) if len(held) > 1 else []
        if not large:
            return pairs, []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        chief = find(min(h[1] for h in held if h[0]))
        return pairs, [h[1] for h in held if find(h[1]) != chief]

    def run(batches):
        part, shard, held = None, None, []

        def flush(out: dict[str, list]) -> None:
            pairs, rest = found(held, any(h[0] for h in held))
            out["a"] += [a for a, _ in pairs] + rest
            out["b"] += [b for _, b in pairs] + [None] * len(rest)
            out["shard"] += [None] * len(pairs) + [shard] * len(rest)

        for rows in batches:
            out: dict[str, list] = {"a": [], "b": [], "shard": []}
            for p, s, lead, node, fp, *more in rows:
                if p != part:
                    if held:
                        flush(out)
                    part, shard, held = p, s, []
                held.append((lead, node, fp % 2**64, *more))
            yield out
        out = {"a": [], "b": [], "shard": []}
        if held:
            flush(out)
        yield out

    columns = ["part", "shard", "lead", "node", "fp", "sketch", *extra]

    def compared(parts: DataFrame) -> DataFrame:
        rows = described(parts).select(columns).repartition("part").sortWithinPartitions("part")
        return common.staged(common.map_rows(rows, run, "a bigint, b bigint, shard bigint"), "block-links")

    first = compared(dealt)
    links = first.filter("b IS NOT NULL").select("a", "b")
    rest = common.staged(first.filter("b IS NULL").select("shard", F.col("a").alias("node")).distinct(), "unconnected")
    if rest.isEmpty():  # every node is connected to its shard's first leader, so no pair is left to compare
        return links
    asking = rest.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")).join(sizes, "shard")
    asked = keys.join(common.staged(asking, "asking"), "shard").join(rest.withColumn("asks", F.lit(True)), ["shard", "node"], "left")
    places = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("shard", _block(F.col("node"), F.col("blocks")), c))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int")
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("shard", j, chunk))
    places = F.when(F.col("asks"), F.array_union(all_blocks, places)).otherwise(places)
    again = asked.select("shard", "node", F.lit(False).alias("lead"), F.explode(places).alias("part"))
    return links.unionByName(compared(again).select("a", "b"))


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 16, slack: float = 0.12, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, th, rep_id, rep_th) for every row of docs: th is a hash of the text, rep the first (id, th) of the row's group, null ids last.

    At a Jaccard similarity of 0.8, SimHash fingerprints of five-word shingles
    differ in up to about 14 of 64 bits, which bit blocks cannot index.  Here
    the shards of the BK-trees are bands of two min-hashes (eight bands: a
    link of 0.8 shares one with probability 0.9997).  In a shard the sketches
    (standard error at most 0.025) propose what may be similar, from
    similarity - slack on; trees give fingerprints within `radius` first, but
    exclude nothing.  The components of the proposals are groups; each brings
    its texts' shingle sets together, and a link is what those sets' exact
    similarity says.  Equal sets are one node, so exact copies cost one row.
    Shards and groups of any size are worked through in blocks.
    """
    kind = dict(docs.dtypes)[key]
    given = ("part", "shard", "lead", "node", "fp", "sketch")

    def sign(batches):
        for rows in batches:
            signed = [signature(t, shingle) for _, t, _ in rows]
            yield {
                "id": [k for k, _, _ in rows],
                "th": [h for _, _, h in rows],
                "fp": np.array([s[0] for s in signed], dtype=np.uint64).view(np.int64),
                "bands": [np.array(s[1], dtype=np.uint64).view(np.int64).tolist() for s in signed],
                "sketch": [s[2] for s in signed],
                "node": np.array([s[3] for s in signed], dtype=np.uint64).view(np.int64),
            }

    def grams(batches):
        for rows in batches:
            for some in common.by_size(rows, lambda r: len(r[-1] or "")):
                yield {
                    **{c: [r[i] for r in some] for i, c in enumerate(given)},
                    "grams": [np.unique(shingle_hashes(r[-1], shingle)).tobytes() for r in some],
                }

    signed = common.map_rows(docs.select(key, text, F.xxhash64(text)), sign, f"id {kind}, th bigint, fp bigint, bands array<bigint>, sketch binary, node bigint")
    signed = common.staged(signed, "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    nodes = common.staged(signed.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("th", "fp", "bands", "sketch")]), "nodes")
    shards = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("shard"))
    shared = shards.groupBy("shard").count().filter("count > 1").select("shard")
    keys = common.staged(shards.join(shared, "shard"), "shards")
    groups = components(shard_links(keys, lambda parts: parts.join(nodes.select("node", "fp", "sketch"), "node"), radius, similarity - slack, block=block))
    groups = common.staged(groups.select(F.col("root").alias("shard"), "node"), "proposed")
    texts = docs.groupBy(F.xxhash64(text).alias("th")).agg(F.first(text).alias("_text"))

    def with_sets(parts: DataFrame) -> DataFrame:
        rows = parts.join(nodes.select("node", "th", "fp", "sketch"), "node").join(texts, "th")
        return common.map_rows(rows.select(*given, "_text"), grams, "part bigint, shard bigint, lead boolean, node bigint, fp bigint, sketch binary, grams binary")

    found = components(shard_links(groups, with_sets, radius, similarity - slack, similarity, block))
    of = common.staged(nodes.select("node", "first").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "members")
    top = common.staged(of.groupBy("root").agg(F.min("first").alias("rep")), "tops")
    named = common.staged(of.join(top, "root").select("node", "rep"), "named")
    common.release(keys, groups, of, top)
    return signed.select("id", "th", "node").join(named, "node").select("id", "th", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """(key, component_id) for every row: the smallest key among the texts that a chain of similar ones reaches."""
    found = similar_rows(docs, shingle, similarity, key=key, text=text, **bounds)
    return found.select(F.col("id").alias(key), F.col("rep_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """One row of each group of similar documents, with docs' own columns: that of the smallest key, then hash of the text.

    Rows that share a key but not a group are documents of their own and all
    stay.  A row without a key stays only if its group has none with a key.
    Of rows that repeat both key and text one stays, the first by a hash of
    all its columns.
    """
    found = similar_rows(docs, shingle, similarity, key=key, text=text, **bounds)
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))
    rows = common.staged(found.groupBy("id", "th").agg(F.bool_and(~same).alias("gone"), F.count("*").alias("n")).filter("gone OR n > 1"), "not-alone")
    match = docs[key].eqNullSafe(rows["id"]) & (F.xxhash64(docs[text]) == rows["th"])
    alone = docs.join(rows.hint("shuffle_hash"), match, "left_anti")
    again = rows.filter("NOT gone")
    match = docs[key].eqNullSafe(again["id"]) & (F.xxhash64(docs[text]) == again["th"])
    whole = F.struct(*[docs[c] for c in docs.columns])
    several = docs.join(again, match, "left_semi").groupBy(docs[key], F.xxhash64(docs[text])).agg(F.min_by(whole, F.xxhash64(*[docs[c] for c in docs.columns])).alias("row"))
    return alone.unionByName(several.select("row.*"))
