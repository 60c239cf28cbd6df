"""Language identification with a linear-chain conditional random field.

Every word of a text is a position of the chain.  A word's features are its
prefixes and suffixes, character n-grams, its own identity and membership in
lexicons learned from the training words; transition weights between the
languages of neighbouring words are learned too.  Forward-backward gives each
word's distribution over languages, so code-switched text is labelled word by
word (`label_words`); a document gets the language with the largest share of its letters.

Training: the labels are those of documents, so chains are made by joining
runs of words from several labelled documents (code-switching with known
switch points).  The model is fitted on a bounded sample of whole texts:
`docs_per_lang` different ones of each language in the order of a hash, with
`chars_per_lang` characters in all.  Statistics needed for the sample
(documents per language) cover all rows.

Prediction takes the text alone and reads all of it.

The chain's languages share each word among them even where none fits, so a
text in another language is told by its words: `familiar` is the share of
letters in words whose character trigrams mostly occur in the training words.

Defined cases: null text or a text without a letter gives `und` and score 0;
ties between languages go to the first in sorted order; repeated rows are
separate rows; without any labelled row, every text is `und` with score 0; an
empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
BUCKETS = 1 << 18
#: Tokens in a block of the forward-backward pass.
BLOCK = 48
WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- features


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    """Bucket numbers of unsigned 64-bit values, for one kind of feature."""
    h = (values + np.uint64(salt << 40)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words, one after the other, and where each word's begin.

    A word w is read as "^w$".  N-grams of one to three characters, prefixes
    and suffixes of two to four (with the boundary mark) and the whole word.
    """
    marked = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[word]
    left = lengths[word] - place
    step = np.uint64(0x100000001B3)
    two = codes[:-1] * step + codes[1:]
    three = two[:-1] * step + codes[2:]
    four = three[:-1] * step + codes[3:]
    owners, buckets = [], []

    def add(at: np.ndarray, values: np.ndarray, salt: int) -> None:
        owners.append(word[at])
        buckets.append(_hash(values, salt))

    inner = np.flatnonzero((place > 0) & (left > 1))
    add(inner, codes[inner], 1)
    for n, grams in ((2, two), (3, three)):
        at = np.flatnonzero(left[: len(grams)] >= n)
        add(at, grams[at], n)
    for n, grams in ((2, two), (3, three), (4, four)):
        long = lengths >= n + 1
        add(starts[long], grams[starts[long]], 10 + n)
        ends = starts[long] + lengths[long] - n
        add(ends, grams[ends], 20 + n)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), step, dtype=np.uint64))
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(codes * powers[place], starts) if len(words) else np.zeros(0, np.uint64)
    add(starts, whole, 30)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(buckets)[order], np.cumsum(counts) - counts


class Model:
    """Weights of the chain; emissions are sums of feature weights, a lexicon's included."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, n), dtype=np.float32)
        self.lexicon: dict[str, int] = {}
        self.lexicon_weight = np.zeros((n, n), dtype=np.float32)
        self.transition = np.zeros((n, n), dtype=np.float32)
        self.trigrams: frozenset[str] = frozenset()

    def familiar(self, word: str) -> bool:
        """Whether at least three quarters of the word's trigrams, boundaries included, occur in the training words."""
        marked = f"^{word}$"
        return 4 * sum(marked[i : i + 3] in self.trigrams for i in range(len(marked) - 2)) >= 3 * (len(marked) - 2)

    def emissions(self, words: list[str]) -> np.ndarray:
        buckets, starts = features(words)
        scores = np.add.reduceat(self.weights[buckets], starts, axis=0)
        member = np.fromiter((self.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        scores[member >= 0] += self.lexicon_weight[member[member >= 0]]
        return scores

    # ------------------------------------------------------------ inference

    def shares(self, text: str) -> np.ndarray | None:
        """Each language's share of the letters of a text; None if there is no letter."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray | None]:
        return [None if found is None else found[0] for found in self.judged(texts)]

    def judged(self, texts: list[str]) -> list[tuple[np.ndarray, float] | None]:
        """Each language's share of the letters of each text, and the share of letters in familiar words."""
        counts = []
        known: dict[str, int] = {}
        pieces = []
        for text in texts:
            n = 0
            for part in _words(text):
                known.update((w, i) for i, w in enumerate(set(part).difference(known), len(known)))
                pieces.append(np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part)))
                n += len(part)
            counts.append(n)
        if not known:
            return [None] * len(texts)
        words = list(known)
        letters = np.fromiter(map(_letters, words), dtype=np.float32, count=len(words))
        index = np.concatenate(pieces)
        spelt = letters[index] > 0
        owner = np.repeat(np.arange(len(texts)), counts)[spelt]
        counts = np.bincount(owner, minlength=len(texts))
        index = index[spelt]
        if not len(index):
            return [None] * len(texts)
        weight = letters[index]
        gamma = self._posterior(self.emissions(words)[index], counts[counts > 0])
        begin = (np.cumsum(counts) - counts)[counts > 0]
        sums = np.add.reduceat(gamma * weight[:, None], begin, axis=0)
        usual = np.fromiter(map(self.familiar, words), dtype=np.float32, count=len(words))[index]
        shares = np.add.reduceat(weight * usual, begin) / np.add.reduceat(weight, begin)
        out: list[tuple[np.ndarray, float] | None] = [None] * len(texts)
        for at, share, usual_share in zip(np.flatnonzero(counts), sums, shares, strict=True):
            out[at] = share / share.sum(), float(usual_share)
        return out

    def words(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, probability) of each word of a text that has a letter, in order."""
        spans = [(m.start(), m.end()) for m in WORD.finditer(text) if _letters(m[0])]
        if not spans:
            return []
        forms = [text[a:z].lower() for a, z in spans]
        gamma = self._posterior(self.emissions(forms), np.array([len(forms)]))
        best = gamma.argmax(axis=1)
        return [(a, z, self.languages[k], float(g[k])) for (a, z), k, g in zip(spans, best, gamma, strict=True)]

    def _posterior(self, emission: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Posterior of each token by forward-backward; counts are the chains' lengths.

        Chains are cut into blocks whose transfer matrices are computed side
        by side; vectors at the block borders then follow chain by chain.
        """
        n = emission.shape[1]
        blocks = -(-counts // BLOCK)
        chain = np.repeat(np.arange(len(counts)), blocks)
        first = np.cumsum(blocks) - blocks
        inside = np.arange(len(chain)) - first[chain]
        begin = (np.cumsum(counts) - counts)[chain] + inside * BLOCK
        size = np.minimum(BLOCK, counts[chain] - inside * BLOCK)
        at = begin[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
        e = np.exp(emission - emission.max(axis=1, keepdims=True))[at]  # block, token, language
        e = np.maximum(e, 1e-30)
        live = np.arange(BLOCK) < size[:, None]
        t = np.exp(self.transition - self.transition.max())
        b = len(chain)
        transfer = np.tile(np.eye(n, dtype=np.float32), (b, 1, 1))
        for k in range(BLOCK):
            step = transfer @ t
            if k == 0:
                step[inside == 0] = np.eye(n, dtype=np.float32)
            step = step * e[:, k, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            transfer = np.where(live[:, k, None, None], step, transfer) if not live[:, k].all() else step
        before = np.ones((b, n), dtype=np.float32)
        after = np.ones((b, n), dtype=np.float32)
        for j in range(1, int(blocks.max())):
            at_j = first[blocks > j] + j
            v = np.einsum("bi,bij->bj", before[at_j - 1], transfer[at_j - 1])
            before[at_j] = v / v.max(axis=1, keepdims=True)
        last = first + blocks - 1
        for j in range(1, int(blocks.max())):
            at_j = last[blocks > j] - j
            v = np.einsum("bij,bj->bi", transfer[at_j + 1], after[at_j + 1])
            after[at_j] = v / v.max(axis=1, keepdims=True)
        forward = np.empty((BLOCK, b, n), dtype=np.float32)
        v = before
        for k in range(BLOCK):
            moved = v @ t
            if k == 0:
                moved = np.where((inside == 0)[:, None], 1.0, moved)
            moved = moved * e[:, k]
            moved /= moved.max(axis=1, keepdims=True)
            v = np.where(live[:, k, None], moved, v)
            forward[k] = v
        out = np.empty((len(emission), n), dtype=np.float32)
        v = after
        for k in range(BLOCK - 1, -1, -1):
            gamma = forward[k] * v
            gamma /= gamma.sum(axis=1, keepdims=True)
            out[at[live[:, k], k]] = gamma[live[:, k]]
            moved = (v * e[:, k]) @ t.T
            moved /= moved.max(axis=1, keepdims=True)
            v = np.where(live[:, k, None], moved, v)
        return out

    # ------------------------------------------------------------- training

    def fit(self, labelled: list[tuple[str, str]], length: int = 24, epochs: int = 4, batch: int = 256, rate: float = 0.25, l2: float = 1e-4) -> "Model":
        """AdaGrad on the conditional log-likelihood of chains with known languages."""
        n, rng = len(self.languages), np.random.default_rng(7)
        number = {x: i for i, x in enumerate(self.languages)}
        runs = [(number[lang], words) for lang, text in labelled if len(words := [w for part in _words(text) for w in part if any(map(str.isalpha, w))]) > 0]
        if not runs:
            return self
        seen: dict[str, np.ndarray] = {}
        for lang, words in runs:
            for w in words:
                seen.setdefault(w, np.zeros(n))[lang] += 1
        self.trigrams = frozenset(f"^{w}$"[i : i + 3] for w, c in seen.items() if c.sum() > 1 for i in range(len(w)))
        self.lexicon = {w: int(c.argmax()) for w, c in seen.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}
        by_lang = [np.array([seen_at for seen_at, (lang, _) in enumerate(runs) if lang == k]) for k in range(n)]
        present = [k for k in range(n) if len(by_lang[k])]
        vocabulary = {w: i for i, w in enumerate(seen)}
        encoded = [np.array([vocabulary[w] for w in words]) for _, words in runs]
        buckets, starts = features(list(vocabulary))
        ends = np.append(starts[1:], len(buckets))
        member = np.array([self.lexicon.get(w, -1) for w in vocabulary])
        chains = sum(len(x) for x in encoded) // length + 1
        grad_sq = np.full(self.weights.shape, 1e-2, dtype=np.float32)
        lex_sq, trans_sq = np.full((n, n), 1e-2), np.full((n, n), 1e-2)
        for step in range(max(8, epochs * chains // batch)):
            words, gold = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
            for i in range(batch):
                cuts = sorted({0, *rng.integers(1, length, rng.integers(0, 3)).tolist()}) + [length]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    lang = present[rng.integers(len(present))]
                    run = encoded[by_lang[lang][rng.integers(len(by_lang[lang]))]]
                    at = rng.integers(len(run)) + np.arange(z - a)
                    words[i, a:z], gold[i, a:z] = run[at % len(run)], lang
            unique, index = np.unique(words, return_inverse=True)
            index = index.reshape(words.shape)
            feats = np.concatenate([buckets[starts[u] : ends[u]] for u in unique])
            sizes = ends[unique] - starts[unique]
            offsets = np.cumsum(sizes) - sizes
            scores = np.add.reduceat(self.weights[feats], offsets, axis=0)
            known = member[unique] >= 0
            scores[known] += self.lexicon_weight[member[unique][known]]
            gamma, pairs = self._expectations(scores[index])
            gamma[np.arange(batch)[:, None], np.arange(length), gold] -= 1
            np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            g_word = np.stack([np.bincount(index.ravel(), weights=gamma[:, :, k].ravel(), minlength=len(unique)) for k in range(n)], axis=1) / batch
            touched, where = np.unique(feats, return_inverse=True)
            owner = np.repeat(np.arange(len(unique)), sizes)
            g = np.stack([np.bincount(where, weights=g_word[owner, k], minlength=len(touched)) for k in range(n)], axis=1)
            g += l2 * self.weights[touched]
            grad_sq[touched] += g**2
            self.weights[touched] -= (rate * g / np.sqrt(grad_sq[touched])).astype(np.float32)
            g_lex = np.zeros((n, n))
            np.add.at(g_lex, member[unique][known], g_word[known])
            for value, g, sq in ((self.lexicon_weight, g_lex, lex_sq), (self.transition, pairs / batch, trans_sq)):
                g = g + l2 * value
                sq += g**2
                value -= (rate * g / np.sqrt(sq)).astype(np.float32)
        return self

    def _expectations(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each token and the sum of the posteriors of neighbouring pairs; chains of one length."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
        t = np.exp(self.transition - self.transition.max()).astype(np.float64)
        rows, length, n = e.shape
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = e[:, 0]
        for k in range(1, length):
            v = (forward[:, k - 1] @ t) * e[:, k]
            forward[:, k] = v / v.sum(axis=1, keepdims=True)
        for k in range(length - 2, -1, -1):
            v = (backward[:, k + 1] * e[:, k + 1]) @ t.T
            backward[:, k] = v / v.sum(axis=1, keepdims=True)
        gamma = forward * backward
        gamma /= gamma.sum(axis=2, keepdims=True)
        pairs = np.zeros((n, n))
        for k in range(1, length):
            p = forward[:, k - 1, :, None] * t * (e[:, k] * backward[:, k])[:, None, :]
            pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return gamma, pairs


def _letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def _words(text: str) -> Iterator[list[str]]:
    """Lower-case words of a text, in pieces of bounded length that never cut a word."""
    start, end = 0, len(text)
    while start < end:
        stop = min(end, start + common.CHARS_PER_STEP)
        while stop < end and (text[stop].isalnum() or text[stop] == "_"):
            stop += 1
        yield WORD.findall(text[start:stop].lower())
        start = stop


# --------------------------------------------------------------------- Spark


def train(docs: DataFrame, docs_per_lang: int = 250, chars_per_lang: int = 800_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fits a model on a bounded sample of the labelled rows of docs.

    The number of languages is taken to be small (one row each on the driver).
    The sample is, of each language's different texts in the order of a hash,
    at most docs_per_lang, and as many of them as have chars_per_lang
    characters in all; texts are whole.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return None
    own = F.xxhash64(text)
    order = common.hash_share(F.col(key), own, seed="language-sample")
    bound = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, 3.0 * docs_per_lang / v))])
    sample = labelled.filter(order < bound[F.col(lang)]).groupBy(F.col(lang).alias("lang"), own.alias("own")).agg(F.min(order).alias("o"), F.min(text).alias("t"))
    place = Window.partitionBy("lang").orderBy("o", "own")
    first = sample.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= docs_per_lang)  # cut by tasks before it is sorted
    within = F.sum(F.length("t")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    rows = first.withColumn("upto", within).filter((F.col("upto") <= chars_per_lang) | (F.col("n") == 1)).orderBy("lang", "n").select("lang", "t").collect()
    return Model(sorted(counts)).fit([(r["lang"], r["t"]) for r in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred (string), score and familiar (doubles) to docs, from the text column alone; columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    spark = docs.sparkSession
    common.prepare(spark)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "familiar")]
    names = [f.name for f in kept]
    if model is None:
        return docs.select(*names, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("familiar"))
    held = common.Shipped(spark, model)  # of a fixed size: BUCKETS times the number of languages
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("familiar", DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            pred, score, usual = [], [], []
            for group in common.by_size(texts, lambda x: len(x or "")):
                for found in held.value.judged([x or "" for x in group]):
                    share, familiar = found or (None, 0.0)
                    best = None if share is None else int(share.argmax())
                    pred.append(UNDETERMINED if best is None else held.value.languages[best])
                    score.append(0.0 if best is None else min(1.0, max(0.0, float(share[best]))))
                    usual.append(min(1.0, familiar))
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(usual, pa.float64())], names=[*names, "lang_pred", "score", "familiar"])

    return docs.select(*names).mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words) for every row: each word's start and end (code points), language and its probability, in order."""
    kind = dict(docs.dtypes)[key]
    held = common.Shipped(docs.sparkSession, model)

    def run(batches):
        for rows in batches:
            for part in common.by_size(rows, lambda r: len(r[1] or "")):
                words = [[{"start": a, "end": z, "lang": lang, "p": p} for a, z, lang, p in held.value.words(t or "")] for _, t in part]
                yield {key: [k for k, _ in part], "words": words}

    return common.map_rows(docs.select(key, text), run, f"{key} {kind}, words array<struct<start bigint, end bigint, lang string, p double>>")


def held_out(key: str = "doc_id") -> F.Column:
    """True for the quarter of the ids that a model must not learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
