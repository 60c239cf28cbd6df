"""Secret scans by grammar inference.

Fixed patterns find credentials of three kinds; what they find in all texts
are the labelled examples.  For each kind, and within it for each usual length
and alphabet, a prefix tree of the values is built and statistically compatible states are merged (ALERGIA, Carrasco and Oncina),
which gives a probabilistic automaton of the kind's format.  Beside the
frequencies of characters and of stopping, two states must have like
distributions of the number of characters that follow; so an automaton of keys
of one length counts its positions, and one of a prefix keeps it.  Every token
of a text that is at least half as long as the shortest example is a candidate.
It is weighed by what its format says: log2 of its likelihood under each
kind's automaton, less that under the best model of tokens that are no
secrets.  These are ordinary tokens (a chain of characters) and random-looking
ones, which documents have too: any characters of an alphabet (digits, hex,
letters and digits, all), in any length, long ones rarer.  So a token gains
only by what a kind's values share and random ones do not: length, prefix,
places of characters.  A candidate is a secret of a kind if it gains at least
what all but a fiftieth of that kind's labelled values gain that its automaton
was not learned from, less `MARGIN` bits, and at least `LEAST` bits.

What the patterns find always stays; the automata add spans of the kind
`learned`, where no pattern's span overlaps.

Training sample: of the distinct values of each kind in all texts the
`examples` first by a hash, as long as they have `characters` in all (whole
values only); of the ordinary tokens that occur in two of `ordinary_texts`
different texts 20 times as many.  Scanning covers every whole text.

Defined cases: a null text is empty; no finding gives zero counts and empty
strings; without any labelled example nothing is learned and only the patterns
count; repeated rows give repeated rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate; full stops, hyphens and equals signs around a token are not part of it.
TOKEN = re.compile(r"[A-Za-z0-9+/_](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=])?")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of what the patterns find, in order."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _class(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "^$" else "-"


#: How many characters a class (digits, lower, upper case, others, end) has.
_SIZES = {"0": 10, "a": 26, "A": 26, "-": 6, "$": 1}


@dataclass
class Automaton:
    """A probabilistic automaton: per state the log2 probabilities of stopping and of each character it has seen, and where it leads.

    A character that a state has not seen is as likely, for a share of what is
    new there, as in all the values, and leads where its class mostly does (`others`);
    one that no value has is unlikely everywhere (`classes`).
    """

    stop: list[float]
    steps: list[dict[str, tuple[float, int]]]
    classes: list[dict[str, tuple[float, int]]]
    others: list[dict[str, tuple[float, int]]] = field(default_factory=list)

    def step(self, state: int, c: str) -> tuple[float, int]:
        return self.steps[state].get(c) or (self.others and self.others[state].get(c)) or self.classes[state][_class(c)]

    def bits(self, token: str, least: float = -math.inf) -> float:
        """log2 of the token's probability; -inf as soon as it is known to be below `least`."""
        state, total = 0, 0.0
        for c in token:
            more, state = self.step(state, c)
            total += more
            if total < least:
                return -math.inf
        return total + self.stop[state]


def infer(values: list[str], alpha: float = 0.05) -> Automaton:
    """Merges compatible states of the values' prefix tree, in red-blue order.

    Two states are compatible if their frequencies of stopping and of each
    character, and the distributions of the number of characters that follow,
    differ by less than Hoeffding's (and Kolmogorov's) bound at `alpha`, and so
    do their successors'.  Distributions without a common length never agree,
    however few values have passed.  Of several compatible red states the one
    of the likest lengths is taken, so that a state seen once goes where its
    length belongs.
    """
    visits, ends, links, rest = [0], [0], [{}], [Counter()]
    for value in values:
        state = 0
        visits[0] += 1
        rest[0][len(value)] += 1
        for i, c in enumerate(value):
            if c not in links[state]:
                links[state][c] = len(visits)
                visits.append(0)
                ends.append(0)
                links.append({})
                rest.append(Counter())
            state = links[state][c]
            visits[state] += 1
            rest[state][len(value) - i - 1] += 1
        ends[state] += 1
    log = math.sqrt(0.5 * math.log(2 / alpha))
    count = [{c: visits[t] for c, t in x.items()} for x in links]

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > log * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def apart(a: int, b: int) -> float:
        """Largest difference of the two distributions of lengths to come; 1 if they share none."""
        if not rest[a].keys() & rest[b].keys():
            return 1.0
        below, most = 0.0, 0.0
        for n in sorted({*rest[a], *rest[b]}):
            below += rest[a][n] / visits[a] - rest[b][n] / visits[b]
            most = max(most, abs(below))
        return most

    def compatible(a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if differ(ends[a], visits[a], ends[b], visits[b]):
                return False
            if apart(a, b) > min(0.999, log * (1 / math.sqrt(visits[a]) + 1 / math.sqrt(visits[b]))):
                return False
            for c in {*count[a], *count[b]}:
                if differ(count[a].get(c, 0), visits[a], count[b].get(c, 0), visits[b]):
                    return False
                if c in links[a] and c in links[b]:
                    stack.append((links[a][c], links[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            rest[a] += rest[b]
            for c, t in links[b].items():
                count[a][c] = count[a].get(c, 0) + count[b][c]
                if c in links[a]:
                    stack.append((links[a][c], t))
                else:
                    links[a][c] = t

    red, blue = [0], [(0, c) for c in sorted(links[0])]
    is_red = {0}
    while blue:
        parent, c = max(blue, key=lambda e: (visits[links[e[0]][e[1]]], -e[0], e[1]))
        state = links[parent][c]
        fits = [r for r in red if compatible(r, state)]
        if fits:
            best = min(fits, key=lambda r: apart(r, state))
            links[parent][c] = best
            fold(best, state)
        else:
            red.append(state)
            is_red.add(state)
        blue = [(r, x) for r in red for x in links[r] if links[r][x] not in is_red]
    number = {state: i for i, state in enumerate(red)}
    letters = Counter("".join(values))
    all_letters = sum(letters.values())
    stop, steps, classes, others = [], [], [], []
    for state in red:
        total = visits[state]
        weight = float(len(count[state]) + (ends[state] > 0))  # as often as something new has come (Witten and Bell)
        ways: dict[str, Counter] = {}
        for c, n in count[state].items():
            ways.setdefault(_class(c), Counter())[number[links[state][c]]] += n
        usual = sum(ways.values(), Counter()).most_common(1)
        to = {k: ways[k].most_common(1)[0][0] if k in ways else usual[0][0] if usual else number[state] for k in _SIZES}
        # something new is the end as often as here, else a character as often as in all values, and seldom another one
        ending = (ends[state] + 0.01) / (total + 0.05)
        share = lambda n, of, total=total, weight=weight: math.log2((n + weight * of) / (total + weight))
        stop.append(share(ends[state], ending))
        told = {c: (share(count[state].get(c, 0), (1 - ending) * 0.99 * n / all_letters), number[links[state][c]] if c in count[state] else to[_class(c)]) for c, n in letters.items()}
        steps.append({c: x for c, x in told.items() if c in count[state]})
        others.append({c: x for c, x in told.items() if c not in count[state]})
        classes.append({k: (share(0, (1 - ending) * 0.01 / 5 / size), to[k]) for k, size in _SIZES.items()})
    return Automaton(stop, steps, classes, others)


@dataclass
class Background:
    """Ordinary tokens as a chain of characters, smoothed by the chain of their classes (digits, lower, upper case, others)."""

    pairs: Counter = field(default_factory=Counter)
    singles: Counter = field(default_factory=Counter)

    def fit(self, tokens: list[str]) -> "Background":
        for t in tokens:
            marked = f"^{t}$"
            for chain in (marked, f"{''.join(map(_class, marked))}"):
                tag = "" if chain is marked else "class "
                self.pairs.update((tag + a, b) for a, b in zip(chain, chain[1:], strict=False))
                self.singles.update(tag + a for a in chain[:-1])
        return self

    def bits(self, token: str, weight: float = 10.0) -> float:
        total, a = 0.0, "^"
        for b in f"{token}$":
            of, to = "class " + _class(a), _class(b)
            kept = 5.0 if _class(a) == to else 0.2  # runs of one class, numbers above all, are ordinary
            like = (self.pairs[of, to] + kept) / (self.singles[of] + 6.0) / _SIZES[to]
            total += math.log2((self.pairs[a, b] + weight * like) / (self.singles[a] + weight))
            a = b
        return total


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What random-looking ordinary tokens are made of, the narrowest first; each is as likely as the others.
ALPHABETS = [frozenset(x) for x in (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "0123456789.", "0123456789abcdef-", _UPPER.lower(), _UPPER, _UPPER + "0123456789", _UPPER.lower() + "0123456789",
    _UPPER + _UPPER.lower(), _UPPER + _UPPER.lower() + "0123456789", _UPPER + _UPPER.lower() + "0123456789+/_.=-",
)]
_COSTS = [math.log2(len(x)) for x in ALPHABETS]
#: Bits that a candidate must gain at least, and that it may gain less than the kind's own values.
LEAST, MARGIN = 2.0, 2.0
#: Values of one length and alphabet that are taken for a format of their own.
SHAPED = 8


def random_bits(token: str) -> float:
    """log2 of the likelihood of a random-looking ordinary token: an alphabet, a length n with probability 1 / (n (n + 1)), and characters alike."""
    used, n = frozenset(token), len(token)
    cost = next((c for a, c in zip(ALPHABETS, _COSTS, strict=True) if used <= a), 8.0)
    return -math.log2(len(ALPHABETS)) - math.log2(n * (n + 1)) - n * cost


@dataclass
class Grammar:
    """The automata of the labelled kinds, what a candidate must gain by each, the ordinary tokens' model and the shortest candidate."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    background: Background = field(default_factory=Background)
    shortest: int = 6
    least: dict[str, float] = field(default_factory=dict)
    _known: dict[str, tuple[float, float]] = field(default_factory=dict, repr=False, compare=False)

    def gain(self, kind: str, token: str) -> float:
        """How many bits likelier the token is as a value of the kind than as an ordinary or random one."""
        return self.automata[kind].bits(token) - max(random_bits(token), self.background.bits(token))

    def score(self, token: str) -> tuple[float, float]:
        """log2 of the likelihood under the automaton that the token gains most by, and its gain above what that kind asks; -inf: none comes near."""
        held = self._known.get(token)
        if held is None:
            floor, held = random_bits(token), (-math.inf, -math.inf)
            for kind, automaton in self.automata.items():
                bits = automaton.bits(token, floor + self.least.get(kind, LEAST))
                if bits > -math.inf:
                    held = max(held, (bits - max(floor, self.background.bits(token)) - self.least.get(kind, LEAST), bits))
            held = held[1], held[0]
            if len(self._known) > 100_000:
                self._known.clear()
            if len(token) <= 64:
                self._known[token] = held
        return held

    def bits(self, token: str) -> float:
        """log2 of the greatest likelihood under an automaton."""
        return max((a.bits(token) for a in self.automata.values()), default=-math.inf)

    def spans(self, text: str) -> list[tuple[int, int, int, float | None]]:
        """(start, kind number, end, log2 likelihood) of what the patterns find and the candidates that the automata accept."""
        base = base_spans(text)
        out = [(s, k, e, self.bits(text[v:e]) if self.automata else None) for s, k, e, v in base]
        if self.automata:
            edges, at, reach = [(s, e) for s, _, e, _ in base], 0, 0
            for m in TOKEN.finditer(text):
                start, end = m.span()
                if end - start < self.shortest:
                    continue
                while at < len(edges) and edges[at][0] < end:
                    reach = max(reach, edges[at][1])
                    at += 1
                if reach <= start:
                    bits, above = self.score(m[0])
                    if above >= 0:
                        out.append((start, 3, end, bits))
        return sorted(out)


def learn(docs: DataFrame, examples: int = 300, characters: int = 20_000, least_examples: int = 5, ordinary_texts: int = 2000, text: str = "text") -> Grammar:
    """Automata of the kinds that have at least `least_examples` distinct values."""

    def labelled(batches):
        """The first values by hash of each kind in a task."""
        import xxhash

        held: dict[str, dict[str, int]] = {}
        for rows in batches:
            for (t,) in rows:
                for _, k, e, v in base_spans(t or ""):
                    value = t[v:e]
                    held.setdefault(KINDS[k], {})[value] = xxhash.xxh64_intdigest(value.encode(), 7) >> 1
            for k, of in held.items():
                if len(of) > 2 * examples:
                    held[k] = dict(sorted(of.items(), key=lambda x: (x[1], x[0]))[:examples])
        flat = [(k, v, h) for k, of in held.items() for v, h in of.items()]
        yield {"kind": [k for k, _, _ in flat], "value": [v for _, v, _ in flat], "h": [h for _, _, h in flat]}

    def ordinary(batches):
        for rows in batches:
            for (t,) in rows:
                parts, at = [], 0
                for s, _, e, _ in base_spans(t):
                    parts.append(t[at:s])
                    at = max(at, e)
                yield {"value": [x for x in set(TOKEN.findall("\n".join([*parts, t[at:]]))) if len(x) >= 6]}

    values = common.staged(common.map_rows(docs.select(text), labelled, "kind string, value string, h bigint").distinct(), "labelled-values")
    by_kind: dict[str, list[str]] = {}
    for k in KINDS[:3]:  # take-ordered: of each task no more rows than are wanted in all
        top = values.filter(F.col("kind") == k).orderBy("h", "value").limit(examples)
        by_kind[k] = _within([r["value"] for r in top.select("value").collect()], characters)
    common.release(values)
    order = F.xxhash64(F.lit("ordinary"), text)
    share = min(1.0, 2 * ordinary_texts / max(docs.count(), 1))
    sample = docs.filter(F.col(text).isNotNull() & (F.pmod(order, F.lit(1 << 20)) < (1 << 20) * share)).groupBy(order.alias("o")).agg(F.min(text).alias("t"))  # different texts
    sample = sample.orderBy("o").limit(ordinary_texts).select("t")
    tokens = common.map_rows(sample, ordinary, "value string").groupBy("value").count().filter("count > 1")  # a hidden secret occurs once
    tokens = tokens.orderBy(F.xxhash64("value"), "value").limit(20 * examples)
    return fit({k: v for k, v in by_kind.items() if len(v) >= least_examples}, [r["value"] for r in tokens.select("value").collect()])


def _within(values: list[str], characters: int) -> list[str]:
    """The first values that have so many characters in all."""
    out = []
    for v in values:
        if len(v) <= characters:
            out.append(v)
            characters -= len(v)
    return out


def shapes(values: list[str]) -> list[list[str]]:
    """Values of a length and alphabet that at least `SHAPED` of them share, most first, then all others; each list in the values' order.

    A kind's values may be of several formats, and a few values of one are not
    unlike another's at most places of the tree; those of one shape are
    learned by themselves, and what has no usual shape together.
    """
    alphabet = lambda v: next((i for i, a in enumerate(ALPHABETS) if set(v) <= a), len(ALPHABETS))
    groups: dict[tuple[int, int], list[str]] = {}
    for v in values:
        groups.setdefault((len(v), alphabet(v)), []).append(v)
    usual = {k for k, g in groups.items() if len(g) >= SHAPED}
    rest = [v for v in values if (len(v), alphabet(v)) not in usual]
    found = sorted((groups[k] for k in usual), key=lambda g: (-len(g), g[0]))
    return [*found, rest] if len(rest) >= SHAPED or not found else found


def fit(values: dict[str, list[str]], ordinary: list[str]) -> Grammar:
    """Automata of the kinds' values, by shape, each with what it takes to be told one of them: from every fourth value, held out.

    The first automaton of a kind has its name, the others have numbers.
    """
    grammar = Grammar(background=Background().fit(ordinary))
    whole: dict[str, Automaton] = {}
    for kind, known in values.items():
        for n, group in enumerate(shapes(known)):
            name = kind if not n else f"{kind} {n + 1}"
            grammar.automata = {name: infer([v for i, v in enumerate(group) if i % 4 != 3])}
            gains = sorted(grammar.gain(name, v) for i, v in enumerate(group) if i % 4 == 3)
            grammar.least[name] = max(LEAST, gains[len(gains) // 50] - MARGIN) if gains else LEAST
            whole[name] = infer(group)
    grammar.automata = whole
    grammar.shortest = max(6, min((len(x) for known in values.values() for x in known), default=0) // 2)
    return grammar


def scan(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for every row: spans is an array of (kind, start, end, bits), in code points, by start, then kind.

    bits is log2 of the value's likelihood under the best automaton (null where nothing was learned).
    """
    kind = dict(docs.dtypes)[key]
    held = common.Shipped(docs.sparkSession, grammar)  # bounded by the examples it was learned from

    def run(batches):
        for rows in batches:
            yield {key: [k for k, _ in rows], "spans": [[{"kind": KINDS[n], "start": s, "end": e, "bits": b} for s, n, e, b in held.value.spans(t or "")] for _, t in rows]}

    return common.map_rows(docs.select(key, text), run, f"{key} {kind}, spans array<struct<kind string, start bigint, end bigint, bits double>>")


def digest(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

