"""Scalar functions as column expressions: names, numbers, dates, maps, JSON and probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and roles as providers write them.
TEAM_SUFFIXES = ("fc", "calcio", "club", "ac", "ssc", "ss", "as", "cf")
TEAM_ALIASES = {
    "acf fiorentina": "fiorentina",
    "ars et labor ferrara": "spal",
    "atalanta bergamasca": "atalanta",
    "bologna 1909": "bologna",
    "carpi 1909": "carpi",
    "chievoverona": "chievo",
    "como 1907": "como",
    "delfino pescara 1936": "pescara",
    "genoa cfc": "genoa",
    "hellas verona": "verona",
    "internazionale": "inter",
    "internazionale milano": "inter",
    "parma 1913": "parma",
    "pisa sporting": "pisa",
    "spal 2013": "spal",
    "uc sampdoria": "sampdoria",
    "us cremonese": "cremonese",
    "us lecce": "lecce",
    "us salernitana 1919": "salernitana",
    "us sassuolo": "sassuolo",
}
FOOTBALL_ROLES = {
    "gk": "GK",
    "goalkeeper": "GK",
    "portiere": "GK",
    "por": "GK",
    "def": "DEF",
    "defender": "DEF",
    "difensore": "DEF",
    "wing back": "DEF",
    "full back": "DEF",
    "centre back": "DEF",
    "center back": "DEF",
    "mid": "MID",
    "midfielder": "MID",
    "centrocampista": "MID",
    "defensive midfielder": "MID",
    "attacking midfielder": "MID",
    "fwd": "FWD",
    "forward": "FWD",
    "striker": "FWD",
    "attaccante": "FWD",
}
FANTASY_ROLES = {
    "gk": "GK",
    "goalkeeper": "GK",
    "portiere": "GK",
    "por": "Por",
    "def": "DEF",
    "defender": "DEF",
    "difensore": "DEF",
    "mid": "MID",
    "midfielder": "MID",
    "centrocampista": "MID",
    "fwd": "FWD",
    "forward": "FWD",
    "attaccante": "FWD",
}
LETTER_ROLES = {"p": "GK", "d": "DEF", "c": "MID", "a": "FWD"}
# End of the fixed values.


def folded(text: Column) -> Column:
    """Full compatibility decomposition without combining marks, case folded; Spark has no such function, so an Arrow UDF."""

    def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t if t is None else t.lower()
            return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()

        for series in texts:
            yield series.map(one, na_action="ignore")

    return F.pandas_udf(fold, "string")(text)


def normalize_name(text: Column, drop: Sequence[str] = ()) -> Column:
    """Case folded without accents, letters a-z and digits only, single spaces, without the words of `drop`."""
    tokens = F.split(F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(list(drop) or [""])), " ")


def normalize_team(text: Column) -> Column:
    """As for names, with dotted initials joined, club words dropped and aliases resolved."""
    joined = folded(text)
    for n in range(8, 1, -1):  # longest runs of initials first
        joined = F.regexp_replace(joined, r"\b" + r"([a-z])\." * n, "".join(f"${k}" for k in range(1, n + 1)))
    tokens = F.split(F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " ")), " ")
    name = F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(list(TEAM_SUFFIXES))), " ")
    return F.coalesce(lookup(name, TEAM_ALIASES), name)


def football_role(position: Column) -> Column:
    """GK, DEF, MID or FWD of a position's words; null for others."""
    return lookup(F.trim(F.regexp_replace(F.lower(position), r"[-\s]+", " ")), FOOTBALL_ROLES)


def fantasy_role(role: Column, position: Column) -> Column:
    """A list's role by its aliases, else as a football role, else as written; without one, the position's role."""
    value = F.trim(F.when(role != "", role).otherwise(position))
    own = F.coalesce(lookup(F.regexp_replace(normalize_name(value), " ", ""), FANTASY_ROLES), football_role(value), value)
    return F.when(role.isNull(), football_role(position)).when(value != "", own)


def role_token(token: Column) -> Column:
    """A role from one token of a pasted list: a word, a letter or a canonical name."""
    lower, upper = F.lower(F.trim(token)), F.upper(F.trim(token))
    words = {k: v for k, v in FOOTBALL_ROLES.items() if " " not in k}
    return F.coalesce(lookup(lower, words), lookup(lower, LETTER_ROLES), F.when(upper.isin("GK", "DEF", "MID", "FWD"), upper))


def photo_name_score(target: Column, name: Column, first: Column, last: Column) -> Column:
    """100 for equal names; 90 if the initial and the surname's words agree, 80 if the name's other words do; else 0."""
    inside = lambda words: F.concat(F.lit(" "), target, F.lit(" ")).contains(F.concat(F.lit(" "), words, F.lit(" ")))
    initial = F.substring(F.when(first != "", first).otherwise(name), 1, 1)
    rest = F.when(name.contains(" "), F.regexp_replace(name, "^[^ ]+ ", ""))
    agrees = (initial != "") & (F.substring(target, 1, 1) == initial)
    return F.when(target == name, 100).when(~agrees, 0).when((last != "") & inside(last), 90).when(inside(rest), 80).otherwise(0)


def decimal(text: Column) -> Column:
    """A number that is not negative, with a decimal comma or point; else null."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value >= 0, value)


def to_utc(text: Column, zone: str = "UTC") -> Column:
    """A time from an ISO text or day; texts without an offset are in `zone`."""
    marked = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(marked, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone))


def elapsed(start: Column, minute: Column, second: Column | None = None) -> Column:
    """A time so many minutes and seconds after the start."""
    seconds = F.coalesce(minute.cast("bigint"), F.lit(0)) * 60 + (F.lit(0) if second is None else F.coalesce(second.cast("bigint"), F.lit(0)))
    return F.timestamp_add("SECOND", seconds, start)


def full_name(*parts: Column, fallback: Column) -> Column:
    """The parts that there are, spaced; without any, the fallback."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])), F.lit("")), fallback)


def all_present(*values: Column) -> Column:
    """1 if none of the values is null, else 0."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull()
    return out.cast("int")


def json_paths(text: Column) -> Column:
    """Sorted distinct paths of a JSON text's leaves, such as $.a.b[]; null if it does not parse.

    The depth is open, which no built-in function follows, so an Arrow UDF.
    """

    def shape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        def walk(value, path, out):
            if isinstance(value, dict) and value:
                for k, v in value.items():
                    walk(v, f"{path}.{k}", out)
            elif isinstance(value, list) and value:
                for v in value:
                    walk(v, f"{path}[]", out)
            else:
                out.add(path)

        def one(t):
            try:
                out: set[str] = set()
                walk(json.loads(t), "$", out)
                return sorted(out)
            except (TypeError, ValueError):
                return None

        for series in texts:
            yield series.map(one)

    return F.pandas_udf(shape, "array<string>")(text)


def json_set(text: Column, key: str, value: Column) -> Column:
    """An object of plain values with one key set, keys in order of their name; null if the text is no object."""
    old = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k != key)
    entries = F.array_sort(F.map_entries(F.map_concat(old, F.create_map(F.lit(key), value.cast("string")))))
    return F.to_json(F.map_from_entries(entries))


def corroborated(a: Column, b: Column) -> Column:
    """Equal normalized names, or equal tails and first initials where one first name is an initial."""
    x, y = F.split(a, " "), F.split(b, " ")
    head = lambda v: F.element_at(v, 1)
    tail = lambda v: F.slice(v, 2, F.size(v))
    initial = (F.length(head(x)) == 1) | (F.length(head(y)) == 1)
    return (a == b) | ((F.size(x) > 1) & (F.size(y) > 1) & (tail(x) == tail(y)) & (F.substring(head(x), 1, 1) == F.substring(head(y), 1, 1)) & initial)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def lookup(value: Column, entries: dict[str, str]) -> Column:
    """A dictionary as an expression; null for what it does not have."""
    table = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    return F.try_element_at(table, value)


def safe_identifier(text: Column, length: int = 160) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, length)


def number(*texts: Column) -> Column:
    """The first text that is a number; percent signs, decimal commas and marks of thousands are understood.

    Of a comma and a full stop the last one is the decimal mark ("1.234,5" and
    "1,234.5" are 1234.5); one of them alone is decimal.
    """
    out = [F.expr("null").cast("double")]
    for t in texts:
        bare = F.rtrim(F.trim(t.cast("string")), F.lit("%"))
        comma, stop = F.length(bare) - F.locate(",", F.reverse(bare)), F.length(bare) - F.locate(".", F.reverse(bare))
        both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
        plain = F.when(both & (comma > stop), F.replace(bare, F.lit("."), F.lit(""))).when(both, F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)
        out.append(F.replace(plain, F.lit(","), F.lit(".")).try_cast("double"))
    return F.coalesce(*out)


def observed(available: Column, values: Column, names: Sequence[str]) -> Column:
    """Three states: null without coverage, the first name that the map has (null if it is no number), 0 if it has none."""
    has = [F.map_contains_key(values, n) for n in names]
    out = F.lit(0.0)
    for n, h in reversed(list(zip(names, has, strict=True))):
        out = F.when(h, F.try_element_at(values, F.lit(n)).try_cast("double")).otherwise(out)
    return F.when(available, out)


def first_date(text: Column, formats: Sequence[str]) -> Column:
    """The day of a date text in the first format that reads it."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def season_code(day: Column) -> Column:
    """'9596' for a day between July 1995 and June 1996."""
    start = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.format_string("%02d%02d", start % 100, (start + 1) % 100)


def week_start(day: Column, first: int = 1) -> Column:
    """First day of a day's week; first counts from Monday, so 1 is Tuesday."""
    return F.date_sub(day, F.pmod(F.weekday(day) - first, F.lit(7)).cast("int"))


def known_before(event: Column, minute_precise: Column) -> Column:
    """Lower bound of an event's time: the minute if it is known, else the start of the day."""
    return F.when(minute_precise, event).otherwise(F.date_trunc("day", event))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def logit(p: Column, edge: float = 1e-7) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probability_per_90(p: Column, minutes: Column) -> Column:
    """The probability of at least one event in 90 minutes, from that in the given minutes."""
    return 1 - F.pow(1 - clip(p, 0.0, 1.0), F.lit(90.0) / F.nullif(minutes, F.lit(0.0)))


def spread_to_sd(p10: Column, p90: Column) -> Column:
    """Standard deviation of a normal distribution with these tenths."""
    return (p90 - p10) / F.lit(2.5631)


def side_stats(stats: Column, prefix: str) -> Column:
    """The entries of a map whose key has the prefix, without it."""
    own = F.map_filter(stats, lambda k, v: k.startswith(prefix))
    return F.transform_keys(own, lambda k, v: F.substring(k, len(prefix) + 1, 1000))


def derived_seed(*parts: Column) -> Column:
    """A seed below 2**52 that the parts alone decide."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("bigint")


def secure_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https://[^/\s]+"), F.lit(False))
