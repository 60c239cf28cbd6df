"""Exchanges on a transfer market, each with its line-ups chosen anew, and the line-up that is best against an opponent.

A line-up fills every place of a formation with a player who has its role, and
its worth is the sum of its players' points.  Which sets of players can be
placed together is a question of Hall's condition: for every set of roles no
more of them may have all their roles inside it than it has places.  Such sets
are the independent sets of a matroid, so the best line-up is found by taking
players in the order of their points as long as the condition holds, and what
an exchange is worth follows from two numbers for the player dropped and the
roles of the one who comes, whoever that is: the best line-up without either
(`without`), and the best rest of a line-up that the new one is in (`rest`):

    best line-up after the exchange = max(without, rest + points of the new player)

So no exchange is solved by itself: `exchange_arrays` finds the numbers for a
roster and all its fixtures (`exchange_values` for one).  Players and offers
are short rows; a task keeps the numbers of a few rosters of a league and the
league's offers pass by them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10)


class Places:
    """A formation's places as room for every union of the role sets that occur."""

    def __init__(self, slots: Sequence[str], role_sets: Sequence[frozenset[str]]):
        unions = {frozenset()}
        for r in set(role_sets):
            unions |= {u | r for u in unions}
        self.unions = sorted(unions - {frozenset()}, key=sorted)
        self.room = [sum(s in u for s in slots) for u in self.unions]
        self.size = len(slots)
        self.within = {r: [i for i, u in enumerate(self.unions) if r <= u] for r in set(role_sets)}

    def best(self, order: Sequence[tuple[float, frozenset[str]]], first: frozenset[str] | None = None) -> tuple[float, list[int]]:
        """Points and places in `order` (falling points) of the best line-up, with a player of roles `first` in it, who counts nothing; -inf if there is none."""
        free, left, total, taken = list(self.room), self.size, 0.0, []
        if first is not None:
            if not self._enter(free, first):
                return -np.inf, []
            left -= 1
        for i, (points, roles) in enumerate(order):
            if not left:
                break
            if self._enter(free, roles):
                left -= 1
                total += points
                taken.append(i)
        return (total, taken) if not left else (-np.inf, [])

    def _enter(self, free: list[int], roles: frozenset[str]) -> bool:
        at = self.within[roles]
        if any(free[i] < 1 for i in at):
            return False
        for i in at:
            free[i] -= 1
        return True


def exchange_values(ids: Sequence, points: Sequence[float], roles: Sequence[frozenset[str]], formations: Mapping[str, Sequence[str]], incoming: Sequence[frozenset[str]]) -> list[tuple]:
    """(dropped, roles of the new player, without, rest) over all formations; dropped None: the roster as it is (rest -inf).

    Only exchanges of players who share a role.  The greatest over formations
    may be taken first: it is so for `without` and for `rest` alike.
    """
    every = [*roles, *incoming]
    places = [Places(slots, every) for slots in formations.values()]
    order = sorted(range(len(ids)), key=lambda i: (-points[i], i))
    best = lambda rows, first=None: max((p.best(rows, first)[0] for p in places), default=-np.inf)
    out = [(None, None, best([(points[i], roles[i]) for i in order]), -np.inf)]
    for d in order:
        rows = [(points[i], roles[i]) for i in order if i != d]
        without = best(rows)
        out += [(ids[d], r, without, best(rows, r)) for r in dict.fromkeys(incoming) if r & roles[d]]
    return out


def exchange_arrays(points: np.ndarray, own: np.ndarray, roles: Sequence[frozenset[str]], formations: Sequence[Sequence[str]], incoming: Sequence[frozenset[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `exchange_values` finds, for all fixtures of a roster at once: before (fixture), without (fixture, dropped), rest (fixture, dropped, incoming).

    points and own (whether the player is in the roster then): fixture by
    player.  Each choice of fixture, dropped player, incoming roles and
    formation is a row; players enter in the order of their points, all rows
    side by side.  What a fixture does not have is nan.
    """
    fixtures, n = points.shape
    every = list(dict.fromkeys([*roles, *incoming]))
    order = np.argsort(np.where(own, -points, np.inf), axis=1, kind="stable")
    firsts: list[frozenset[str] | None] = [None, *incoming]
    best = np.full((fixtures, n + 1, len(firsts)), -np.inf)
    for slots in formations:
        p = Places(slots, every)
        inside = np.array([[r <= u for u in p.unions] for r in roles])
        coming = np.array([[r is not None and r <= u for u in p.unions] for r in firsts])
        free = np.broadcast_to(np.array(p.room) - coming, (fixtures, n + 1, len(firsts), len(p.unions))).astype(np.int16)
        left = np.broadcast_to(p.size - np.array([r is not None for r in firsts]), best.shape).copy()
        total = np.zeros(best.shape)
        possible = (np.array(p.room) >= coming).all(axis=1)
        for at in range(n):
            i = order[:, at]
            held = inside[i][:, None, None, :]
            there = own[np.arange(fixtures), i][:, None] & (np.arange(n + 1)[None, :] != i[:, None])
            enters = there[:, :, None] & (left > 0) & ((free > 0) | ~held).all(axis=3)
            free -= enters[..., None] & held
            left -= enters
            total += np.where(enters, points[np.arange(fixtures), i][:, None, None], 0.0)
        best = np.maximum(best, np.where((left == 0) & possible, total, -np.inf))
    seen = own.any(axis=1)
    shares = np.array([[bool(r & q) for q in incoming] for r in roles])
    before = np.where(seen, best[:, n, 0], np.nan)
    without = np.where(own, best[:, :n, 0], np.nan)
    rest = np.where(own[:, :, None] & shares, best[:, :n, 1:], np.nan)
    return before, without, rest


#: Offers of a league that a manager's roster meets at once, rosters of a league whose numbers a task keeps, and exchanges it keeps before it gives them.
OFFERS, MANAGERS, EXCHANGES = 512, 64, 10_000


def rank_exchanges(rosters: DataFrame, market: DataFrame, budgets: DataFrame, formations: Mapping[str, Sequence[str]], horizons: Sequence[int] = HORIZONS, refund: bool = False, limit: int = 20) -> DataFrame:
    """Each manager's best exchanges, at most one for a target.

    rosters: manager, league, player, roles (array), price, fixture (1 is the
    next one), points; market: league, player, roles, price, fixture, points;
    budgets: manager, budget (null: not known).  A line-up is chosen for each
    fixture.  Gives manager, rank, target, dropped, price, improvement (over
    the longest horizon), over_replacement, efficiency, affordability,
    gain_<horizon>.  Only exchanges that improve; ties by what is above
    replacement, then price, then target.

    Rosters of a league are dealt into parts of about MANAGERS, and the offers
    of the league go to each part after its players: a task reads a part's
    players, keeps the numbers of their rosters, and lets the offers pass by in
    blocks.  So a pair of a player and an offer is a number in an array and no
    row, every row is a player or an offer, and neither a league's size nor
    their number decides what a task holds.
    """
    last = max(horizons)
    key = lambda r: F.array_join(F.array_sort(F.array_distinct(r)), "/")
    owned = rosters.filter(F.col("fixture") <= last).withColumn("roles", key(F.col("roles")))
    offered = market.filter(F.col("fixture") <= last).withColumn("roles", key(F.col("roles")))
    kinds = sorted(r["roles"] for r in offered.select("roles").distinct().collect())  # sets of roles: few by their meaning
    sets = [frozenset(k.split("/")) for k in kinds]
    along = lambda column: F.transform(F.sequence(F.lit(1), F.lit(last)), lambda f: F.try_element_at(column, f))
    by_fixture = F.map_from_entries(F.collect_list(F.struct(F.col("fixture").cast("int"), F.struct(F.lit(True).alias("own"), F.col("points").cast("double").alias("points"), F.col("roles")))))
    players = owned.groupBy("manager", "player").agg(along(by_fixture).alias("at"), F.collect_set(F.struct("league", "price")).alias("held"))
    leagues = owned.select("manager", "league").filter("league IS NOT NULL").distinct()
    parts = leagues.groupBy("league").agg(F.ceil(F.count("*") / MANAGERS).alias("_parts"))
    dealt = leagues.join(parts, "league").select(F.col("manager").alias("_manager"), "league", F.pmod(F.xxhash64("manager"), F.col("_parts")).alias("_part"))
    spent = budgets.select("manager", F.col("budget").cast("double").alias("budget")).withColumn("budget", F.when(~F.isnan("budget"), F.col("budget"))).distinct()
    squads = players.join(dealt, F.col("manager").eqNullSafe(F.col("_manager"))).join(spent, "manager", "left")
    prices = F.transform(F.filter("held", lambda h: h["league"] == F.col("league")), lambda h: h["price"].cast("double"))
    squads = squads.select("league", "_part", F.lit(0).alias("_side"), "manager", "budget", "player", F.col("at.own").alias("own"), F.col("at.points").alias("points"), F.col("at.roles").alias("each"), prices.alias("paid"))
    priced = offered.groupBy("league", "player", "roles", "price").agg(along(F.map_from_entries(F.collect_list(F.struct(F.col("fixture").cast("int"), F.col("points").cast("double"))))).alias("points"), F.when(F.count("points") == F.count("*"), _sum()).alias("worth"))
    passing = priced.join(parts, "league").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    passing = passing.select("league", "_part", F.lit(1).alias("_side"), F.col("player").alias("target"), "roles", "price", F.col("price").cast("double").alias("cost"), "points", "worth")
    schema = f"manager {_type(owned, 'manager')}, target {_type(offered, 'player')}, dropped {_type(owned, 'player')}, roles string, price {_type(offered, 'price')}, budget double, worth double, " + ", ".join(f"gain_{h} double" for h in horizons)
    names = [c.split()[0] for c in schema.split(", ")]
    slots = list(formations.values())

    def numbers(squad) -> list[tuple]:
        """`exchange_arrays` of a roster; fixture by fixture where a player's roles change."""
        own = np.array([[bool(x) for x in p["own"]] for p in squad]).T
        points = np.array([[0.0 if x is None else x for x in p["points"]] for p in squad], dtype=float).T
        role = [[frozenset(r.split("/")) if r is not None else None for r in p["each"]] for p in squad]
        fixed = [next(r for r in p if r is not None) for p in role]
        if all(r in (None, f) for p, f in zip(role, fixed, strict=True) for r in p):
            return exchange_arrays(points, own, fixed, slots, sets)
        each = []
        for f in range(last):
            now = [r[f] if r[f] is not None else x for r, x in zip(role, fixed, strict=True)]
            each.append(exchange_arrays(points[f : f + 1], own[f : f + 1], now, slots, sets))
        return tuple(np.concatenate(x) for x in zip(*each, strict=True))

    def roster(rows: list[dict]) -> tuple:
        """What the offers of a league meet: manager, budget, players, those who may be dropped, what may be spent for each, the numbers of their exchanges."""
        with np.errstate(invalid="ignore"):
            before, without, rest = numbers(rows)
        budget = rows[0]["budget"]
        paid = [(d, x) for d, p in enumerate(rows) for x in p["paid"]]
        at = np.array([d for d, _ in paid])
        most = np.array([np.inf if budget is None else budget + ((x or 0.0) if refund else 0.0) for _, x in paid])
        return rows[0]["manager"], budget, [p["player"] for p in rows], at, most, before, without[:, at], rest[:, at]

    def offer(offers: list[dict], to: list[tuple]) -> Iterator[tuple]:
        """The exchanges that improve, of a block of offers and rosters."""
        for k, kind in enumerate(kinds):
            alike = [o for o in offers if o["roles"] == kind]
            if not alike:
                continue
            worth = np.array([o["points"] for o in alike], dtype=float)
            price = np.array([-np.inf if o["cost"] is None else o["cost"] for o in alike], dtype=float)
            for manager, budget, ids, at, most, before, without, rest in to:
                own = set(ids)
                open_ = np.array([o["target"] not in own for o in alike])
                with np.errstate(invalid="ignore"):
                    after = np.fmax(without.T[:, None, :], rest[:, :, k].T[:, None, :] + worth[None])
                    total = np.cumsum(after - before, axis=2)
                    shared = ~np.isnan(rest[:, :, k]).all(axis=0)
                    total[~np.isfinite(total)] = np.nan
                    gain = np.where(shared[:, None] & (price[None] <= most[:, None]) & open_[None], total[:, :, last - 1], np.nan)
                    gain = np.where(gain > 1e-9, gain, -np.inf)
                first = gain.argmax(axis=0)  # players are in their order, so the first of equal ones is the smallest
                for o in np.flatnonzero(gain.max(axis=0) > 0):
                    d = first[o]
                    yield (manager, alike[o]["target"], ids[at[d]], kind, alike[o]["price"], budget, alike[o]["worth"], *[float(total[d, o, h - 1]) for h in horizons])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reading, told, out, kept = None, [], [], [], None
        for batch in batches:
            if kept is None:
                of = {"dropped": "player"}
                kept = pa.schema([(n, batch.schema.field(of.get(n, n)).type if n in ("manager", "target", "dropped", "roles", "price") else pa.float64()) for n in names])
            place = list(zip(*[batch.column(c).to_pylist() for c in ("league", "_part", "_side")], strict=True))
            starts = [i for i in range(len(place)) if not i or place[i] != place[i - 1]]
            for start, stop in zip(starts, [*starts[1:], len(place)], strict=True):
                if place[start][:2] != part:
                    part, reading, told = place[start][:2], [], []
                piece = batch.slice(start, stop - start)
                if not place[start][2]:
                    for row in piece.select(["manager", "budget", "player", "own", "points", "each", "paid"]).to_pylist():
                        if reading and (reading[0]["manager"], reading[0]["budget"]) != (row["manager"], row["budget"]):
                            told.append(roster(reading))
                            reading = []
                        reading.append(row)
                    continue
                if reading:
                    told.append(roster(reading))
                    reading = []
                for block in range(0, len(piece), OFFERS):
                    offers = piece.slice(block, OFFERS).select(["target", "roles", "price", "cost", "points", "worth"]).to_pylist()
                    for found in offer(offers, told):
                        out.append(found)
                        if len(out) == EXCHANGES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kept.types, strict=True)], schema=kept)
                            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kept.types, strict=True)], schema=kept)

    spread = max(int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions")), owned.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    line = squads.unionByName(passing, allowMissingColumns=True).repartition(spread, "league", "_part").sortWithinPartitions("league", "_part", "_side", "manager", "budget", "player")
    scored = line.mapInArrow(meet, schema)
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    scored = scored.withColumns({c: nan(c) for c in ("budget", "worth", *[f"gain_{h}" for h in horizons])} | ({"price": nan("price")} if _type(offered, "price") == "double" else {}))
    w = Window.partitionBy("manager", "target").orderBy(F.desc(f"gain_{last}"), "dropped")
    level = _replacement(owned, kinds, last)
    best = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(level, ["manager", "roles"], "left")
    out = best.withColumn("over_replacement", F.col("worth") - F.coalesce("least", F.lit(0.0)))
    order = Window.partitionBy("manager").orderBy(F.desc(f"gain_{last}"), F.desc("over_replacement"), F.col("price").asc_nulls_last(), "target")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    affordable = F.when(F.col("price").isNotNull() & F.col("budget").isNotNull(), "affordable").otherwise("unknown")
    return ranked.select("manager", "rank", "target", "dropped", "price", F.col(f"gain_{last}").alias("improvement"), "over_replacement", F.when(F.col("price") > 0, F.col(f"gain_{last}") / F.col("price")).alias("efficiency"), affordable.alias("affordability"), *[f"gain_{h}" for h in horizons])


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _sum() -> Column:
    """The sum of points, added in the order of the fixtures: equal points have equal sums, so ties are ties whatever came first."""
    points = F.sort_array(F.collect_list(F.when(F.col("points").isNotNull(), F.struct("fixture", F.col("points").cast("double").alias("points")))))
    return F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda total, p: total + p["points"]))


def _replacement(owned: DataFrame, kinds: Sequence[str], last: int) -> DataFrame:
    """(manager, roles, least): the least that a manager's players who share a role with those roles give over the horizon."""
    worth = owned.groupBy("manager", "player", "roles").agg(_sum().alias("worth"))
    sets = F.explode(F.array(*map(F.lit, kinds))).alias("asked")
    shared = worth.select("manager", "worth", "roles", sets).filter(F.arrays_overlap(F.split("roles", "/"), F.split("asked", "/")))
    return shared.groupBy("manager", F.col("asked").alias("roles")).agg(F.min("worth").alias("least"))


# ------------------------------------------------------------- head to head


#: Choices of players up to which `best_against` values all of them in arrays; the result is the same.
FEW_CHOICES = 2000


def _best_of_all(points: np.ndarray, roles: Sequence[frozenset[str]], places: Sequence[Places], theirs: np.ndarray) -> tuple[tuple[int, ...], int, int, bool] | None:
    """`best_against` by valuing every choice that can be placed."""
    best = None
    for size in sorted({p.size for p in places}):
        chosen = np.array(list(combinations(range(len(points)), size)), dtype=np.intp).reshape(-1, size)
        legal = np.zeros(len(chosen), dtype=bool)
        for p in places:
            if p.size == size:
                inside = np.array([[r <= u for u in p.unions] for r in roles])
                legal |= (inside[chosen].sum(axis=1) <= np.array(p.room)).all(axis=1)
        chosen = chosen[legal]
        if not len(chosen):
            continue
        score = points[chosen].sum(axis=1)
        wins, draws, totals = (score > theirs).sum(axis=1), (score == theirs).sum(axis=1), score.sum(axis=1)
        at = np.lexsort((np.arange(len(chosen)), -totals, -(2 * wins + draws)))[0]  # choices are in the order of their players
        found = (2 * int(wins[at]) + int(draws[at]), int(totals[at]), tuple(-int(i) for i in chosen[at]), int(wins[at]), int(draws[at]))
        best = found if best is None else max(best, found)
    return None if best is None else (tuple(-i for i in best[2]), best[3], best[4], True)


def best_against(points: np.ndarray, roles: Sequence[frozenset[str]], formations: Mapping[str, Sequence[str]], theirs: np.ndarray, nodes: int = 200_000) -> tuple[tuple[int, ...], int, int, bool] | None:
    """The line-up (players' places) with the greatest 2 * wins + draws over scenarios, then the greatest total; wins, draws, and whether it is proved.

    points: players by scenario, theirs: the opponent's by scenario, whole
    numbers (hundredths of points), so that draws are exact.  Branch and
    bound: players are decided in the order of their totals.  A scenario can
    still be won if the points so far and the greatest that the open places
    could add there, from undecided players of any role, exceed the
    opponent's; the sum over scenarios bounds what is left below a node, and
    so does the same sum for totals.  The first line-up is the one of greatest
    total.  After `nodes` nodes the best one so far is given, unproved.  None
    if no formation can be filled.  Where there are few choices of players
    they are valued side by side instead.
    """
    places = [Places(slots, roles) for slots in formations.values()]
    sizes = {p.size for p in places}
    if sum(comb(len(points), size) for size in sizes) <= FEW_CHOICES:
        return _best_of_all(points, roles, places, theirs)
    total = points.sum(axis=1)
    order = sorted(range(len(points)), key=lambda i: (-total[i], i))
    value = lambda score: 2 * int((score > theirs).sum()) + int((score == theirs).sum())
    best: tuple[int, int, tuple[int, ...]] | None = None
    for p in places:
        worth, taken = p.best([(float(total[i]), roles[i]) for i in order])
        if worth > -np.inf:
            chosen = tuple(sorted(order[i] for i in taken))
            score = points[list(chosen)].sum(axis=0)
            best = max(filter(None, (best, (value(score), int(score.sum()), chosen))), key=lambda x: (x[0], x[1], tuple(-i for i in x[2])))
    if best is None:
        return None
    held = points[order]
    # most[k][d]: what k more of the players from place d on can add in each scenario, and in all
    most = {k: [np.sort(held[d:], axis=0)[::-1][:k].sum(axis=0) for d in range(len(order) + 1)] for k in range(1, max(sizes) + 1)}
    sums = np.concatenate([[0], np.cumsum(total[order])])
    seen = 0

    def search(d: int, chosen: list[int], score: np.ndarray, rooms: list[list[int] | None]) -> None:
        nonlocal best, seen
        if seen >= nodes:
            return
        seen += 1
        for p, room in zip(places, rooms, strict=True):
            if room is not None and len(chosen) == p.size:
                found = (value(score), int(score.sum()), tuple(sorted(chosen)))
                if (found[0], found[1], tuple(-i for i in found[2])) > (best[0], best[1], tuple(-i for i in best[2])):
                    best = found
        open_sizes = [p.size - len(chosen) for p, room in zip(places, rooms, strict=True) if room is not None and 0 < p.size - len(chosen) <= len(order) - d]
        if not open_sizes:
            return
        if not any((value(score + most[k][d]), int(score.sum()) + int(sums[min(d + k, len(order))] - sums[d])) >= best[:2] for k in set(open_sizes)):
            return
        i = order[d]
        entered = []
        for p, room in zip(places, rooms, strict=True):
            free = None if room is None else list(room)
            entered.append(free if free is not None and p._enter(free, roles[i]) else None)
        if any(e is not None for e in entered):
            search(d + 1, [*chosen, i], score + points[i], entered)
        search(d + 1, chosen, score, rooms)

    search(0, [], np.zeros(points.shape[1], dtype=np.int64), [list(p.room) for p in places])
    score = points[list(best[2])].sum(axis=0)
    return best[2], int((score > theirs).sum()), int((score == theirs).sum()), seen < nodes
