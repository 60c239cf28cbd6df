"""Decisions about line-ups: assignment, substitutions, search and head-to-head; squads are small, samples are arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np

FORBIDDEN = -1e9


def assign(value: np.ndarray) -> tuple[list[int], float]:
    """The row for each column that makes the sum of values greatest; at most one column for a row.

    Shortest augmenting paths with potentials (Hungarian method); forbidden
    pairs are FORBIDDEN.
    """
    cost = -value.T  # columns are the agents
    n, m = cost.shape
    if m < n:
        raise ValueError("fewer candidates than places")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        j, least, way, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            reduced = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            nxt = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    rows = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            rows[match[j] - 1] = j - 1
    return rows, float(sum(value[r, c] for c, r in enumerate(rows)))


def best_lineup(points: np.ndarray, roles: Sequence[Sequence[str]], formations: dict[str, Sequence[str]]) -> tuple[str, list[int], float] | None:
    """The formation and the player for each of its places with the greatest total; None if no formation can be filled."""
    best = None
    for name, slots in formations.items():
        if len(points) < len(slots):
            continue
        value = np.array([[points[i] if slot in roles[i] else FORBIDDEN for slot in slots] for i in range(len(points))])
        chosen, total = assign(value)
        if total > FORBIDDEN / 2 and (best is None or total > best[2] + 1e-12):
            best = (name, chosen, total)
    return best


def bench_order(points: np.ndarray, roles: Sequence[Sequence[str]], starters: Sequence[int], slots: Sequence[str], absent: np.ndarray) -> list[int]:
    """Others by expected points times one plus the greatest chance that a starter they could replace is absent."""
    def use(i: int) -> float:
        risk = max((absent[s] for s, slot in zip(starters, slots, strict=True) if slot in roles[i]), default=0.0)
        return float(points[i] * (1 + risk))

    return sorted((i for i in range(len(points)) if i not in set(starters)), key=lambda i: (-use(i), i))


def scenario_points(points: np.ndarray, appeared: np.ndarray, roles: Sequence[str], starters: Sequence[int], bench: Sequence[int], formations: Sequence[dict[str, int]], limit: int = 5) -> np.ndarray:
    """A line-up's points in each scenario (rows of points and appeared), with substitutions.

    Players have one role.  For each formation (places by role) starters that
    appeared stay if they fit, and the bench enters in order: if the player
    appeared, the role has a free place and the limit is not reached.  The
    formation with most players counts, among equals the one whose entering
    players come earlier on the bench, then the first.
    """
    n = len(points)
    best_rank, best = np.full(n, -np.inf), np.zeros(n)
    start = np.array(starters)
    for capacity in formations:
        total, free, fits = np.zeros(n), {r: np.full(n, c) for r, c in capacity.items()}, np.ones(n, dtype=bool)
        for i in start:
            here = appeared[:, i]
            if roles[i] not in free:
                fits &= ~here
                continue
            free[roles[i]] = free[roles[i]] - here
            total += np.where(here, points[:, i], 0)
        fits &= np.all([f >= 0 for f in free.values()], axis=0)
        count, missing, mask = np.zeros(n), len(start) - appeared[:, start].sum(axis=1), np.zeros(n)
        for place, i in enumerate(bench):
            if roles[i] not in free:
                continue
            enters = appeared[:, i] & (free[roles[i]] > 0) & (count < np.minimum(limit, missing))
            free[roles[i]] = free[roles[i]] - enters
            total += np.where(enters, points[:, i], 0)
            count += enters
            mask += np.where(enters, 2.0 ** -(place + 1), 0)
        rank = np.where(fits, count + mask / 2, -np.inf)
        better = rank > best_rank
        best_rank, best = np.where(better, rank, best_rank), np.where(better, total, best)
    return best


def lineups_points(points: np.ndarray, appeared: np.ndarray, roles: Sequence[str], lineups: np.ndarray, benches: np.ndarray, formations: Sequence[dict[str, int]], limit: int = 5) -> np.ndarray:
    """`scenario_points` of many line-ups at once: line-ups by scenarios; lineups and benches have a row of players for each."""
    names = sorted({*roles, *(r for f in formations for r in f)})
    code = np.array([names.index(r) for r in roles])
    p, here = np.ascontiguousarray(points.T), np.ascontiguousarray(appeared.T)
    each, n = np.arange(len(lineups)), len(points)
    used, worth = np.zeros((len(names), len(lineups), n), dtype=np.int16), np.zeros((len(names), len(lineups), n))
    for i in lineups.T:
        used[code[i], each] += here[i]
        worth[code[i], each] += np.where(here[i], p[i], 0)
    missing = lineups.shape[1] - used.sum(axis=0)
    best_rank, best = np.full((len(lineups), n), -np.inf), np.zeros((len(lineups), n))
    for capacity in formations:
        known = np.array([r in capacity for r in names])
        free = np.array([capacity.get(r, 0) for r in names], dtype=np.int16)[:, None, None] - used
        fits, total = (free >= 0).all(axis=0), worth[known].sum(axis=0)
        count, mask = np.zeros((len(lineups), n)), np.zeros((len(lineups), n))
        for place, i in enumerate(benches.T):
            enters = here[i] & known[code[i]][:, None] & (free[code[i], each] > 0) & (count < np.minimum(limit, missing))
            free[code[i], each] -= enters
            total = total + np.where(enters, p[i], 0)
            count += enters
            mask += np.where(enters, 2.0 ** -(place + 1), 0)
        rank = np.where(fits, count + mask / 2, -np.inf)
        better = rank > best_rank
        best_rank, best = np.where(better, rank, best_rank), np.where(better, total, best)
    return best


def multirole_points(points: np.ndarray, appeared: np.ndarray, roles: Sequence[Sequence[str]], starters: Sequence[int], bench: Sequence[int], formations: Sequence[Sequence[str]], limit: int = 5) -> np.ndarray:
    """As `scenario_points`, for players with any number of roles and formations given as lists of places.

    Whether players can all be placed at once follows from Hall's theorem: for
    every union of role sets no more players may have their roles inside it
    than it has places.  The counts for each union are columns, so all
    scenarios are decided together and no matching is searched.  A player
    enters if the condition still holds with them, which is whether the
    players on the pitch could be moved to make a place.
    """
    names = sorted({r for slots in formations for r in slots})
    mask = [sum(1 << names.index(r) for r in set(own) if r in names) for own in roles]
    unions = {0}
    for m in {mask[i] for i in (*starters, *bench)}:
        unions |= {u | m for u in unions}
    sets = np.array(sorted(unions))
    inside = {i: (mask[i] & ~sets) == 0 for i in (*starters, *bench)}
    active = np.zeros((len(points), len(sets)), dtype=np.int16)
    base = np.zeros(len(points))
    for i in starters:
        active += appeared[:, i, None] & inside[i]
        base += np.where(appeared[:, i], points[:, i], 0)
    best_rank, best = np.full(len(points), -np.inf), np.zeros(len(points))
    for slots in formations:
        room = np.array([sum(bool(u >> names.index(r) & 1) for r in slots) for u in sets.tolist()])
        held, total = active.copy(), base.copy()
        fits = (held <= room).all(axis=1)
        count, early = np.zeros(len(points)), np.zeros(len(points))
        for place, i in enumerate(bench):
            enters = appeared[:, i] & (count < limit) & (held + inside[i] <= np.where(inside[i], room, 1 << 14)).all(axis=1)
            held += enters[:, None] & inside[i]
            total += np.where(enters, points[:, i], 0)
            count += enters
            early += np.where(enters, 2.0 ** -(place + 1), 0)
        rank = np.where(fits, count + early / 2, -np.inf)
        better = rank > best_rank
        best_rank, best = np.where(better, rank, best_rank), np.where(better, total, best)
    return best


def neighbours(starters: tuple[int, ...], bench: Sequence[int], roles: Sequence[str]) -> list[tuple[int, ...]]:
    """Line-ups that differ by one player of the same role."""
    out = []
    for k, s in enumerate(starters):
        out += [tuple(sorted((*starters[:k], b, *starters[k + 1 :]))) for b in bench if roles[b] == roles[s]]
    return out


def beam_search(first: Sequence[int], squad: Sequence[int], roles: Sequence[str], worth: Callable[[tuple[int, ...]], float], width: int = 3, rounds: int = 3, budget: int = 240, worths: Callable[[list[tuple[int, ...]]], Sequence[float]] | None = None) -> tuple[tuple[int, ...], float]:
    """The best line-up found by widening the best few round by round; at most `budget` line-ups are valued.

    worths, if given, values many line-ups at once, as worth does one.
    """
    worths = worths or (lambda lineups: [worth(x) for x in lineups])
    seen = {tuple(sorted(first)): worth(tuple(sorted(first)))}
    beam = list(seen)
    for _ in range(rounds):
        fresh = []
        for lineup in beam:
            others = dict.fromkeys(neighbours(lineup, [i for i in squad if i not in lineup], roles))
            new = [x for x in others if x not in seen][: max(0, budget - len(seen))]
            if new:
                seen |= dict(zip(new, worths(new), strict=True))
                fresh += new
        if not fresh:
            break
        beam = sorted(seen, key=lambda x: (-seen[x], x))[:width]
    best = min(seen, key=lambda x: (-seen[x], x))
    return best, seen[best]


def win_draw(mine: np.ndarray, theirs: np.ndarray, band: float = 0.0) -> tuple[float, float, float]:
    """Shares of scenarios won, drawn (within the band) and lost."""
    d = mine - theirs
    return float((d > band).mean()), float((abs(d) <= band).mean()), float((d < -band).mean())


def match_worth(theirs: np.ndarray, score: Callable[[tuple[int, ...]], np.ndarray]) -> Callable[[tuple[int, ...]], float]:
    """Worth of a line-up against an opponent's scenarios: two for a win, one for a draw."""
    def worth(lineup: tuple[int, ...]) -> float:
        win, draw, _ = win_draw(score(lineup), theirs)
        return 2 * win + draw

    return worth


def exhaustive(points: np.ndarray, roles: Sequence[Sequence[str]], slots: Sequence[str]) -> float:
    """Best total by trying every choice; for tests on tiny squads."""
    best = FORBIDDEN
    for chosen in combinations(range(len(points)), len(slots)):
        value = np.array([[points[i] if s in roles[i] else FORBIDDEN for s in slots] for i in chosen])
        best = max(best, assign(value)[1])
    return best
