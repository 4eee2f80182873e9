"""Patrol routes: nearest neighbour and 2-opt, or a guided local search on top of them. Routes are rows with arrays of stops; those
with as many stops are solved side by side where that can be done in arrays. A route has a few dozen stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed

GAIN = 1e-9


def distances(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Great-circle metres between all stops of a route, or of each of several routes in rows."""
    y, x = np.radians(lat), np.radians(lon)
    a = np.sin((y[..., :, None] - y[..., None, :]) / 2) ** 2 + np.cos(y)[..., :, None] * np.cos(y)[..., None, :] * np.sin((x[..., :, None] - x[..., None, :]) / 2) ** 2
    out = 2 * fixed.EARTH_M * np.arcsin(np.clip(np.sqrt(a), 0, 1))
    out[..., np.arange(y.shape[-1]), np.arange(y.shape[-1])] = 0
    return out


def nearest_first(matrix: np.ndarray) -> np.ndarray:
    """From the first stop always on to the nearest one left, the smaller index first among equals."""
    n = len(matrix)
    order, open_stops = np.zeros(n, np.int64), np.ones(n, bool)
    for step in range(1, n):
        open_stops[order[step - 1]] = False
        order[step] = np.where(open_stops, matrix[order[step - 1]], np.inf).argmin()
    return order


def leg_lengths(matrix: np.ndarray, order: list[int], closed: bool) -> list[float]:
    """The legs of a route in the order driven; a closed one with two stops or more also leads back to its start."""
    onward = np.roll(order, -1)
    return matrix[order, onward][: None if closed and len(order) > 1 else -1].tolist() if len(order) else []


def length(matrix: np.ndarray, order: list[int], closed: bool) -> float:
    return float(sum(leg_lengths(matrix, order, closed)))


def reversal_changes(matrix: np.ndarray, order: np.ndarray, i: int, closed: bool) -> np.ndarray:
    """By how much the route grows if the stops at places i to k are visited in reverse, for every k > i: two edges change, and
    the legs between are driven the other way, which matters where distances differ by direction."""
    ends, after = order[i + 1 :], np.append(order[i + 2 :], order[0])
    there, back = matrix[order[i:-1], order[i + 1 :]], matrix[order[i + 1 :], order[i:-1]]
    leaving = matrix[order[i], after] - matrix[ends, after]
    if not closed:
        leaving[-1] = 0.0
    return matrix[order[i - 1], ends] - matrix[order[i - 1], order[i]] + np.cumsum(back - there) + leaving


def two_opt(matrix: np.ndarray, order: np.ndarray, closed: bool) -> np.ndarray:
    """Takes each reversal of a stretch that shortens the route, in order of its places, over and over, until none does."""
    order, moved = np.array(order), True
    while moved:
        moved = False
        for i in range(1, len(order) - 1):
            k = i
            while len(better := np.flatnonzero(reversal_changes(matrix, order, i, closed)[k - i :] < -GAIN)):
                k += int(better[0]) + 1
                order[i : k + 1] = order[i : k + 1][::-1].copy()
                moved = True
    return order


#: How routes of few stops are found.
FEW = {0: "none", 1: "none", 2: "trivial"}


def solve(matrix: np.ndarray, closed: bool = False, search: bool = False) -> tuple[list[int], str]:
    """The order of stops, and how it was found. Two stops and fewer need no search."""
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
        raise ValueError(f"a matrix must be square: {matrix.shape}")
    if search and len(matrix) > 2:
        return guided(matrix, closed), "guided-local-search"
    return two_opt(matrix, nearest_first(matrix), closed).tolist(), FEW.get(len(matrix), "nearest-neighbor+2opt")


#: Penalties that a guided search sets; its moves look at so many neighbours of a stop, and shift so many stops at most.
STEPS, NEAR, SHIFT = 60, 8, 3
#: A penalty's weight, as a share of a leg's mean length.
WEIGHT = 0.2


class Tour:
    """A round trip over a matrix that 2-opt and Or-opt moves shorten. The first stop stays first and, if ``tail`` is 1, the last
    one last."""

    def __init__(self, order: list[int], tail: int):
        self.order, self.end = list(order), len(order) - tail

    def cost(self, m: list[list[float]]) -> float:
        return sum(m[a][b] for a, b in zip(self.order, self.order[1:] + self.order[:1], strict=True))

    def changes(self, i: int, j: int, m: list[list[float]]):
        """(gain, new order) for moves that bring the stop at place j next to the one at place i."""
        o, n = self.order, len(self.order)
        if 0 < i + 1 < j < self.end:  # the stretch between is driven in reverse: i, j, ..., i + 1
            stretch = o[i + 1 : j + 1]
            behind = o[(j + 1) % n]
            there = sum(m[a][b] for a, b in zip(stretch, stretch[1:], strict=False))
            back = sum(m[b][a] for a, b in zip(stretch, stretch[1:], strict=False))
            yield m[o[i]][stretch[0]] + there + m[stretch[-1]][behind] - m[o[i]][stretch[-1]] - back - m[stretch[0]][behind], ("turn", i + 1, j + 1)
        for size in range(1, SHIFT + 1):  # stops from j on, or up to j, are moved behind i, as they are or turned
            for start, turned in ((j, False), (j - size + 1, True)):
                if start < 1 or start + size > self.end or start - 1 <= i < start + size:
                    continue
                part = o[start : start + size]
                before, behind, after = o[start - 1], o[(start + size) % n], o[(i + 1) % n]
                inner = sum(m[a][b] for a, b in zip(part, part[1:], strict=False))
                moved = part[::-1] if turned else part
                new_inner = sum(m[a][b] for a, b in zip(moved, moved[1:], strict=False))
                gain = m[before][part[0]] + inner + m[part[-1]][behind] + m[o[i]][after] - m[before][behind] - m[o[i]][moved[0]] - new_inner - m[moved[-1]][after]
                yield gain, ("move", start, size, i, turned)

    def apply(self, move: tuple) -> None:
        if move[0] == "turn":
            self.order[move[1] : move[2]] = self.order[move[1] : move[2]][::-1]
            return
        _, start, size, i, turned = move
        part = self.order[start : start + size]
        del self.order[start : start + size]
        at = i + 1 if i < start else i + 1 - size
        self.order[at:at] = part[::-1] if turned else part

    def descend(self, m: list[list[float]], near: list[list[int]], stops: list[int] | None = None) -> bool:
        """Takes the best move of each stop in turn, beginning with ``stops`` (all of them if not given) and going on with those
        whose neighbours have changed, until none shortens the trip. Says whether anything changed."""
        waiting, changed = list(self.order if stops is None else stops), False
        while waiting:
            stop = waiting.pop()
            place = {s: k for k, s in enumerate(self.order)}
            i, gain, best = place[stop], GAIN, None
            if i >= self.end:
                continue
            for b in near[stop]:
                for more, move in self.changes(i, place[b], m):
                    if more > gain:
                        gain, best = more, move
            if best is not None:
                n = len(self.order)
                ends = (best[1] - 1, best[1], best[2] - 1, best[2]) if best[0] == "turn" else (best[1] - 1, best[1], best[1] + best[2] - 1, best[1] + best[2], best[3], best[3] + 1)
                touched = {self.order[k % n] for k in ends}
                self.apply(best)
                waiting = [s for s in waiting if s not in touched] + [s for s in touched if place[s] < self.end] + [stop]
                changed = True
        return changed


def guided(matrix: np.ndarray, closed: bool, steps: int = STEPS) -> list[int]:
    """The order of stops after a guided local search from the 2-opt route, on distances rounded to whole metres. Each step sets a
    penalty on the leg that is longest for the penalties it has, and searches on. An open route ends at a dummy stop without
    distances, which is left out of the answer. Bounded by steps, not seconds, so the same stops give the same route."""
    n = len(matrix)
    first = two_opt(matrix, nearest_first(matrix), closed).tolist()
    d = np.rint(matrix)
    if not closed:
        d = np.pad(d, (0, 1))
        first = [*first, n]
    near = np.argsort(d[:, :n] + np.where(np.eye(len(d), n, dtype=bool), np.inf, 0), axis=1, kind="stable")[:, : min(NEAR, n - 1)].tolist()
    near = [[b for b in row if b != a and b != 0] for a, row in enumerate(near)]
    plain, penalty = d.tolist(), np.zeros_like(d)
    tour = Tour(first, 0 if closed else 1)
    tour.descend(plain, near)
    best, least = list(tour.order), tour.cost(plain)
    for _ in range(steps):
        a, b = np.array(tour.order), np.roll(tour.order, -1)
        worst = int(np.argmax(d[a, b] / (1 + penalty[a, b])))
        penalty[a[worst], b[worst]] += 1
        if not tour.descend((d + WEIGHT * least / len(a) * penalty).tolist(), near, [int(a[worst]), int(b[worst])]):
            continue
        rest = Tour(tour.order, len(tour.order) - tour.end)
        rest.descend(plain, near)
        cost = rest.cost(plain)
        if cost < least:
            best, least = list(rest.order), cost
    return [x for x in best if x < n]


#: Stops of a route up to which a search tries all orders.
ALL = 9


def shortest(matrices: np.ndarray, closed: bool) -> np.ndarray:
    """The shortest orders, in rows, of several routes of as many stops, on distances rounded to whole metres: over sets of stops
    that have been visited and the last one of them, for all routes at once (Held and Karp)."""
    d = np.rint(matrices)
    r, n = len(d), d.shape[1]
    most = 1 << (n - 1)  # sets of the stops behind the first one
    cost, before = np.full((most, n - 1, r), np.inf), np.zeros((most, n - 1, r), np.int8)
    for j in range(n - 1):
        cost[1 << j, j] = d[:, 0, j + 1]
    onward = d[:, 1:, 1:].transpose(1, 2, 0)
    for seen in range(1, most):
        for j in range(n - 1):
            if seen >> j & 1 and seen != 1 << j:
                ways = cost[seen ^ (1 << j)] + onward[:, j]
                before[seen, j] = ways.argmin(0)
                cost[seen, j] = ways.min(0)
    last = (cost[-1] + d[:, 1:, 0].T if closed else cost[-1]).argmin(0)
    orders, seen, routes = np.zeros((r, n), np.int64), np.full(r, most - 1), np.arange(r)
    for place in range(n - 1, 0, -1):
        orders[:, place] = last + 1
        last, seen = before[seen, last, routes].astype(np.int64), seen ^ (1 << last)
    return orders


def solve_all(matrices: np.ndarray, closed: bool = False, search: bool = False) -> tuple[np.ndarray, str]:
    """``solve`` for routes of as many stops: orders in rows, and how they were found. A search in routes of few stops tries all orders,
    so it ends at the best one."""
    r, n = matrices.shape[:2]
    if n <= 2:
        return np.tile(np.arange(n), (r, 1)), FEW[n]
    if search and n <= ALL:
        return np.concatenate([shortest(matrices[k : k + TOGETHER], closed) for k in range(0, r, TOGETHER)]), "exact"
    solved = [solve(m, closed, search) for m in matrices]
    return np.array([order for order, _ in solved]), solved[0][1]


#: Routes whose orders are tried together; the table of nine stops takes 18 MB for each thousand of them.
TOGETHER = 1000
#: Bytes of an Arrow batch at most.
BATCH = 8 << 20
#: Distances of routes that are worked on together.
CELLS = 1 << 20


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


ROUTE = "route_id bigint, order array<int>, legs array<double>, total_m double, solver string, is_approximate boolean"


def optimize(stops: DataFrame, closed: bool = False, matrix: DataFrame | None = None, search: bool = False) -> DataFrame:
    """A row for each route: order (positions), legs, total_m, solver, is_approximate. With ``search`` a guided local search goes on
    from the 2-opt route.

    ``stops`` has route_id, pos (0, 1, ...), lat, lon. Without a ``matrix`` (route_id, i, j, dist_m) distances are along the
    great circle and the route is approximate; a matrix must have a distance for each pair of stops."""

    def one(stops: pd.DataFrame, m: np.ndarray, approximate: bool) -> pd.DataFrame:
        order, solver = solve(m, closed, search)
        legs = leg_lengths(m, order, closed)
        return pd.DataFrame(
            {"route_id": [int(stops["route_id"].iloc[0])], "order": [order], "legs": [legs], "total_m": [float(sum(legs))], "solver": [solver], "is_approximate": [approximate]}
        )

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stops = batch.column("stops")
            n = stops.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(n) - n
            lat, lon = (stops.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                few = max(1, CELLS // int(size) ** 2)
                for some in (rows[k : k + few] for k in range(0, len(rows), few)):
                    at = starts[some][:, None] + np.arange(size)
                    m = distances(lat[at], lon[at])
                    orders, solver = solve_all(m, closed, search)
                    route = np.arange(len(some))[:, None]
                    legs = m[route, orders, np.roll(orders, -1, axis=1)][:, : None if closed and size > 1 else -1]
                    total = np.array([float(sum(x)) for x in legs.tolist()])
                    columns = [batch.column("route_id").take(pa.array(some)), _lists(orders.astype(np.int32)), _lists(legs), pa.array(total)]
                    columns += [pa.array([solver] * len(some)), pa.array([True] * len(some))]
                    yield pa.record_batch(columns, names=["route_id", "order", "legs", "total_m", "solver", "is_approximate"])

    def given(part: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({c: [] for c in ("route_id", "order", "legs", "total_m", "solver", "is_approximate")})
        n = len(part)
        m = np.full((n, n), np.nan)
        inside = pairs[(pairs["i"] < n) & (pairs["j"] < n)]
        m[inside["i"], inside["j"]] = inside["dist_m"]
        if len(inside) != len(pairs) or np.isnan(m).any():
            raise ValueError(f"the matrix doesn't fit {n} stops")
        return one(part, m, False)

    stops = stops.select("route_id", "pos", "lat", "lon")
    if search:  # few bytes, much work: not to be merged into fewer tasks
        stops = stops.repartition(int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route_id")
    if matrix is None:
        stops.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        listed = stops.groupBy(F.col("route_id").cast("long").alias("route_id")).agg(F.array_sort(F.collect_list(F.struct("pos", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon"))))).alias("stops"))
        return listed.mapInArrow(plain, ROUTE)
    return stops.groupBy("route_id").cogroup(matrix.groupBy("route_id")).applyInPandas(given, ROUTE)


def legs(routes: DataFrame) -> DataFrame:
    """(route_id, step, from_pos, to_pos, dist_m): a row for each leg."""
    n = F.size("order")
    leg = F.transform(
        "legs",
        lambda d, i: F.struct(
            i.alias("step"), F.get("order", i).alias("from_pos"), F.get("order", (i + 1) % n).alias("to_pos"), d.alias("dist_m")
        ),
    )
    return routes.select("route_id", F.inline(leg))
