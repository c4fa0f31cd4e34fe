"""k-medoids over a table of points, by alternation or by PAM swaps.

The data stays in Spark; the driver holds the current medoids, sums by cell and a bounded
batch of candidates. Both methods are exact, but few candidates are ever scored: all points
add up to a quadratic that bounds the totals of the candidates near a place, and candidates
are scored in the order of their bounds until none that is left can be better. Within a
cluster the place is about its centre, and one quadratic bounds all its points. For swaps the
points are divided into cells around pivots, whose sums bound a candidate's total: first those
of few merged cells, then finer ones for the candidates that they leave, then quadratics
for groups of what is left. A round is a few passes over the sites, each of n sites times
few cells, or n times a bounded number of groups and candidates.

Distances are Euclidean, counted in steps of 1e-9. Their sums are exact integers, so
they do not depend on the order of tasks, and ties go to the lower company id. Every
round but the last lowers an integer loss, so a fit ends by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, inf
from operator import and_

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysegments.functions.numeric import distance
from paysegments.operators import scoring
from paysegments.operators.scoring import STEPS
from paysegments.operators.stats import is_finite, require_complete

# Cells for each root of the number of sites, and at most.
CELLS, MOST_CELLS = 8, 4096
# Candidates that the driver asks for and a task scores at a time, and those of the first time.
BATCH, FIRST = 4096, 512
# Merged cells by which a swap's candidates are bounded before all cells are asked, and pivots tried first.
LEVELS, TRIED = (128, 640), 64
# Reaches of the quadratics of a cluster, as shares of the mean distance to its centre.
REACHES = (0.5, 0.1, 0.02)
# Sites of a partition: at most, and at least where there are cores for more partitions.
MOST_SITES, LEAST_SITES = 65_536, 512


@dataclass(frozen=True)
class Medoid:
    """A company chosen as a medoid; ``site`` is the lowest id at the same point."""

    id: int
    site: int
    point: tuple[float, ...]


Medoids = tuple[Medoid, ...]
Group = tuple[int, int]  # fit and cluster
Offered = tuple[float, int, tuple[float, ...]]  # bound, id and point of a candidate
Found = tuple[int, int, int, tuple[float, ...]]  # total, id, replaced medoid and point


def distance_pairs(
    df: DataFrame, cols: Sequence[str], candidates: Medoids, key: str = "company_id"
) -> DataFrame:
    """Distance from every row to each of a few given candidates."""
    entries = [
        F.struct(
            F.lit(m.id).cast("bigint").alias("candidate_id"),
            distance(cols, m.point).alias("distance"),
        )
        for m in candidates
    ]
    return df.select(key, F.explode(F.array(*entries)).alias("pair")).select(key, "pair.*")


def assign(df: DataFrame, cols: Sequence[str], medoids: Medoids) -> DataFrame:
    """Add ``cluster``, the nearest medoid's position, and the ``distance`` to it.

    The medoids are constants of the projection: no join and no shuffle.
    """
    found = [distance(cols, m.point) for m in medoids]
    steps = F.array(*[F.rint(d * STEPS) for d in found])
    nearest = F.array_position(steps, F.array_min(steps)).cast("int") - 1
    return df.withColumn("cluster", nearest).withColumn(
        "distance", F.get(F.array(*found), F.col("cluster"))
    )


def inertia(assigned: DataFrame) -> DataFrame:
    """The loss: the sum of distances (not squares) to the nearest medoid."""
    return assigned.agg(F.sum("distance").alias("loss"))


class PointSpace:
    """The points a fit works on, all of them candidates too.

    Copies of a point merge into one weighted site before the shuffle, so a point
    shared by many rows is one row from then on. The sites are kept by the executors
    for the fit, with the cell that they lie in; what a lost executor held is computed
    again. ``close`` gives the room back. ``asked`` counts the candidates scored.
    """

    def __init__(
        self, df: DataFrame, cols: Sequence[str], key: str = "company_id", cells: int = MOST_CELLS, batch: int = BATCH
    ):
        self.rows, self.cols, self.key = df, list(cols), key
        self.batch, self.asked = batch, 0
        merged = df.groupBy(*cols).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("weight"))
        self.merged = merged.select(*[F.col(c).cast("double") for c in cols], "id", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        found = self.merged.agg(
            F.count("id").alias("sites"),
            F.sum("weight").alias("rows"),
            *[F.sum(F.when(~is_finite(F.col(c)), F.col("weight"))).alias(c) for c in cols],
        ).first()
        self.n, self.n_sites = int(found["rows"] or 0), found["sites"]
        try:
            require_complete(self.n, {c: int(found[c] or 0) for c in cols})
        except ValueError:
            self.merged.unpersist()
            raise
        cells = max(1, min(cells, ceil(CELLS * self.n_sites**0.5)))
        chosen = self.merged.orderBy(F.xxhash64("id"), "id").limit(cells).select(*cols).collect()
        self.pivots = np.array([tuple(r) for r in chosen], float).reshape(len(chosen), len(self.cols))
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-self.n_sites // MOST_SITES), min(cores, -(-self.n_sites // LEAST_SITES)), 1)
        dealt = self.merged.repartition(parts, "id")
        self.sites = scoring.with_cells(dealt, self.cols, self.pivots).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> PointSpace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.sites.unpersist()
        self.merged.unpersist()

    def summarised(self, fits: Sequence[np.ndarray], swap: bool) -> tuple[list[dict], list[list[int]]]:
        """The cells of each fit's clusters, and each cluster's distance sum to its medoid."""
        summaries, costs = scoring.summarise(self.sites, self.cols, self.pivots, fits, swap)
        return [scoring.described(s, self.pivots, swap) for s in summaries], costs

    def scored(self, fits: Sequence[np.ndarray], swap: bool, rows: Sequence[tuple[Group, Offered]]) -> list[list[int]]:
        """The exact totals of candidates: one within its cluster, or one for each medoid replaced."""
        self.asked += len(rows)
        if swap:
            return scoring.swap_totals(self.sites, self.cols, fits[0], [point for _, (_, _, point) in rows])
        asked = [(fit, slot, point) for (fit, slot), (_, _, point) in rows]
        return [[t] for t in scoring.within_totals(self.sites, self.cols, fits, asked)]

    def search(
        self, fits: Sequence[np.ndarray], cells: list[dict], swap: bool, want: int, below: Mapping[Group, float]
    ) -> dict[Group, list[Found]]:
        """The ``want`` best candidates with a total below a limit, by group and in order.

        Candidates are asked for by their bounds. The first few are scored to learn how
        good the best are, and then all whose bounds do not rule them out, ties included.
        """
        best: dict[Group, list[Found]] = {g: [] for g in below}
        most: dict[Group, float] = dict(below)  # as far as the bounds know

        def limit(group: Group) -> float:
            known = best[group]
            return min(most[group], known[want - 1][0]) if len(known) >= want else most[group]

        def learn(rows: list[tuple[Group, Offered]]) -> None:
            for (group, (_, id_, point)), totals in zip(rows, self.scored(fits, swap, rows)):
                best[group] += [(t, id_, slot, point) for slot, t in enumerate(totals) if t < below[group]]
            for group in {g for g, _ in rows}:
                best[group] = sorted(best[group])[:want]

        if not below:
            return best
        if swap:
            totals = scoring.swap_sums(cells[0], len(fits[0]))
            levels = [scoring.coarsened(cells[0], n) for n in LEVELS if 2 * n < len(cells[0]["slot"])] + cells
            bounds = scoring.swap_bounds(levels, len(fits[0]))
            most[0, 0] = self._tried(fits[0], scoring.swap_bounds(levels[:2], len(fits[0])), most[0, 0], want)
        else:
            bounds = self._around_centres(fits, cells, below)
        ranges = {g: (-inf, 0, float(limit(g))) for g in below}
        while ranges:
            keep = max(want, 16, self.batch // len(ranges))
            first = max(want, 16, FIRST // len(ranges))
            offered = scoring.lowest(self.sites, self.cols, fits, bounds, ranges, keep, swap)
            left = offered
            if swap:
                left = {}
                left[0, 0], most[0, 0] = self._sharpened(fits[0], totals, offered[0, 0], limit((0, 0)), want)
            waiting = [(g, row) for g, rows in left.items() for row in rows[:first]]
            later = [(g, row) for g, rows in left.items() for row in rows[first:]]
            while waiting:
                for at in range(0, len(waiting), self.batch):
                    learn(waiting[at : at + self.batch])
                later = [(g, row) for g, row in later if row[0] <= limit(g)]
                waiting, later = later[: self.batch], later[self.batch :]
            ranges = {
                g: (*rows[-1][:2], limit(g)) for g, rows in offered.items() if len(rows) == keep and rows[-1][0] <= limit(g)
            }
        return best

    def _around_centres(self, fits: Sequence[np.ndarray], cells: list[dict], below: Mapping[Group, float]) -> Callable:
        """The bounds of candidates within clusters, from quadratics around the clusters' centres."""
        groups, weight = {}, {}
        for f, slot in below:
            there = cells[f]["slot"] == slot
            weight[f, slot] = float(cells[f]["weight"][there].sum())
            centre, spread = scoring.central(cells[f]["mean"][there], cells[f]["weight"][there])
            groups[f, slot] = centre, spread * np.array(REACHES)
        return scoring.within_bounds(groups, scoring.within_regions(self.sites, self.cols, fits, groups), weight)

    def _tried(self, fit: np.ndarray, bounds: Callable, limit: float, want: int) -> float:
        """The limit, lowered to what the most promising pivots reach: they are candidates too."""
        bound = bounds((0, 0), self.pivots, limit)
        some = [p for p in np.argsort(bound, kind="stable")[: max(want, TRIED)] if bound[p] < inf]
        if not some:
            return limit
        self.asked += len(some)
        totals = scoring.swap_totals(self.sites, self.cols, fit, [tuple(p) for p in self.pivots[some]])
        reached = sorted(min(by_slot) for by_slot in totals)
        return min(limit, reached[want - 1]) if len(reached) >= want else limit

    def _sharpened(
        self, fit: np.ndarray, totals: dict, rows: list[Offered], limit: float, want: int
    ) -> tuple[list[Offered], float]:
        """The candidates that the quadratics of small groups of them leave, with their bounds; and the limit."""
        while len(rows) > FIRST:
            points = np.array([point for *_, point in rows])
            groups = scoring.grouped(points, FIRST)
            at, reach = scoring.middles(points, groups)
            coefs = scoring.swap_regions(self.sites, self.cols, fit, points[at], reach)
            if want == 1:  # a centre is a candidate too; the last column is its gain
                least = (totals["lost"] - coefs[..., -1]).min(axis=1) + scoring.swap_margin(reach, totals)
                limit = min(limit, float(least.min()) * STEPS)
            bound = np.array([b for b, *_ in rows])
            for group, centre, coef, far in zip(groups, points[at], coefs, reach):
                found = scoring.swap_region_bound(points[group] - centre, coef[..., :-1], far, totals)
                bound[group] = np.maximum(bound[group], found)
            left = [(float(b), *row[1:]) for b, row in zip(bound, rows) if b <= limit]
            done, rows = 2 * len(left) > len(rows), sorted(left)
            if done:
                break
        return [row for row in rows if row[0] <= limit], limit


def points_of(medoids: Medoids) -> np.ndarray:
    return np.array([m.point for m in medoids], dtype=float)


def ranked_by_total(space: PointSpace, k: int) -> list[tuple[float, Medoid]]:
    """The k rows with the least distance sum to all rows, ties by id."""
    if not 1 <= k <= space.n:
        raise ValueError(f"k = {k} medoids asked of {space.n} rows")
    # With any single medoid there is one cluster, so its sums are over all points.
    one = [np.zeros((1, len(space.cols)))]
    cells, _ = space.summarised(one, False)
    best = space.search(one, cells, False, k, {(0, 0): inf})[0, 0]
    return _with_copies(space, [(total, id_, point) for total, id_, _, point in best], k)


def _with_copies(space: PointSpace, best: list, k: int) -> list[tuple[float, Medoid]]:
    """Rows at the best points, each copy a row of its own."""
    total = F.lit(None).cast("decimal(38,0)")
    site = F.lit(None).cast("bigint")
    for value, id_, point in best:
        here = reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(space.cols, point)])
        total = F.when(here, F.lit(value).cast("decimal(38,0)")).otherwise(total)
        site = F.when(here, id_).otherwise(site)
    rows = (
        space.rows.select(F.col(space.key).alias("id"), total.alias("total"), site.alias("site"))
        .where("total IS NOT NULL")
        .orderBy("total", "id")
        .limit(k)
        .collect()
    )
    at = {id_: point for _, id_, point in best}
    return [(int(r["total"]) / STEPS, Medoid(r["id"], r["site"], at[r["site"]])) for r in rows]


# --- alternation -------------------------------------------------------------


def _recentred(space: PointSpace, fits: Sequence[Medoids]) -> list[tuple[Medoids, int]]:
    """Each cluster's medoid replaced where another member has a lesser sum; and the loss before.

    A cluster without members keeps its medoid.
    """
    points = [points_of(ms) for ms in fits]
    cells, costs = space.summarised(points, False)
    below = {(f, slot): cost for f, by_slot in enumerate(costs) for slot, cost in enumerate(by_slot) if cost}
    better = space.search(points, cells, False, 1, below)
    after = [list(ms) for ms in fits]
    for (f, slot), best in better.items():
        for _, id_, _, point in best:
            after[f][slot] = Medoid(id_, id_, point)
    return [(tuple(ms), sum(by_slot)) for ms, by_slot in zip(after, costs)]


def alternate(space: PointSpace, starts: Mapping[int, Medoids]) -> dict[int, tuple[Medoids, int]]:
    """Alternate between labels and medoids until no medoid moves; medoids and their loss in steps.

    A medoid only moves to a lesser sum, so the loss falls strictly until the end. Fits
    of several sizes move in step and share the passes of a round.
    """
    done: dict[int, tuple[Medoids, int]] = {k: (ms, 0) for k, ms in starts.items()}
    moving = list(starts)
    while moving:
        after = dict(zip(moving, _recentred(space, [done[k][0] for k in moving])))
        moving = [k for k in moving if after[k][0] != done[k][0]]
        done |= after
    return done


# --- PAM -----------------------------------------------------------------------


def swapped(space: PointSpace, medoids: Medoids) -> Medoids | None:
    """The medoids after the best swap with another point; None if none lowers the loss."""
    fit = [points_of(medoids)]
    cells, _ = space.summarised(fit, True)
    best = space.search(fit, cells, True, 1, {(0, 0): 0})[0, 0]
    if not best:
        return None
    _, id_, slot, point = best[0]
    return (*medoids[:slot], Medoid(id_, id_, point), *medoids[slot + 1 :])


def pam(space: PointSpace, start: Medoids) -> Medoids:
    """Make the best swap of a medoid and another point until none lowers the loss."""
    if len(start) == 1:
        # One medoid's best swap is the least distance sum of all.
        return alternate(space, {1: start})[1][0]
    while (after := swapped(space, start)) is not None:
        start = after
    return start


# --- entry points ----------------------------------------------------------------


def init_medoids(df: DataFrame, cols: Sequence[str], k: int, **sizes: int) -> Medoids:
    """The starting medoids: the k rows with the least distance sum to all rows."""
    with PointSpace(df, cols, **sizes) as space:
        return tuple(m for _, m in ranked_by_total(space, k))


def kmedoids(
    df: DataFrame, cols: Sequence[str], k: int, method: str = "alternate", **sizes: int
) -> Medoids:
    """Fit k medoids; ``assign`` gives the labels and ``inertia`` the loss.

    ``sizes`` are ``cells`` and ``batch`` of ``PointSpace``; they do not change the result.
    """
    if method not in ("alternate", "pam"):
        raise ValueError(f"no such method: {method}")
    with PointSpace(df, cols, **sizes) as space:
        start = tuple(m for _, m in ranked_by_total(space, k))
        return pam(space, start) if method == "pam" else alternate(space, {k: start})[k][0]


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int], **sizes: int) -> DataFrame:
    """Loss of the alternating method by number of clusters, one row per k."""
    with PointSpace(df, cols, **sizes) as space:
        order = tuple(m for _, m in ranked_by_total(space, max(ks)))
        fits = alternate(space, {k: order[:k] for k in ks})
    rows = [(int(k), fits[k][1] / STEPS) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k bigint, loss double")
