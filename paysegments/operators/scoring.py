"""Jobs over the sites of a fit: sums by cell, lower bounds of candidates, exact totals.

Every job is one pass over the sites as they lie, and only sums or a bounded number of
candidates leave a task; no site is sent to another site. What a job needs from the driver
(medoids, cell sums, a batch of candidates) has a bounded size and travels with the task.

Distances are counted in steps of 1e-9, as whole numbers, and so are all totals of them.
Totals leave a task as two words, so none overflows, and adding them up in any order and
over any partitioning gives the same. Bounds are floats with a margin for their errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.shipping import ship_by_value

ship_by_value(__name__)

# Steps of a distance to one.
STEPS = 1_000_000_000
# Numbers of an array that a task works on at a time: a few such arrays fit a core's cache.
BLOCK = 1 << 15
# Bits of the low word of a sum.
LOW = 20
# Below this, whole numbers add up exactly as floats.
EXACT = float(1 << 53)
# Relative error allowed for in the bounds.
MARGIN = 1e-7


# --- arrays --------------------------------------------------------------------------


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance from each row of ``x`` to each row of ``y``."""
    total = np.zeros((len(x), len(y)))
    step = np.empty_like(total)
    for of_x, of_y in zip(x.T, np.ascontiguousarray(y.T)):
        np.subtract(of_x[:, None], of_y, out=step)
        step *= step
        total += step
    return np.sqrt(total, out=total)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same in steps: whole numbers, as floats."""
    total = lengths(x, y)
    total *= STEPS
    return np.rint(total, out=total)


def nearest(to_medoids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, distance to that medoid and to the second nearest (infinite for one medoid)."""
    rows = np.arange(len(to_medoids))
    label = to_medoids.argmin(axis=1)
    near = to_medoids[rows, label]
    others = np.array(to_medoids, float)
    others[rows, label] = np.inf
    return label, near, others.min(axis=1)


def own_slots(x: np.ndarray, medoids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Clusters as candidates: a medoid is in its own, however near another one is."""
    own = label.copy()
    for slot in reversed(range(len(medoids))):
        own[(x == medoids[slot]).all(axis=1)] = slot
    return own


def weighted(weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weighted sums of the columns of ``values``, whole numbers, as (high, low) words."""
    if values.size and float(weight.sum()) * float(np.abs(values).max()) < EXACT:
        whole = (weight.astype(float) @ values).astype(np.int64)
        return np.stack([whole >> LOW, whole & ((1 << LOW) - 1)])
    whole = values.astype(np.int64)
    return np.stack([weight @ (whole >> LOW), weight @ (whole & ((1 << LOW) - 1))])


def swap_changes(d: np.ndarray, weight: np.ndarray, to_medoids: np.ndarray) -> np.ndarray:
    """Change of the loss (words by medoid and candidate) if the candidate replaced the medoid."""
    label, near, second = nearest(to_medoids)
    kept = np.minimum(d, near[:, None])
    sums = np.repeat(weighted(weight, kept - near[:, None])[:, None], to_medoids.shape[1], axis=1)
    for slot in range(to_medoids.shape[1]):
        members = label == slot
        if members.any():
            freed = np.minimum(d[members], second[members, None]) - kept[members]
            sums[:, slot] += weighted(weight[members], freed)
    return sums


def _parts(batch: pa.RecordBatch, names: Sequence[str], width: int) -> Iterator[dict[str, np.ndarray]]:
    """A batch in parts so that part x ``width`` numbers fit a block."""
    x = np.column_stack([batch.column(c).to_numpy() for c in names])
    more = {c: batch.column(c).to_numpy() for c in batch.schema.names if c not in names}
    rows = max(1, BLOCK // max(width, 1))
    for at in range(0, len(x), rows):
        yield {"x": x[at : at + rows]} | {c: v[at : at + rows] for c, v in more.items()}


# --- cells ---------------------------------------------------------------------------


def with_cells(sites: DataFrame, cols: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """The sites with ``cell``, the nearest of the pivots."""
    names = list(cols)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lengths(part["x"], pivots).argmin(axis=1) for part in _parts(batch, names, len(pivots))]
            cell = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return sites.mapInArrow(task, f"{', '.join(f'`{c}` double' for c in names)}, id long, weight long, cell int")


class Summing:
    """What a search asks of the cells of a fit's clusters: sums over the points of a cell.

    A cell's points are described by their weight and the sum of their offsets from the
    pivot; for swaps also by second moments, and by moments of the radius inside which a
    candidate gains on a medoid: the distance to the nearest medoid, and to the second.
    """

    def __init__(self, dims: int, swap: bool):
        self.dims, self.swap = dims, swap
        self.pairs = [(i, j) for i in range(dims) for j in range(i, dims)] if swap else []
        self.n_sums = 1 + dims + len(self.pairs) + 2 * (2 + dims) * swap
        self.n_most = 3 * swap  # farthest offset, and both radii

    def of(self, offset: np.ndarray, weight: np.ndarray, near: np.ndarray, second: np.ndarray):
        """The numbers of each point to be added up, and those of which the most counts."""
        sums = [weight, *(weight * offset.T)]
        if not self.swap:
            return sums, []
        sums += [weight * offset[:, i] * offset[:, j] for i, j in self.pairs]
        for radius in (near, second):
            sums += [weight * radius, weight * radius * radius, *(weight * radius * offset.T)]
        return sums, [np.sqrt((offset * offset).sum(axis=1)), near, second]


def summarise(
    sites: DataFrame, cols: Sequence[str], pivots: np.ndarray, fits: Sequence[np.ndarray], swap: bool
) -> tuple[list[dict[str, np.ndarray]], list[list[int]]]:
    """By fit the cells of its clusters, and the exact distance sum of every cluster to its medoid."""
    names, medoids, cells = list(cols), list(fits), len(pivots)
    summing = Summing(len(names), swap)
    n_sums, n_most = summing.n_sums, summing.n_most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adding = Summing(len(names), swap)
        sums = [np.zeros((n_sums, len(m) * cells)) for m in medoids]
        most = [np.zeros((n_most, len(m) * cells)) for m in medoids]
        costs = [np.zeros((2, len(m)), np.int64) for m in medoids]
        for batch in batches:
            for part in _parts(batch, names, 8):
                x, weight, cell = part["x"], part["weight"], part["cell"]
                offset = x - pivots[cell]
                for f, m in enumerate(medoids):
                    label, near, second = nearest(distances(x, m))
                    for slot in np.unique(label):
                        mine = label == slot
                        costs[f][:, slot] += weighted(weight[mine], near[mine, None])[:, 0]
                    key = label * cells + cell
                    if len(m) == 1:
                        second = near
                    added, peaks = adding.of(offset, weight.astype(float), near / STEPS, second / STEPS)
                    for i, values in enumerate(added):
                        sums[f][i] += np.bincount(key, values, minlength=sums[f].shape[1])
                    for i, values in enumerate(peaks):
                        np.maximum.at(most[f][i], key, values)
        for f, m in enumerate(medoids):
            for slot in range(len(m)):  # the cost of a cluster, in place of a cell
                row = np.zeros((n_sums + n_most, 1))
                row[:2, 0] = costs[f][:, slot]
                yield _summary_rows(f, np.array([slot]), np.array([-1]), row)
            filled = np.flatnonzero(sums[f][0])
            yield _summary_rows(f, filled // cells, filled % cells, np.concatenate([sums[f], most[f]])[:, filled])

    read = sites.select(*names, "weight", "cell")
    numbers = [f"v{i}" for i in range(n_sums + n_most)]
    schema = "fit int, slot int, cell int, " + ", ".join(f"{v} double" for v in numbers)
    merged = read.mapInArrow(task, schema).groupBy("fit", "slot", "cell").agg(
        *[F.expr(f"sum({v}) AS {v}") for v in numbers[:n_sums]], *[F.expr(f"max({v}) AS {v}") for v in numbers[n_sums:]]
    )
    rows = merged.toArrow()  # cells times clusters at most
    columns = {c: rows.column(c).to_numpy() for c in ("fit", "slot", "cell", *numbers)}
    found, costs = [], []
    for f, m in enumerate(medoids):
        mine = columns["fit"] == f
        whole = mine & (columns["cell"] < 0)
        by_slot = dict(zip(columns["slot"][whole], zip(columns["v0"][whole], columns["v1"][whole])))
        costs.append([(int(by_slot[s][0]) << LOW) + int(by_slot[s][1]) if s in by_slot else 0 for s in range(len(m))])
        cell = mine & (columns["cell"] >= 0)
        order = np.lexsort([columns["cell"][cell], columns["slot"][cell]])
        found.append(
            {"slot": columns["slot"][cell][order], "cell": columns["cell"][cell][order]}
            | {"values": np.stack([columns[v][cell][order] for v in numbers])}
        )
    return found, costs


def _summary_rows(fit: int, slot: np.ndarray, cell: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(np.full(len(slot), fit), pa.int32()), pa.array(slot, pa.int32()), pa.array(cell, pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*ints, *[pa.array(v) for v in values]], ["fit", "slot", "cell", *[f"v{i}" for i in range(len(values))]]
    )


# --- bounds --------------------------------------------------------------------------


def within_bound(x: np.ndarray, means: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """At most the distance sum, in steps, from each candidate to points of the given cell means.

    A distance is convex in the point, so the mean of distances is no less than the
    distance to the mean.
    """
    found = (lengths(x, means) * weight).sum(axis=1)
    return found * (STEPS * (1 - MARGIN)) - weight.sum() - 1


def gain_bounds(x: np.ndarray, cell: dict[str, np.ndarray]) -> list[np.ndarray]:
    """At least what the points of each cell gain if the candidate is added, by candidate and cell.

    A point gains what the candidate is nearer than its radius r, max(r - d, 0). With a the
    difference by the tangent of d at the cell's mean, which is at least r - d, the sum of
    max(a, 0) is (sum of a + sum of |a|) / 2, and the latter at most the root of n times
    the sum of squares, which follows from the cell's moments. One result for each radius:
    the distance to the nearest medoid and to the second.
    """
    n, mean, cov = cell["weight"], cell["mean"], cell["cov"]
    steps = [of_mean - of_x[:, None] for of_x, of_mean in zip(x.T, np.ascontiguousarray(mean.T))]
    to_mean, spread = np.zeros(steps[0].shape), np.zeros(steps[0].shape)
    for i, step in enumerate(steps):
        rest = step * (cov[i, i] / 2)
        for j in range(i + 1, len(steps)):
            rest += steps[j] * cov[i, j]
        rest *= step
        spread += rest
        to_mean += step * step
    spread *= 2
    np.sqrt(to_mean, out=to_mean)
    at_mean = to_mean == 0
    away = np.where(at_mean, 1.0, to_mean)
    spread /= away
    spread /= away
    found = []
    for radius in ("0", "1"):
        r, rr, cross, widest = (cell[name + radius] for name in ("r", "rr", "cross", "widest"))
        along = steps[0] * cross[0]
        for i, step in enumerate(steps[1:], 1):
            along += step * cross[i]
        squares = spread + rr - 2 * along / away + to_mean * (n * to_mean - 2 * r)
        # at the mean itself the tangent may be any; there the distance is at least 0
        squares[at_mean] = np.broadcast_to(rr, squares.shape)[at_mean]
        bound = (r - n * to_mean + np.sqrt(n * np.maximum(squares, 0))) / 2
        bound = np.maximum(bound, 0) + MARGIN * n * (widest + to_mean + cell["reach"])
        bound[to_mean - cell["reach"] >= widest] = 0
        found.append(bound)
    return found


def described(summary: dict[str, np.ndarray], pivots: np.ndarray, swap: bool) -> dict[str, np.ndarray]:
    """The cells of a fit by weight and mean, and for swaps their moments about the mean."""
    dims = pivots.shape[1]
    values, cell = summary["values"], summary["cell"]
    weight, shift = values[0], values[1 : 1 + dims] / values[0]
    found = {"slot": summary["slot"], "weight": weight, "mean": pivots[cell] + shift.T}
    if not swap:
        return found
    pairs = Summing(dims, True).pairs
    cov = np.zeros((dims, dims, len(cell)))
    for (i, j), moment in zip(pairs, values[1 + dims :]):
        cov[i, j] = moment - weight * shift[i] * shift[j]
    found["cov"] = cov
    at = 1 + dims + len(pairs)
    for radius in (0, 1):
        r, rr, cross = values[at], values[at + 1], values[at + 2 : at + 2 + dims]
        found |= {f"r{radius}": r, f"rr{radius}": rr, f"cross{radius}": cross - r * shift}
        at += 2 + dims
    found["reach"] = values[at] + np.sqrt((shift * shift).sum(axis=0)) * (1 + MARGIN)
    return found | {"widest0": values[at + 1], "widest1": values[at + 2]}


def swap_bound(x: np.ndarray, cell: dict[str, np.ndarray], slots: int) -> np.ndarray:
    """At most the change of the loss, in steps, of the candidate's best swap.

    Without the medoid, its points go to the second nearest; the candidate then gains
    on the nearest medoid of all points, or on the second nearest for those points.
    """
    near, second = gain_bounds(x, cell)
    gains = near.sum(axis=1)
    best = np.full(len(x), np.inf)
    for slot in range(slots):
        mine = cell["slot"] == slot
        lost = cell["r1"][mine].sum() - cell["r0"][mine].sum()
        best = np.minimum(best, lost - (gains - near[:, mine].sum(axis=1) + second[:, mine].sum(axis=1)))
    margin = MARGIN * cell["r1"].sum() + 4 * cell["weight"].sum() / STEPS
    return (best - margin) * STEPS


# Candidates that are bounded together: near ones, to which the same far cells mean nothing.
TOGETHER = 64
# Cells at a time, so that a few arrays of cells and candidates fit a core's cache.
STRIP = 512
# Relative error allowed for where moments are taken about one place instead of each candidate, and
# the least distance, as a share of how far both are from that place, at which this holds.
ROUGH, CLEAR = 1e-6, 0.05


def expanded(cell: dict[str, np.ndarray], slots: int) -> dict[str, np.ndarray]:
    """The described cells of a swap as polynomials in the candidate, about the middle of the cells."""
    n, dims = cell["weight"], cell["mean"].shape[1]
    origin = (n @ cell["mean"]) / n.sum()
    m = (cell["mean"] - origin).T
    pairs = Summing(dims, True).pairs
    moved = np.zeros_like(m)
    for i, j in pairs:
        moved[i] += cell["cov"][i, j] * m[j]
        if i != j:
            moved[j] += cell["cov"][i, j] * m[i]
    found = {"origin": origin, "n": n, "mean": np.ascontiguousarray(m), "far": np.sqrt((m * m).sum(axis=0))}
    found["spread"] = np.stack(
        [(m * moved).sum(axis=0), *(-2 * moved), *[cell["cov"][i, j] * (1 if i == j else 2) for i, j in pairs]]
    )
    for radius in ("0", "1"):
        cross = cell["cross" + radius]
        found["along" + radius] = 2 * np.stack([(m * cross).sum(axis=0), *-cross])
        found["r" + radius], found["rr" + radius] = cell["r" + radius], cell["rr" + radius]
        found["ends" + radius] = cell["widest" + radius] + cell["reach"]
    found["member"] = (cell["slot"][:, None] == np.arange(slots)).astype(float)
    found["lost"] = (cell["r1"] - cell["r0"]) @ found["member"]
    found["margin"] = MARGIN * cell["r1"].sum() + 4 * n.sum() / STEPS
    return found


def swap_filter(x: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """Like ``swap_bound`` of each candidate, a little lower, from the cells as ``expanded`` gives them.

    It is for candidates that lie together. Its last digits depend on which these are, so it
    may rule out candidates but not put them in order.
    """
    x = x - cells["origin"]
    dims, slots = x.shape[1], cells["member"].shape[1]
    middle = (x.min(axis=0) + x.max(axis=0)) / 2
    reach = np.sqrt(((x - middle) ** 2).sum(axis=1)).max() * (1 + MARGIN)
    away = lengths(middle[None], cells["mean"].T)[0] * (1 - MARGIN) - reach
    gains = [away < cells["ends0"], away < cells["ends1"]]
    # all others gain nothing: those that gain on the nearest medoid first
    order = [np.flatnonzero(gains[0]), np.flatnonzero(gains[1] & ~gains[0])]
    x_far = np.sqrt((x * x).sum(axis=1))
    terms = np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in Summing(dims, True).pairs]])
    line = np.ascontiguousarray(terms[:, : 1 + dims])
    total, by_slot, slack = np.zeros(len(x)), np.zeros((len(x), slots)), np.zeros(len(x))
    for radii, rows in (((0, 1), order[0]), ((1,), order[1])):
        for at in range(0, len(rows), STRIP):
            some = rows[at : at + STRIP]
            n, member = cells["n"][some], cells["member"][some]
            d = lengths(x, cells["mean"][:, some].T)
            # too near: the distance counts as 0, which is at least what the points gain
            near = d <= CLEAR * (x_far[:, None] + cells["far"][some])
            inverse = 1 / np.where(near, 1.0, d)
            spread = terms @ cells["spread"][:, some]
            spread *= inverse
            spread *= inverse
            nd = n * d
            for radius in radii:
                r, ends = cells[f"r{radius}"][some], cells[f"ends{radius}"][some]
                squares = line @ cells[f"along{radius}"][:, some]
                squares *= inverse
                np.subtract(spread, squares, out=squares)
                squares += cells[f"rr{radius}"][some]
                squares += d * (nd - 2 * r)
                np.maximum(squares, 0, out=squares)
                squares *= n
                gain = np.sqrt(squares, out=squares)
                gain -= nd
                gain += r
                gain *= 0.5
                np.maximum(gain, 0, out=gain)
                gain[near] = np.broadcast_to(r, gain.shape)[near]
                gain *= d * (1 - MARGIN) < ends
                slack += n @ ends + nd.sum(axis=1)
                found = gain @ member
                if radius:
                    by_slot += found
                else:
                    total += found.sum(axis=1)
                    by_slot -= found
    best = (cells["lost"] - total[:, None] - by_slot).min(axis=1)
    return (best - ROUGH * slack - cells["margin"]) * STEPS


# --- regions -------------------------------------------------------------------------


# Regions in a row that leaves a task.
ROW_REGIONS = 32
# Regions that a task adds to at a time.
TILE = 128
# Below this share of a centre's length, a difference from it is not told from rounding.
TINY = 1e-4


def quadratic(delta: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """The quadratics ``coef`` (a row, or one for all: constant, linear, pairs) at the offsets.

    Term by term, so that a row gives the same wherever it stands.
    """
    dims = delta.shape[1]
    found = np.array(np.broadcast_to(coef[..., 0], len(delta)), float)
    for i in range(dims):
        found += coef[..., 1 + i] * delta[:, i]
    for at, (i, j) in enumerate(Summing(dims, True).pairs, 1 + dims):
        found += coef[..., at] * (delta[:, i] * delta[:, j])
    return found


def region_sums(
    x: np.ndarray, weight: np.ndarray, radii: Sequence[np.ndarray | None], centres: np.ndarray, reach: np.ndarray
) -> list[np.ndarray]:
    """Quadratics in the offset from each centre, at least the weighted sum of max(r - d, 0) within reach.

    d is the distance from the point to centre and offset, r the point's radius; one result
    for each of ``radii``, and for None at least the sum of -d. The last column is the value
    at the centre. With u the direction and q the part of the offset across it, d is no less
    than d0 + u offset + q^2 / (2 (d0 + reach)). Where r lies inside the range of d, the
    maximum is at most the chord between the range's ends.
    """
    dims = x.shape[1]
    pairs = Summing(dims, True).pairs
    d = lengths(x, centres)
    w = weight[:, None].astype(float)
    close = d <= TINY * np.sqrt((centres * centres).sum(axis=1)) + 1e-300
    inverse = np.where(close, 0.0, 1 / np.where(close, 1.0, d))
    bend = np.where(close, 0.0, 0.5 * w / np.where(close, 1.0, d + reach))
    products = np.column_stack([x[:, i] * x[:, j] for i, j in pairs])
    found = []
    for r in radii:
        sums = np.empty((len(centres), 2 + dims + len(pairs)))
        if r is None:
            sums[:, 0], at, slope, curved = -(weight @ np.where(close, 0, d)), -d, w * inverse, bend
        else:
            a = r[:, None] - d
            inside = a >= reach
            share = np.clip((a + reach) / np.maximum(2 * reach, 1e-300), 0, 1)
            share[inside] = 1
            most = np.where(inside, a, share * reach)
            sums[:, 0] = weight @ np.where(close, r[:, None], most)
            at, slope, curved = np.maximum(a, 0), w * share * inverse, bend * inside
        sums[:, -1] = weight @ at
        sums[:, 1 : 1 + dims] = slope.T @ x - centres * slope.sum(axis=0)[:, None]
        flat = curved.sum(axis=0)
        curved = curved * inverse * inverse
        whole, once, twice = curved.sum(axis=0), curved.T @ x, curved.T @ products
        for n, (i, j) in enumerate(pairs):
            across = centres[:, i] * centres[:, j] * whole - centres[:, i] * once[:, j] - centres[:, j] * once[:, i] + twice[:, n]
            sums[:, 1 + dims + n] = across - flat if i == j else 2 * across
        found.append(sums)
    return found


def _added_floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the arrays of each chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, chunk in enumerate(batch.column("chunk").to_pylist()):
            values = batch.column("sums")[i].values.to_numpy()
            sums[chunk] = sums[chunk] + values if chunk in sums else values
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["chunk", "sums"]
    )


def _region_totals(sites: DataFrame, cols: Sequence[str], add: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """What ``add`` adds, batch by batch, to an array of this shape, over all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for batch in batches:
            add(sums, batch)
        starts = range(0, len(sums), ROW_REGIONS)
        rows = [sums[s : s + ROW_REGIONS].reshape(-1) for s in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(starts)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["chunk", "sums"]
        )

    schema = "chunk int, sums array<double>"
    rows = sites.select(*cols, "weight").mapInArrow(task, schema).repartition("chunk").mapInArrow(_added_floats, schema)
    found = {chunk: sums.values.to_numpy() for chunk, sums in zip(*_listed(rows.toArrow()))}
    if not found:
        return np.zeros(shape)
    return np.concatenate([found[chunk] for chunk in sorted(found)]).reshape(shape)


def _listed(rows: pa.Table) -> tuple[list, list]:
    return rows.column("chunk").to_pylist(), list(rows.column("sums"))


def swap_regions(
    sites: DataFrame, cols: Sequence[str], fit: np.ndarray, centres: np.ndarray, reach: np.ndarray
) -> np.ndarray:
    """By region and medoid: the quadratic that is at least what a candidate gains in its place."""
    names, origin = list(cols), centres.mean(axis=0)
    middle, slots = centres - origin, len(fit)
    width = 2 + len(names) + len(names) * (len(names) + 1) // 2

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        x, weight = np.column_stack([batch.column(c).to_numpy() for c in names]), batch.column("weight").to_numpy()
        if not len(x):
            return
        label, near, second = nearest(distances(x, fit))
        rows = BLOCK // TILE
        for slot in np.unique(label):
            mine = np.flatnonzero(label == slot)
            for at in range(0, len(mine), rows):
                part = mine[at : at + rows]
                points, radii = x[part] - origin, [near[part] / STEPS, second[part] / STEPS]
                for first in range(0, len(middle), TILE):
                    tile = slice(first, first + TILE)
                    kept, freed = region_sums(points, weight[part], radii, middle[tile], reach[tile])
                    sums[tile] += kept[:, None]
                    sums[tile, slot] += freed - kept

    return _region_totals(sites, names, add, (len(centres), slots, width))


def within_regions(
    sites: DataFrame, cols: Sequence[str], fits: Sequence[np.ndarray], groups: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
) -> dict[tuple[int, int], np.ndarray]:
    """By group and reach: the quadratic that is at least minus the distance sum to the group's points.

    ``groups`` has the centre and the reaches of each (fit, slot).
    """
    names, medoids, place = list(cols), list(fits), {g: i for i, g in enumerate(groups)}
    width = 2 + len(names) + len(names) * (len(names) + 1) // 2
    reaches = len(next(iter(groups.values()))[1])

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in _parts(batch, names, 4):
            for f in sorted({f for f, _ in groups}):
                label = nearest(distances(part["x"], medoids[f]))[0]
                for slot in np.unique(label):
                    if (f, slot) in place:
                        mine, (centre, reach) = label == slot, groups[f, slot]
                        # the centre as the origin: nothing cancels
                        x, middle = part["x"][mine] - centre, np.zeros((len(reach), len(centre)))
                        sums[place[f, slot]] += region_sums(x, part["weight"][mine], [None], middle, reach)[0]

    found = _region_totals(sites, names, add, (len(groups), reaches, width))
    return {g: found[i] for g, i in place.items()}


def within_region_bound(x: np.ndarray, centre: np.ndarray, reach: np.ndarray, coef: np.ndarray, weight: float) -> np.ndarray:
    """At most the distance sum, in steps, from each candidate to the points of a group.

    Beyond a reach the sum, which is convex, goes on at least as steeply as from the centre to there.
    """
    delta = x - centre
    far = np.sqrt((delta * delta).sum(axis=1))
    best = np.full(len(x), -np.inf)
    for r, c in zip(reach, coef):
        past = np.maximum(far / r, 1) if r > 0 else np.ones(len(x))
        inner = -quadratic(delta / past[:, None], c)
        found = -c[-1] + past * (inner + c[-1])
        if r <= 0:
            found[far > 0] = -np.inf
        best = np.maximum(best, found)
    return (best - MARGIN * (abs(coef[0, -1]) + weight * far)) * STEPS - weight - 1


def swap_region_bound(delta: np.ndarray, coef: np.ndarray, reach: np.ndarray, totals: dict[str, np.ndarray]) -> np.ndarray:
    """At most the change of the loss, in steps, of each candidate's best swap, from its region's quadratics."""
    best = np.full(len(delta), np.inf)
    for slot, lost in enumerate(totals["lost"]):
        best = np.minimum(best, lost - quadratic(delta, coef[..., slot, :]))
    return (best - swap_margin(reach, totals)) * STEPS


def swap_margin(reach: np.ndarray, totals: dict[str, np.ndarray]) -> np.ndarray:
    return MARGIN * (totals["second"] + totals["weight"] * reach) + 4 * totals["weight"] / STEPS


def swap_sums(cell: dict[str, np.ndarray], slots: int) -> dict[str, np.ndarray]:
    """Of all points: weight, distances to the second nearest, and what the loss of each medoid costs."""
    lost = np.bincount(cell["slot"], cell["r1"] - cell["r0"], minlength=slots)
    return {"lost": lost, "second": cell["r1"].sum(), "weight": cell["weight"].sum()}


def grouped(points: np.ndarray, groups: int) -> list[np.ndarray]:
    """The rows of the points in at most so many groups of near ones, halved along the widest column."""
    found, waiting = [], [(np.arange(len(points)), groups)]
    while waiting:
        rows, most = waiting.pop()
        if most < 2 or len(rows) < 2:
            found.append(rows)
            continue
        here = points[rows]
        order = rows[np.argsort(here[:, np.ptp(here, axis=0).argmax()], kind="stable")]
        left = most // 2
        cut = min(max(len(rows) * left // most, 1), len(rows) - 1)
        waiting += [(order[:cut], left), (order[cut:], most - left)]
    return found


def middles(points: np.ndarray, groups: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each group the row nearest to its middle, and how far the group reaches from there."""
    rows, far = [], []
    for g in groups:
        here = points[g]
        middle = (here.min(axis=0) + here.max(axis=0)) / 2
        rows.append(g[((here - middle) ** 2).sum(axis=1).argmin()])
        far.append(np.sqrt(((here - points[rows[-1]]) ** 2).sum(axis=1)).max())
    return np.array(rows), np.array(far) * (1 + MARGIN)


def coarsened(cell: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """The described cells of a swap merged with near ones of their cluster, to about so many."""
    merged = np.empty(len(cell["slot"]), int)
    n = 0
    for slot in np.unique(cell["slot"]):
        mine = np.flatnonzero(cell["slot"] == slot)
        for rows in grouped(cell["mean"][mine], -(-most * len(mine) // len(merged))):
            merged[mine[rows]], n = n, n + 1

    def add(values: np.ndarray) -> np.ndarray:
        return np.bincount(merged, values, minlength=n)

    def most_of(values: np.ndarray) -> np.ndarray:
        found = np.zeros(n)
        np.maximum.at(found, merged, values)
        return found

    weight = add(cell["weight"])
    mean = np.stack([add(cell["weight"] * c) / weight for c in cell["mean"].T], axis=1)
    shift = (cell["mean"] - mean[merged]).T
    slot = np.zeros(n, cell["slot"].dtype)
    slot[merged] = cell["slot"]
    found = {"slot": slot, "weight": weight, "mean": mean, "cov": np.zeros((len(shift), len(shift), n))}
    for i, j in Summing(len(shift), True).pairs:
        found["cov"][i, j] = add(cell["cov"][i, j] + cell["weight"] * shift[i] * shift[j])
    for radius in ("0", "1"):
        r = cell["r" + radius]
        found |= {"r" + radius: add(r), "rr" + radius: add(cell["rr" + radius])}
        found["cross" + radius] = np.stack([add(c + r * by) for c, by in zip(cell["cross" + radius], shift)])
        found["widest" + radius] = most_of(cell["widest" + radius])
    return found | {"reach": most_of(cell["reach"] + np.sqrt((shift * shift).sum(axis=0))) * (1 + MARGIN)}


def central(means: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """About the point with the least weighted distance sum to the means, and the mean distance to it."""
    some = np.argsort(-weight, kind="stable")[:512]
    centre = means[some[within_bound(means[some], means, weight).argmin()]]
    d = lengths(means, centre[None])[:, 0]
    for _ in range(50):
        # a mean near the centre does not hold it
        pull = weight / np.maximum(np.hypot(d, 0.01 * (weight @ d) / weight.sum()), 1e-300)
        after = (pull @ means) / pull.sum()
        moved, centre = np.abs(after - centre).max(), after
        d = lengths(means, centre[None])[:, 0]
        if moved <= 1e-9 * d.max():
            break
    return centre, float(weight @ d / weight.sum())


# --- candidates ----------------------------------------------------------------------


# group (fit, slot) -> (bound, id) after which candidates are asked for, and the most that counts
Range = tuple[float, int, float]


def lowest(
    sites: DataFrame,
    cols: Sequence[str],
    fits: Sequence[np.ndarray],
    bounds: Callable[[tuple[int, int], np.ndarray, float], np.ndarray],
    ranges: dict[tuple[int, int], Range],
    keep: int,
    swap: bool,
) -> dict[tuple[int, int], list[tuple[float, int, tuple[float, ...]]]]:
    """(bound, id, point) of the ``keep`` candidates with the least bounds, by group, in order.

    Without ``swap`` a group is a cluster of a fit, and its candidates are its points. With
    ``swap`` there is one group, of all points. ``bounds`` gives a group's candidates
    bounds from below; infinite ones may stand for any above the most that counts.
    """
    names, medoids, wanted = list(cols), list(fits), dict(ranges)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {group: [] for group in wanted}

        def least(group) -> tuple:
            bound, ids, x = (np.concatenate(part) for part in zip(*held[group]))
            order = np.lexsort([ids, bound])[:keep]
            return bound[order], ids[order], x[order]

        def offer(group, bound: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            after, last, most = wanted[group]
            good = (bound < np.inf) & (bound <= most) & ((bound > after) | ((bound == after) & (ids > last)))
            if good.any():
                held[group].append((bound[good], ids[good], x[good]))
                if sum(len(h[0]) for h in held[group]) > 4 * keep:
                    held[group] = [least(group)]

        for batch in batches:
            if swap:
                for part in _parts(batch, names, 1):
                    offer((0, 0), bounds((0, 0), part["x"], wanted[0, 0][2]), part["id"], part["x"])
                continue
            for part in _parts(batch, names, 4):
                x, ids = part["x"], part["id"]
                for f, m in enumerate(medoids):
                    own = own_slots(x, m, nearest(distances(x, m))[0])
                    for slot in np.unique(own):
                        if (f, slot) in wanted:
                            mine = own == slot
                            offer((f, int(slot)), bounds((f, slot), x[mine], wanted[f, slot][2]), ids[mine], x[mine])
        for (f, slot), some in held.items():
            if some:
                bound, ids, x = least((f, slot))
                ints = [pa.array(np.full(len(ids), v), pa.int32()) for v in (f, slot)]
                yield pa.RecordBatch.from_arrays(
                    [*ints, pa.array(bound), pa.array(ids), *[pa.array(np.ascontiguousarray(c)) for c in x.T]],
                    ["fit", "slot", "bound", "id", *[f"x{i}" for i in range(x.shape[1])]],
                )

    points = [f"x{i}" for i in range(len(names))]
    schema = "fit int, slot int, bound double, id long, " + ", ".join(f"{p} double" for p in points)
    order = Window.partitionBy("fit", "slot").orderBy("bound", "id")
    offered = sites.select(*names, "id").mapInArrow(task, schema)
    rows = offered.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n").toArrow()
    found: dict = {group: [] for group in wanted}
    listed = zip(*[rows.column(c).to_pylist() for c in ("bound", "id", "fit", "slot", *points)])
    for bound, id_, fit, slot, *point in sorted(listed):
        found[fit, slot].append((bound, id_, tuple(point)))
    return found


def within_bounds(groups: dict[tuple[int, int], tuple], coefs: dict[tuple[int, int], np.ndarray], weight: dict[tuple[int, int], float]) -> Callable:
    """The bounds of candidates within their clusters, for ``lowest``."""

    def bounds(group: tuple[int, int], x: np.ndarray, most: float) -> np.ndarray:
        return within_region_bound(x, *groups[group], coefs[group], weight[group])

    return bounds


def swap_bounds(levels: Sequence[dict[str, np.ndarray]], slots: int) -> Callable:
    """The bounds of candidates for a swap, for ``lowest``: the cells of each level, few ones first, rule
    out what they can. What is left is bounded by the last level's, each candidate by itself, so that it
    has the same bound in every pass."""
    filters = [expanded(cell, slots) for cell in levels]

    def bounds(group: tuple[int, int], x: np.ndarray, most: float) -> np.ndarray:
        left = np.arange(len(x))
        for cells in filters:
            kept = [left[:0]]
            for together in grouped(x[left], -(-len(left) // TOGETHER)):
                some = left[together]
                if len(some):
                    kept.append(some[swap_filter(x[some], cells) <= most])
            left = np.sort(np.concatenate(kept))
        found = np.full(len(x), np.inf)
        rows = max(1, BLOCK // 4 // len(levels[-1]["slot"]))
        for at in range(0, len(left), rows):
            some = left[at : at + rows]
            found[some] = swap_bound(x[some], levels[-1], slots)
        found[found > most] = np.inf
        return found

    return bounds


# --- totals --------------------------------------------------------------------------


# Sums in a row that leaves a task.
CHUNK = 1024


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the arrays of each chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, high, low in zip(*[batch.column(c).to_pylist() for c in ("chunk", "high", "low")]):
            words = np.array([high, low], np.int64)
            sums[chunk] = sums[chunk] + words if chunk in sums else words
    lists = [pa.array([w[i] for w in sums.values()], pa.list_(pa.int64())) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *lists], ["chunk", "high", "low"])


def _totals(sites: DataFrame, cols: Sequence[str], task: Callable) -> dict[int, int]:
    """Sums over all tasks, by place in the arrays that the tasks give.

    A task gives a row per chunk, and a chunk's arrays are added up by one task.
    """
    schema = "chunk int, high array<long>, low array<long>"
    sums = sites.select(*cols, "weight").mapInArrow(task, schema).repartition("chunk").mapInArrow(_added, schema)
    return {
        r["chunk"] * CHUNK + i: (high << LOW) + low
        for r in sums.collect()
        for i, (high, low) in enumerate(zip(r["high"], r["low"]))
    }


def _sum_rows(words: np.ndarray) -> pa.RecordBatch:
    """A task's sums, CHUNK to a row."""
    high, low = words.reshape(2, -1)
    starts = range(0, len(high), CHUNK)
    lists = [pa.array([part[s : s + CHUNK] for s in starts], pa.list_(pa.int64())) for part in (high, low)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), *lists], ["chunk", "high", "low"])


def within_totals(
    sites: DataFrame, cols: Sequence[str], fits: Sequence[np.ndarray], asked: Sequence[tuple[int, int, tuple]]
) -> list[int]:
    """Exact distance sum of each asked (fit, slot, point) to the points of that cluster."""
    names, medoids = list(cols), list(fits)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (f, slot, _) in enumerate(asked):
        groups.setdefault((f, slot), []).append(i)
    points = np.array([p for *_, p in asked], float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(points)), np.int64)
        used = sorted({f for f, _ in groups})
        for batch in batches:
            for part in _parts(batch, names, max(len(g) for g in groups.values())):
                label = {f: nearest(distances(part["x"], medoids[f]))[0] for f in used}
                for (f, slot), mine in groups.items():
                    there = label[f] == slot
                    if there.any():
                        sums[:, mine] += weighted(part["weight"][there], distances(part["x"][there], points[mine]))
        yield _sum_rows(sums)

    found = _totals(sites, names, task)
    return [found.get(i, 0) for i in range(len(points))]


def swap_totals(sites: DataFrame, cols: Sequence[str], fit: np.ndarray, asked: Sequence[tuple]) -> list[list[int]]:
    """Exact change of the loss by asked point and medoid that it would replace."""
    names, points = list(cols), np.array(asked, float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(fit), len(points)), np.int64)
        for batch in batches:
            for part in _parts(batch, names, len(points)):
                sums += swap_changes(distances(part["x"], points), part["weight"], distances(part["x"], fit))
        yield _sum_rows(sums)

    found = _totals(sites, names, task)
    return [[found.get(s * len(points) + i, 0) for s in range(len(fit))] for i in range(len(points))]
