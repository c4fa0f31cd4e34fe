"""Fits against brute force over all points."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from paysegments.operators import medoids, scoring

COLS = ["x", "y"]
# Cells and batches as they come; few of both; one cell, which rules out hardly anything.
SIZES = [{}, {"cells": 7, "batch": 5}, {"cells": 1, "batch": 40}]


def table(spark, points, first=0):
    rows = [(first + i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "company_id bigint, x double, y double")


def pairwise(points):
    """All distances in steps of 1e-9."""
    p = np.asarray(points, dtype=float)
    return np.rint(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) * 1e9).astype(np.int64)


def loss(d, chosen):
    return d[:, list(chosen)].min(axis=1).sum()


def brute_start(d, k):
    total = d.sum(axis=1)
    return sorted(range(len(d)), key=lambda i: (total[i], i))[:k]


def brute_pam(d, k):
    chosen = brute_start(d, k)
    while True:
        swaps = [
            (loss(d, chosen[:s] + [h] + chosen[s + 1 :]) - loss(d, chosen), h, s)
            for h in range(len(d))
            for s in range(k)
        ]
        change, h, s = min(swaps)
        if change >= 0:
            return chosen
        chosen = chosen[:s] + [h] + chosen[s + 1 :]


def brute_alternate(d, k):
    chosen = brute_start(d, k)
    while True:
        label = d[:, chosen].argmin(axis=1)
        after = []
        for s, m in enumerate(chosen):
            members = np.flatnonzero(label == s)
            sums = [(d[h, members].sum(), h != m, h) for h in members]
            after.append(min(sums)[2] if sums else m)
        if after == chosen:
            return chosen
        chosen = after


def ids(chosen):
    return [m.id for m in chosen]


@pytest.mark.parametrize("sizes, k", [(SIZES[0], 1), (SIZES[2], 1), *[(s, 3) for s in SIZES]])
def test_equals_brute_force(spark, sizes, k):
    points = np.random.default_rng(k).lognormal(size=(50, 2))
    df, d = table(spark, points), pairwise(points)
    assert ids(medoids.init_medoids(df, COLS, k, **sizes)) == brute_start(d, k)
    assert ids(medoids.kmedoids(df, COLS, k, "pam", **sizes)) == brute_pam(d, k)
    assert ids(medoids.kmedoids(df, COLS, k, **sizes)) == brute_alternate(d, k)


@pytest.mark.parametrize("sizes", [SIZES[0], SIZES[2]])
def test_tied_distances(spark, sizes):
    points = list(itertools.product(range(5), range(5)))
    df, d = table(spark, points), pairwise(points)
    assert ids(medoids.kmedoids(df, COLS, 3, "pam", **sizes)) == brute_pam(d, 3)
    assert ids(medoids.kmedoids(df, COLS, 3, **sizes)) == brute_alternate(d, 3)


@pytest.mark.parametrize("sizes", [SIZES[0], SIZES[2]])
def test_a_third_of_the_rows_at_one_point(spark, sizes):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(30, 2)), np.full((15, 2), 0.1)])
    rng.shuffle(points)
    df, d = table(spark, points), pairwise(points)
    with medoids.PointSpace(df, COLS, **sizes) as space:
        assert space.n == 45 and space.n_sites == 31
    assert ids(medoids.init_medoids(df, COLS, 3, **sizes)) == brute_start(d, 3)
    pam = medoids.kmedoids(df, COLS, 3, "pam", **sizes)
    assert loss(d, ids(pam)) == loss(d, brute_pam(d, 3))
    alternate = medoids.kmedoids(df, COLS, 3, **sizes)
    assert loss(d, ids(alternate)) == loss(d, brute_alternate(d, 3))


def test_no_single_swap_improves(spark):
    points = np.random.default_rng(9).normal(size=(60, 2))
    d = pairwise(points)
    chosen = ids(medoids.kmedoids(table(spark, points), COLS, 4, "pam"))
    swaps = [
        loss(d, [*chosen[:s], h, *chosen[s + 1 :]]) for h in range(len(d)) for s in range(4)
    ]
    assert min(swaps) >= loss(d, chosen)


@pytest.mark.parametrize("method", ["alternate", "pam"])
def test_order_and_partitions_do_not_matter(spark, method):
    points = np.random.default_rng(2).normal(size=(70, 2))
    df = table(spark, points)
    chosen = medoids.kmedoids(df, COLS, 3, method)
    moved = df.orderBy("y").repartition(13)
    assert medoids.kmedoids(moved, COLS, 3, method) == chosen
    labels = medoids.assign(df, COLS, chosen).select("company_id", "cluster")
    again = medoids.assign(moved, COLS, chosen).select("company_id", "cluster")
    assert sorted(labels.collect()) == sorted(again.collect())


def test_planted_groups_are_found(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [50, 0], [0, 50], [50, 50]])
    points = np.concatenate([c + rng.normal(size=(25, 2)) for c in centres])
    df = table(spark, points)
    labelled = medoids.assign(df, COLS, medoids.kmedoids(df, COLS, 4, "pam"))
    rows = sorted(labelled.select("company_id", "cluster").collect())
    groups = [{r["cluster"] for r in rows[i : i + 25]} for i in range(0, 100, 25)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_one_medoid_has_the_least_distance_sum(spark):
    points = np.random.default_rng(6).normal(size=(40, 2))
    df, d = table(spark, points), pairwise(points)
    rows = medoids.elbow(df, COLS, [1, 2]).orderBy("k").collect()
    assert rows[0]["loss"] == pytest.approx(d.sum(axis=1).min() / 1e9)
    assert rows[1]["loss"] == pytest.approx(loss(d, brute_alternate(d, 2)) / 1e9)


def test_as_many_medoids_as_points(spark):
    df = table(spark, [(0, 0), (1, 5), (4, 2)])
    for method in ("alternate", "pam"):
        chosen = medoids.kmedoids(df, COLS, 3, method)
        assert sorted(ids(chosen)) == [0, 1, 2]
        assert medoids.inertia(medoids.assign(df, COLS, chosen)).first()[0] == 0
    with pytest.raises(ValueError, match="k = 4"):
        medoids.kmedoids(df, COLS, 4)
    with pytest.raises(ValueError, match="method"):
        medoids.kmedoids(df, COLS, 2, "other")


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "company_id bigint, x double, y double")
    with pytest.raises(ValueError, match="of 2 rows, y is missing or not finite in 1"):
        medoids.kmedoids(df, COLS, 1)


def test_ties_go_to_the_first_label(spark):
    near = tuple(medoids.Medoid(i, i, p) for i, p in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 0.0)]))
    df = table(spark, [(1, 0), (1.5, 0), (0, 0)])
    rows = sorted(medoids.assign(df, COLS, near).select("company_id", "cluster", "distance").collect())
    assert rows == [(0, 0, 1.0), (1, 1, 0.5), (2, 0, 0.0)]
    pairs = sorted(medoids.distance_pairs(df, COLS, near[:2]).collect())
    assert pairs == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.5), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 2.0)]


@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_odd_values_are_refused(spark, odd):
    df = table(spark, [(0, 0), (1, odd), (2, 2)])
    with pytest.raises(ValueError, match="of 3 rows, y is missing or not finite in 1"):
        medoids.kmedoids(df, COLS, 2, "pam")


def joined(words):
    """A number in two words."""
    return words[0].astype(object) * (1 << scoring.LOW) + words[1].astype(object)


@pytest.mark.parametrize("seed", range(6))
def test_swap_changes(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, size=(25, 2)).astype(float)
    weight = rng.integers(1, 4, size=25)
    k = 1 + seed % 4
    chosen = rng.choice(25, k, replace=False).tolist()
    d = pairwise(points)
    found = joined(scoring.swap_changes(d.astype(float), weight, d[:, chosen].astype(float)))
    now = (d[:, chosen].min(axis=1) * weight).sum()
    for s, h in itertools.product(range(k), range(25)):
        then = (d[:, chosen[:s] + [h] + chosen[s + 1 :]].min(axis=1) * weight).sum()
        assert found[s, h] == then - now


def test_totals_do_not_depend_on_partitions(spark):
    """Weights of 1e8 in all, where sums of doubles differ by the order of adding."""
    rng = np.random.default_rng(8)
    n = 400
    points = rng.normal(size=(n, 2)) * 10
    weight = rng.integers(1, 500_000, n)
    weight[0] += 100_000_000 - weight.sum()
    d = pairwise(points).astype(object)
    rows = [(i, int(w), *map(float, p)) for i, (w, p) in enumerate(zip(weight, points))]
    sites = spark.createDataFrame(rows, "id bigint, weight bigint, x double, y double")
    expected = [sum(int(w) * v for w, v in zip(weight, d[:, i])) for i in range(n)]
    asked = [(0, 0, tuple(p)) for p in points]
    for partitions in (1, 7, 13):
        found = scoring.within_totals(sites.repartition(partitions), COLS, [np.zeros((1, 2))], asked)
        assert found == expected


def test_jobs_do_not_grow_with_the_points(spark):
    context = spark.sparkContext
    jobs = []
    for n in (600, 6000):
        df = table(spark, np.random.default_rng(n).normal(size=(n, 2))).cache()
        df.count()
        with medoids.PointSpace(df, COLS) as space:
            start = tuple(m for _, m in medoids.ranked_by_total(space, 3))
            context.setJobGroup(f"round {n}", "")
            medoids._recentred(space, [start])
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"round {n}")))
            context.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) <= 16 and abs(jobs[0] - jobs[1]) <= 4


def spread(seed, n=400, dims=3):
    """Points with groups, copies, a far one and a grid."""
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 4, size=(n // 4, dims)).astype(float)
    far = rng.lognormal(2, 1.5, size=(n // 4, dims))
    return np.concatenate([grid, far, grid[: n // 8] + 1e-10, rng.normal(size=(n // 4, dims)), [[1e6] * dims]])


def summed(points, weight, cells, chosen, swap):
    """The cells of a fit as a job describes them."""
    pivots = points[:: max(1, len(points) // cells)][:cells]
    cell = scoring.lengths(points, pivots).argmin(axis=1)
    label, near, second = scoring.nearest(scoring.distances(points, points[chosen]))
    summing = scoring.Summing(points.shape[1], swap)
    keys = sorted(set(zip(label, cell)))
    at = {k: i for i, k in enumerate(keys)}
    inverse = np.array([at[k] for k in zip(label, cell)])
    sums, most = summing.of(points - pivots[cell], weight.astype(float), near / scoring.STEPS, second / scoring.STEPS)
    values = [np.bincount(inverse, v) for v in sums]
    for v in most:
        peak = np.zeros(len(keys))
        np.maximum.at(peak, inverse, v)
        values.append(peak)
    slots, cells_ = (np.array(k) for k in zip(*keys))
    return scoring.described({"slot": slots, "cell": cells_, "values": np.stack(values)}, pivots, swap)


@pytest.mark.parametrize("cells", [1, 9, 80])
@pytest.mark.parametrize("seed", range(3))
def test_bounds_never_rule_out_too_much(seed, cells):
    points = spread(seed)
    rng = np.random.default_rng(seed)
    weight = rng.integers(1, 5, len(points))
    d = pairwise(points)
    chosen = rng.choice(len(points), 4, replace=False).tolist()
    label = d[:, chosen].argmin(axis=1)
    described = summed(points, weight, cells, chosen, False)
    for slot in range(4):
        there, mine = described["slot"] == slot, label == slot
        bound = scoring.within_bound(points, described["mean"][there], described["weight"][there])
        assert (bound <= weight[mine] @ d[mine]).all()
    described = summed(points, weight, cells, chosen, True)
    changes = joined(scoring.swap_changes(d.astype(float), weight, d[:, chosen].astype(float))).min(axis=0)
    assert (scoring.swap_bound(points, described, 4) <= changes.astype(float)).all()


def test_few_candidates_are_scored(spark):
    points = np.random.default_rng(11).normal(size=(20_000, 5))
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "company_id long, " + ", ".join(f"{c} double" for c in cols))
    with medoids.PointSpace(df, cols) as space:
        start = tuple(m for _, m in medoids.ranked_by_total(space, 4))
        assert space.asked < 1500
        space.asked = 0
        medoids._recentred(space, [start])
        assert space.asked < 1500
        space.asked = 0
        fit = [medoids.points_of(start)]
        space.search(fit, space.summarised(fit, True)[0], True, 1, {(0, 0): 0})
        assert space.asked < 10_000  # the first swap is the worst to bound


def test_sums_of_any_size_are_exact():
    rng = np.random.default_rng(12)
    for weight in (rng.integers(1, 9, 50), rng.integers(1, 1 << 30, 50)):
        values = rng.integers(0, 1 << 35, size=(50, 3)).astype(float)
        expected = [sum(int(w) * int(v) for w, v in zip(weight, column)) for column in values.T]
        assert joined(scoring.weighted(weight, values)).tolist() == expected


@pytest.mark.parametrize("seed", range(3))
def test_region_quadratics_never_rule_out_too_much(seed):
    points = spread(seed)
    rng = np.random.default_rng(seed)
    weight = rng.integers(1, 5, len(points))
    d = pairwise(points)
    chosen = rng.choice(len(points), 4, replace=False).tolist()
    fit = points[chosen]
    label, near, second = scoring.nearest(scoring.distances(points, fit))
    changes = joined(scoring.swap_changes(d.astype(float), weight, d[:, chosen].astype(float))).min(axis=0)
    described = summed(points, weight, 80, chosen, True)
    totals = scoring.swap_sums(described, 4)
    for groups in (1, 20, 200, len(points)):
        found = scoring.grouped(points, groups)
        assert sorted(np.concatenate(found).tolist()) == list(range(len(points))) and len(found) <= groups
        at, reach = scoring.middles(points, found)
        origin = points[at].mean(axis=0)
        sums = np.zeros((len(at), 4, 11))
        for slot in range(4):
            mine = label == slot
            kept, freed = scoring.region_sums(
                points[mine] - origin, weight[mine], [near[mine] / 1e9, second[mine] / 1e9], points[at] - origin, reach
            )
            sums += kept[:, None]
            sums[:, slot] += freed - kept
        for rows, centre, far, coef in zip(found, points[at], reach, sums):
            bound = scoring.swap_region_bound(points[rows] - centre, coef[:, :-1], far, totals)
            assert (bound <= changes[rows].astype(float)).all()
    for slot in range(4):
        mine = label == slot
        centre = points[mine].mean(axis=0)
        reach = np.array([50.0, 1.0, 0.01])
        coef = scoring.region_sums(points[mine] - centre, weight[mine], [None], np.zeros((3, 3)), reach)[0]
        bound = scoring.within_region_bound(points, centre, reach, coef, weight[mine].sum())
        assert (bound <= weight[mine] @ d[mine]).all()


@pytest.mark.parametrize("most", [1, 8, 60])
def test_merged_cells_never_rule_out_too_much(most):
    points = spread(7)
    rng = np.random.default_rng(7)
    weight = rng.integers(1, 5, len(points))
    d = pairwise(points)
    chosen = rng.choice(len(points), 4, replace=False).tolist()
    changes = joined(scoring.swap_changes(d.astype(float), weight, d[:, chosen].astype(float))).min(axis=0)
    described = summed(points, weight, 80, chosen, True)
    merged = scoring.coarsened(described, most)
    assert len(merged["slot"]) < len(described["slot"]) and merged["weight"].sum() == weight.sum()
    assert (scoring.swap_bound(points, merged, 4) <= changes.astype(float)).all()


def test_swaps_equal_brute_force_through_every_level(spark, monkeypatch):
    monkeypatch.setattr(medoids, "LEVELS", (3, 12))
    monkeypatch.setattr(medoids, "FIRST", 6)
    monkeypatch.setattr(medoids, "TRIED", 2)
    points = np.random.default_rng(13).lognormal(size=(160, 2))
    df, d = table(spark, points), pairwise(points)
    assert ids(medoids.kmedoids(df, COLS, 4, "pam", cells=40, batch=30)) == brute_pam(d, 4)
    assert ids(medoids.kmedoids(df, COLS, 4, cells=40, batch=30)) == brute_alternate(d, 4)


def test_few_candidates_of_a_swap_meet_all_cells(spark, monkeypatch):
    """Pairs of candidates and cells grow with the points, not with the points times the cells."""
    points = np.random.default_rng(14).normal(size=(20_000, 5))
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "company_id long, " + ", ".join(f"{c} double" for c in cols))
    with medoids.PointSpace(df, cols) as space:
        fit = points[:4]
        cells, _ = space.summarised([fit], True)
        levels = [scoring.coarsened(cells[0], n) for n in medoids.LEVELS if 2 * n < len(cells[0]["slot"])] + cells
        limit = space._tried(fit, scoring.swap_bounds(levels[:2], 4), 0, 1)
    pairs = []
    bound = scoring.swap_bound
    monkeypatch.setattr(scoring, "swap_bound", lambda x, cell, slots: pairs.append(len(x) * len(cell["slot"])) or bound(x, cell, slots))
    found = scoring.swap_bounds(levels, 4)((0, 0), points, limit)
    assert sum(pairs) < len(points) * len(cells[0]["slot"]) / 2
    assert 0 < (found < np.inf).sum() < len(points) / 4


def test_a_round_scores_few_members_of_each_cluster(spark):
    points = np.random.default_rng(15).normal(size=(20_000, 5))
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "company_id long, " + ", ".join(f"{c} double" for c in cols))
    with medoids.PointSpace(df, cols) as space:
        fits = [tuple(medoids.Medoid(i, i, tuple(points[i])) for i in range(k)) for k in (2, 5)]
        cells, costs = space.summarised([medoids.points_of(ms) for ms in fits], False)
        below = {(f, s): cost for f, by_slot in enumerate(costs) for s, cost in enumerate(by_slot)}
        groups = [medoids.points_of(ms) for ms in fits]
        bounds = space._around_centres(groups, cells, below)
        for (f, slot), _ in below.items():
            label = scoring.nearest(scoring.distances(points, groups[f]))[0]
            members = points[label == slot]
            bound = bounds((f, slot), members, np.inf)
            first = members[np.argsort(bound)[:16]]
            best = scoring.distances(first, members).sum(axis=1).min()
            assert (bound <= best).sum() <= 100


@pytest.mark.parametrize("cells", [1, 9, 80])
@pytest.mark.parametrize("seed", range(3))
def test_swap_filter_never_rules_out_too_much(seed, cells):
    for points in (spread(seed), spread(seed) + 1e5):
        rng = np.random.default_rng(seed)
        weight = rng.integers(1, 5, len(points))
        d = pairwise(points)
        chosen = rng.choice(len(points), 4, replace=False).tolist()
        changes = joined(scoring.swap_changes(d.astype(float), weight, d[:, chosen].astype(float))).min(axis=0)
        described = summed(points, weight, cells, chosen, True)
        expanded = scoring.expanded(described, 4)
        for groups in (1, 7, len(points)):
            for rows in scoring.grouped(points, groups):
                assert (scoring.swap_filter(points[rows], expanded) <= changes[rows].astype(float)).all()


def test_only_candidates_that_are_left_meet_all_cells_one_by_one(spark, monkeypatch):
    """A candidate's bound does not depend on the others of a pass, and few candidates get one."""
    points = np.random.default_rng(16).normal(size=(4_000, 5))
    chosen = [0, 1, 2, 3]
    cell = summed(points, np.ones(len(points), int), 400, chosen, True)
    levels = [scoring.coarsened(cell, 60), cell]
    bounds = scoring.swap_bounds(levels, 4)
    limit = float(np.quantile(scoring.swap_bound(points, cell, 4), 0.05))
    asked, bound = [], scoring.swap_bound
    monkeypatch.setattr(scoring, "swap_bound", lambda x, *rest: asked.append(len(x)) or bound(x, *rest))
    found = bounds((0, 0), points, limit)
    assert (found <= limit).sum() == 200 and sum(asked) < 220
    order = np.random.default_rng(17).permutation(len(points))[:3000]
    again = bounds((0, 0), points[order], limit)
    assert (again == found[order]).all()
