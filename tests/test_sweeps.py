"""Sweeps of K-Means and mixtures against NumPy over the same points."""

import numpy as np
from comptoir.operators import clusters, sweeps

AXES = clusters.AXES


def frame(spark, points, parts=3):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "client_id int, z_r double, z_f double, z_m double").repartition(parts)


def labels(df, n):
    got = {r["client_id"]: r["cluster_id"] for r in df.select("client_id", "cluster_id").collect()}
    return np.array([got[i] for i in range(n)])


def test_kmeans_sweep_finds_planted_groups_and_its_cost(spark):
    rng = np.random.default_rng(1)
    truth = np.repeat(np.arange(3), 60)
    points = np.array([[0, 0, 0], [8, 0, 0], [0, 9, 4]])[truth] + rng.normal(0, 0.5, (180, 3))
    got = sweeps.kmeans_sweep(frame(spark, points), [2, 3, 4], 5, 42, AXES)
    costs = [got[k][1] for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    found = labels(got[3][0], 180)
    assert len({(a, b) for a, b in zip(truth, found, strict=True)}) == 3
    for k in (2, 3, 4):  # labels and cost tell of the same, resting centres
        own = labels(got[k][0], 180)
        within = sum(((points[own == g] - points[own == g].mean(0)) ** 2).sum() for g in set(own))
        assert abs(within - got[k][1]) < 1e-6


def test_mixture_sweep_equals_numpy_likelihood(spark):
    rng = np.random.default_rng(2)
    shapes = [np.diag([4.0, 0.05, 0.2]), np.diag([0.1, 3.0, 0.3])]
    truth = np.repeat([0, 1], [150, 100])
    points = np.array([rng.multivariate_normal([0, 0, 0] if t == 0 else [1, 4, 2], shapes[t]) for t in truth])
    labelled, bic = sweeps.mixture_sweep(frame(spark, points), [1, 2], 3, 42, AXES)[2]
    found = labels(labelled, 250)
    assert max((found == truth).mean(), (found != truth).mean()) > 0.97

    def told(shares, mids, covs):
        each = [s * np.exp(-0.5 * np.einsum("ij,jk,ik->i", points - m, np.linalg.inv(c), points - m)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(c)) for s, m, c in zip(shares, mids, covs, strict=True)]
        return np.log(sum(each)).sum()

    # one component: the moments of all points
    alone = sweeps.mixture_sweep(frame(spark, points), [1], 1, 42, AXES)[1][1]
    cov = np.cov(points.T, bias=True) + 1e-6 * np.eye(3)
    assert abs(alone - (-2 * told([1.0], [points.mean(0)], [cov]) + 9 * np.log(250))) < 1e-4
    # two: as likely as the moments of the true groups, or more
    groups = [points[truth == t] for t in (0, 1)]
    true = told([0.6, 0.4], [g.mean(0) for g in groups], [np.cov(g.T, bias=True) for g in groups])
    assert bic <= -2 * true + 19 * np.log(250) + 2 * 250 * sweeps.GAIN


def test_sweeps_of_equal_points_and_of_none(spark):
    same = frame(spark, [(1, 2, 3)] * 5)
    assert sweeps.kmeans_sweep(same, [2], 2, 42, AXES)[2][1] < 1e-12
    assert {r["cluster_id"] for r in sweeps.mixture_sweep(same, [2], 1, 42, AXES)[2][0].collect()} <= {0, 1}
    assert sweeps.kmeans_sweep(same.limit(0), [2], 2, 42, AXES) == {} == sweeps.mixture_sweep(same.limit(0), [2], 2, 42, AXES)


def test_summary_keeps_all_moments_in_few_cells(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(4000, 3)), rng.normal(size=(1000, 3)) * 0.01 + 5, [[40.0, 0, 0]]])
    for most in (1, 50, 1 << 14):
        got = sweeps.summary(frame(spark, x).select(*AXES), AXES, most)
        assert len(got.weights) <= most and got.weights.sum() == len(x)
        assert np.allclose(got.weights @ got.means, x.sum(0)) and np.allclose(got.products.sum(0), x.T @ x)


def test_few_exact_rounds_cost_no_more_than_many(spark, monkeypatch):
    # a summary of few cells, so that exact rounds have work to do; the rounds are counted
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(700, 3)) * s + m for s, m in ((1, 0), (0.4, [4, 1, 0]), (2, [0, 7, 3]), (0.6, [5, 5, 5]))])

    def lloyd(mid):
        for _ in range(500):
            own = ((x[:, None] - mid) ** 2).sum(2).argmin(1)
            mid = np.array([x[own == g].mean(0) if (own == g).any() else mid[g] for g in range(len(mid))])
        return ((x[:, None] - mid) ** 2).sum(2).min(1).sum()

    best = {k: min(lloyd(x[rng.choice(len(x), k, replace=False)]) for _ in range(10)) for k in (2, 4, 6)}
    whole, seen = sweeps._totals, []
    monkeypatch.setattr(sweeps, "CELLS", 400)
    monkeypatch.setattr(sweeps, "_totals", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(sweeps.summary, "__defaults__", (400,))
    got = sweeps.kmeans_sweep(frame(spark, x), [2, 4, 6], 10, 42, AXES)
    assert len(seen) <= sweeps.EXACT
    assert all(got[k][1] <= 1.01 * best[k] for k in best)
