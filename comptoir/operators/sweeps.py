"""K-Means and full-covariance mixtures for many group counts and starts at once.

One pass sums all rows up in the cells of a grid, as fine as a bounded number of cells allows: their
weights, sums and products. On these cells every candidate (k, start) is fitted to its end, each in a task. The best starts of
each k then go through exact rounds over all rows, which begin where they nearly rest: a task sums
the moments of its rows for all candidates, Spark adds the tasks' sums up, and the driver moves the centres,
a few hundred numbers. So a sweep costs a bounded number of Spark jobs at any number of candidates and rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.session import cut

#: Cells of the summary at most, and halvings of the rows' span down to the finest; rounds on the cells at most, of K-Means and of mixtures; exact rounds at most; starts of each k that come to those.
CELLS, FINEST, KMEANS_ROUNDS, MIXTURE_ROUNDS, EXACT, STARTS_KEPT = 1 << 14, 14, 300, 100, 10, 2
#: Rows worth a task; added to a covariance's diagonal; gain of mean log-likelihood that ends a mixture.
ROWS_A_TASK, RIDGE, GAIN = 50_000, 1e-6, 1e-3


@dataclass
class Blobs:
    """One candidate: centres (k, d), and for a mixture covariances (k, d, d) and shares (k)."""

    centres: np.ndarray
    covariances: np.ndarray | None = None
    shares: np.ndarray | None = None


def _points(rows: DataFrame, axes: list[str]) -> tuple[DataFrame, int]:
    n = rows.count()
    return cut(rows.select(*axes).coalesce(max(1, n // ROWS_A_TASK))), n


def _totals(points: DataFrame, axes: list[str], moments: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """moments(rows) -> (groups, width), added up over all rows."""
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                got = moments(pdf[axes].to_numpy(float))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame(total, columns=names).assign(i=np.arange(len(total)))

    sums = points.mapInPandas(run, ", ".join(f"{c} double" for c in names) + ", i long")
    got = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row for each centre of each candidate
    out = np.zeros((int(got["i"].max()) + 1 if len(got) else 0, width))
    out[got["i"].to_numpy()] = got[names].to_numpy()
    return out


@dataclass
class Summary:
    """Cells of rows: how many each has (m), their means (m, d) and sums of products (m, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    products: np.ndarray

    def first_centres(self, k: int, rng: np.random.Generator) -> np.ndarray:
        """k cells' means, each drawn by weight and squared distance to those before."""
        draw = lambda p: self.means[rng.choice(len(p), p=p / p.sum())]
        got = [draw(self.weights)]
        for _ in range(k - 1):
            far = self.weights * np.min([((self.means - c) ** 2).sum(1) for c in got], axis=0)
            got.append(draw(far if far.sum() > 0 else self.weights))
        return np.array(got)

    def lloyd(self, mid: np.ndarray) -> tuple[np.ndarray, float]:
        """Centres at rest, and their cost without what lies within cells."""
        for _ in range(KMEANS_ROUNDS):
            away = ((self.means[:, None] - mid[None]) ** 2).sum(2)
            near = away.argmin(1)
            cost = float((self.weights * away[np.arange(len(near)), near]).sum())
            n = np.bincount(near, self.weights, len(mid))
            sums = np.stack([np.bincount(near, self.weights * c, len(mid)) for c in self.means.T], axis=1)
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], mid)
            if np.abs(moved - mid).max() <= 1e-9:
                break
            mid = moved
        return mid, cost

    def mixture(self, mid: np.ndarray) -> tuple[Blobs, float]:
        """A mixture from the groups of K-Means centres on, and its log-likelihood at the cells' means."""
        n, d = self.weights.sum(), self.means.shape[1]
        flat, blobs, told = self.products.reshape(len(self.weights), -1), Blobs(mid), -np.inf
        shares = np.eye(len(mid))[((self.means[:, None] - mid[None]) ** 2).sum(2).argmin(1)]
        for _ in range(MIXTURE_ROUNDS):
            own = shares * self.weights[:, None]
            blobs = _fitted(np.column_stack([own.sum(0), own.T @ self.means, shares.T @ flat, np.zeros(len(mid))]), blobs, n, d)
            each = _density(self.means, blobs)
            top = each.max(1, keepdims=True)
            level = top[:, 0] + np.log(np.exp(each - top).sum(1))
            before, told = told, float((self.weights * level).sum())
            if abs(told - before) < GAIN * n:
                break
            shares = np.exp(each - level[:, None])
        return blobs, told


def _coarser(cells: np.ndarray, sums: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells halved `by` times less, with the sums of those that become one."""
    cells, at = np.unique(cells >> by, axis=0, return_inverse=True)
    out = np.zeros((len(cells), sums.shape[1]))
    np.add.at(out, at.ravel(), sums)
    return cells, out


def summary(points: DataFrame, axes: list[str], most: int = CELLS) -> Summary:
    """All rows in `most` cells at most: a pass in which each task coarsens its cells to that number, and sums of these; `most` rows reach the driver."""
    d = len(axes)
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    low = np.array([ends[f"low_{c}"] for c in axes], float)
    span = max(max(ends[f"high_{c}"] - ends[f"low_{c}"] for c in axes), 1e-300)
    at, names = [f"c{i}" for i in range(d)], [f"v{i}" for i in range(1 + d + d * d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, cells, sums = FINEST, np.zeros((0, d), np.int64), np.zeros((0, len(names)))
        for pdf in batches:
            x = pdf[axes].to_numpy(float)
            fresh = np.minimum((x - low) / span * (1 << FINEST), (1 << FINEST) - 1).astype(np.int64) >> (FINEST - level)
            own = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])
            cells, sums = _coarser(np.concatenate([cells, fresh]), np.concatenate([sums, own]), 0)
            while len(cells) > most and level:
                level, (cells, sums) = level - 1, _coarser(cells, sums, 1)
        if len(cells):
            yield pd.DataFrame(cells, columns=at).assign(level=level).join(pd.DataFrame(sums, columns=names))

    parts = cut(points.mapInPandas(run, ", ".join([*(f"{c} long" for c in at), "level long", *(f"{c} double" for c in names)])))
    level = parts.agg(F.min("level")).first()[0]
    sizes = parts.select("level", *at, F.explode(F.sequence(F.lit(0), F.lit(level))).alias("to"))
    coarse = [F.call_function("shiftright", c, (F.col("level") - F.col("to")).cast("int")) for c in map(F.col, at)]
    sizes = sizes.groupBy("to").agg(F.countDistinct(*coarse).alias("n"))
    fits = [r["to"] for r in sizes.where(F.col("n") <= most).collect()]  # FINEST + 1 rows at most
    to = max(fits, default=0)
    cells = parts.groupBy(*[F.call_function("shiftright", F.col(c), (F.col("level") - to).cast("int")).alias(c) for c in at]).agg(*[F.sum(c).alias(c) for c in names]).orderBy(*at).toPandas()[names].to_numpy()
    return Summary(cells[:, 0], cells[:, 1 : d + 1] / cells[:, :1], cells[:, d + 1 :].reshape(-1, d, d))


def _fitted_on(points: DataFrame, made: Summary, ks: list[int], starts: int, seed: int, mixture: bool) -> list[Blobs]:
    """The best STARTS_KEPT candidates of each k, fitted on the summary, each candidate in a task."""
    d = made.means.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, s in zip(pdf["k"].tolist(), pdf["s"].tolist(), strict=True):
                mid, value = made.lloyd(made.first_centres(k, np.random.default_rng([seed, k, s])))
                blobs = Blobs(mid, np.zeros((k, d, d)), np.zeros(k))
                if mixture:
                    blobs, told = made.mixture(mid)
                    value = -told
                yield pd.DataFrame({"k": [k], "s": [s], "value": [value], "numbers": [np.concatenate([blobs.centres.ravel(), blobs.covariances.ravel(), blobs.shares])]})

    spark = points.sparkSession
    tried = spark.createDataFrame([(k, s) for k in ks for s in range(starts)], "k int, s int").repartition(min(len(ks) * starts, 4 * spark.sparkContext.defaultParallelism))
    told = tried.mapInPandas(run, "k int, s int, value double, numbers array<double>").collect()  # some hundred numbers of each candidate
    out = []
    for k in ks:
        for r in sorted((r for r in told if r["k"] == k), key=lambda r: (r["value"], r["s"]))[:STARTS_KEPT]:
            x = np.array(r["numbers"])
            out.append(Blobs(x[: k * d].reshape(k, d), *((x[k * d : k * d + k * d * d].reshape(k, d, d), x[-k:]) if mixture else ())))
    return out


def _lloyd(points: DataFrame, axes: list[str], found: list[Blobs], rounds: int = EXACT) -> list[float]:
    """Moves the centres of all candidates until they rest, or for `rounds`; their costs. A centre that loses all its rows stays where it is."""
    d, costs, live = len(axes), [0.0] * len(found), list(range(len(found)))
    for _ in range(rounds):
        centres = [found[c].centres for c in live]

        def moments(x: np.ndarray, centres=centres) -> np.ndarray:
            out, square = [], (x**2).sum(1)
            for mid in centres:
                away = (mid**2).sum(1) - 2 * x @ mid.T
                near = away.argmin(1)
                gap = np.maximum(away[np.arange(len(x)), near] + square, 0)
                columns = [None, *x.T, gap]
                out.append(np.stack([np.bincount(near, w, len(mid)) for w in columns], axis=1))
            return np.concatenate(out)

        total, at, moving = _totals(points, axes, moments, d + 2), 0, []
        for c, mid in zip(live, centres, strict=True):
            own = total[at : at + len(mid)]
            at += len(mid)
            costs[c] = float(own[:, -1].sum())
            moved = np.where(own[:, :1] > 0, own[:, 1:-1] / np.maximum(own[:, :1], 1), mid)
            found[c].centres = moved
            if np.abs(moved - mid).max() > 1e-9:
                moving.append(c)
        live = moving
        if not live:
            break
    return costs


def _density(x: np.ndarray, b: Blobs) -> np.ndarray:
    """Log density of each row in each component, shares included."""
    out = []
    for mid, cov, share in zip(b.centres, b.covariances, b.shares, strict=True):
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, (x - mid).T)
        out.append(np.log(max(share, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * log(2 * pi))
    return np.stack(out, axis=1)


def _weighted(x: np.ndarray, shares: np.ndarray, told: np.ndarray) -> np.ndarray:
    """A row for each component: weight, weighted sums and products, log-likelihood (in the first row)."""
    products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    level = np.zeros(shares.shape[1])
    level[0] = told.sum()
    return np.column_stack([shares.sum(0), shares.T @ x, shares.T @ products, level])


def _soft(x: np.ndarray, b: Blobs) -> np.ndarray:
    each = _density(x, b)
    top = each.max(1, keepdims=True)
    told = top[:, 0] + np.log(np.exp(each - top).sum(1))
    return _weighted(x, np.exp(each - told[:, None]), told)


def _fitted(own: np.ndarray, before: Blobs, n: int, d: int) -> Blobs:
    weight = np.maximum(own[:, 0], 1e-10)
    mid = np.where(own[:, :1] > 1e-10, own[:, 1 : d + 1] / weight[:, None], before.centres)
    cov = own[:, d + 1 : -1].reshape(-1, d, d) / weight[:, None, None] - mid[:, :, None] * mid[:, None, :]
    cov = np.where(own[:, 0, None, None] > 1e-10, cov, 0.0)
    # rounding may leave a flat direction just below 0
    values, axes = np.linalg.eigh((cov + cov.transpose(0, 2, 1)) / 2)
    cov = (axes * (np.maximum(values, 0) + RIDGE)[:, None, :]) @ axes.transpose(0, 2, 1)
    return Blobs(mid, cov, weight / n)


def _expectation(points: DataFrame, axes: list[str], found: list[Blobs], n: int, rounds: int = EXACT) -> list[float]:
    """Fits the mixtures until their mean log-likelihood rests, or for `rounds`; the log-likelihoods."""
    d, told, live = len(axes), [-np.inf] * len(found), list(range(len(found)))
    for i in range(rounds + 1):
        blobs = [found[c] for c in live]

        def moments(x: np.ndarray, blobs=blobs) -> np.ndarray:
            return np.concatenate([_soft(x, b) for b in blobs])

        total, at, moving = _totals(points, axes, moments, d * d + d + 2), 0, []
        for c, b in zip(live, blobs, strict=True):
            own = total[at : at + len(b.centres)]
            at += len(b.centres)
            gain, told[c] = own[:, -1].sum() - told[c], float(own[:, -1].sum())
            if abs(gain) < GAIN * n or i == rounds:  # told is that of the components as they are
                continue
            found[c] = _fitted(own, b, n, d)
            moving.append(c)
        live = moving
        if not live:
            break
    return told


def _nearest(values: list[Column], best: Callable[[Column], Column]) -> Column:
    each = F.array(*values)
    return (F.array_position(each, best(each)) - 1).cast("int")


def _distance(mid: np.ndarray, axes: list[str]) -> Column:
    return sum(F.pow(F.col(c) - F.lit(float(v)), 2) for c, v in zip(axes, mid, strict=True))


def _log_share(b: Blobs, i: int, axes: list[str]) -> Column:
    """What _density says, as a column."""
    inverse, (_, size) = np.linalg.inv(b.covariances[i]), np.linalg.slogdet(b.covariances[i])
    away = [F.col(c) - F.lit(float(v)) for c, v in zip(axes, b.centres[i], strict=True)]
    form = sum(away[p] * away[q] * float(inverse[p, q]) for p in range(len(axes)) for q in range(len(axes)))
    return F.lit(log(max(float(b.shares[i]), 1e-300)) - 0.5 * float(size)) - form / 2


def kmeans_sweep(rows: DataFrame, ks: list[int], starts: int, seed: int, axes: list[str]) -> dict[int, tuple[DataFrame, float]]:
    """For each k the rows with cluster_id of its cheapest start, and the cost. Axes hold finite numbers; without rows there are no candidates."""
    points, n = _points(rows, axes)
    if not n or not ks:
        return {}
    found, out = _fitted_on(points, summary(points, axes), ks, starts, seed, mixture=False), {}
    costs = _lloyd(points, axes, found)
    for k in ks:
        best = min((c for c, b in enumerate(found) if len(b.centres) == k), key=lambda c: costs[c])
        out[k] = rows.withColumn("cluster_id", _nearest([_distance(mid, axes) for mid in found[best].centres], F.array_min)), costs[best]
    return out


def mixture_sweep(rows: DataFrame, ks: list[int], starts: int, seed: int, axes: list[str]) -> dict[int, tuple[DataFrame, float]]:
    """For each k the rows with cluster_id of its likeliest start, and the BIC. Every start begins with the groups of a K-Means fit."""
    points, n = _points(rows, axes)
    if not n or not ks:
        return {}
    d, out = len(axes), {}
    found = _fitted_on(points, summary(points, axes), ks, starts, seed, mixture=True)
    told = _expectation(points, axes, found, n)
    for k in ks:
        best = max((c for c, b in enumerate(found) if len(b.centres) == k), key=lambda c: told[c])
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out[k] = rows.withColumn("cluster_id", _nearest([_log_share(found[best], j, axes) for j in range(k)], F.array_max)), -2 * told[best] + free * log(n)
    return out
