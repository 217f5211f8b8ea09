"""Three forecast models for daily series, each fitted inside its own group.

A group is one (series, model) pair of at most a few thousand days, so that many series and all models
are fitted in parallel; a model that fails gives a row with its message and leaves the others alone.
The models: additive (piecewise linear trend and weekly Fourier terms, ridge-penalised), ARIMA(1,1,1)
by the exact Gaussian likelihood of the differenced series, and boosted regression trees with recursive steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.operators.series import holidays

Z80 = 1.2815515655446004
POINTS = "serie string, modele string, statut string, message string, i int, jour date, valeur double, borne_basse double, borne_haute double, rmse double, mae double, moyenne_validation double"

#: Days ahead up to which boosted trees need no warning.
TREES_DAYS = 14


def split_sizes(n: int) -> tuple[int, int]:
    if n <= S.TEST_MIN:
        return n, 0
    test = min(max(S.TEST_MIN, int(n * S.TEST_SHARE)), n - S.TEST_MIN)
    return n - test, test


def _design(t: np.ndarray, days: np.ndarray, knots: np.ndarray, weekly: bool) -> np.ndarray:
    parts = [np.ones_like(t)[:, None], t[:, None], np.maximum(0.0, t[:, None] - knots[None, :])]
    if weekly:
        angle = 2 * np.pi * days[:, None] * np.arange(1, 4)[None, :] / 7
        parts += [np.sin(angle), np.cos(angle)]
    return np.concatenate(parts, axis=1)


def additive(y: np.ndarray, start: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prediction with 80 % bounds. 25 possible bends on the first four fifths, held small by a ridge; weekly terms from 14 days on."""
    n, scale = len(y), max(np.abs(y).max(), 1e-9)
    t = np.arange(n + horizon) / max(1, n - 1)
    knots = np.linspace(0, 0.8, min(25, max(0, n // 5)) + 2)[1:-1]
    x = _design(t, np.arange(start, start + n + horizon, dtype=float), knots, n >= 14)
    penalty = np.full(x.shape[1], 0.01)
    penalty[:2], penalty[2 : 2 + len(knots)] = 1e-6, 10.0
    past = x[:n]
    beta = np.linalg.solve(past.T @ past + np.diag(penalty), past.T @ (y / scale))
    fit = x @ beta * scale
    sigma = np.std(y - fit[:n])
    half = Z80 * sigma * np.sqrt(1 + np.arange(1, horizon + 1) / n)
    return fit[n:], fit[n:] - half, fit[n:] + half


def _arma_loss(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(concentrated negative log-likelihood, next mean, variance) of ARMA(1,1) models by innovations, for all pairs of phi and theta at once."""
    square = theta * theta
    v = (1 + 2 * phi * theta + square) / (1 - phi * phi)
    total, logs, mean, n = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v), len(w)
    for x in w.tolist():
        e = x - mean
        share = e / v
        total += e * share
        logs += np.log(v)
        mean = phi * x + theta * share
        v = 1 + square - square / v
    sigma2 = np.maximum(total / n, 1e-12)
    return 0.5 * (n * np.log(sigma2) + logs), mean, sigma2


def arima(y: np.ndarray, start: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ARIMA(1,1,1) without constant; a coarse grid, refined three times. 80 % bounds by the psi weights."""
    w = np.diff(y)
    best, at, width = np.inf, (0.0, 0.0), 0.95
    for _ in range(4):
        p, q = (x.ravel() for x in np.meshgrid(*[np.clip(c + width * np.linspace(-1, 1, 7), -0.98, 0.98) for c in at], indexing="ij"))
        loss, means, sigmas = _arma_loss(w, p, q)
        i = int(np.argmin(loss))
        if loss[i] < best:
            best, at, mean, sigma2 = loss[i], (p[i], q[i]), means[i], sigmas[i]
        width /= 3.5
    phi, theta = at
    steps = mean * phi ** np.arange(horizon)
    psi = np.concatenate(([1.0], (phi + theta) * phi ** np.arange(horizon - 1)))
    spread = np.sqrt(sigma2 * np.cumsum(np.cumsum(psi) ** 2))
    value = y[-1] + np.cumsum(steps)
    return value, value - Z80 * spread, value + Z80 * spread


def _tree(x: np.ndarray, g: np.ndarray, depth: int) -> object:
    """A regression tree on binned features: (feature, bin, left, right) or a value."""
    if depth == 0 or len(g) < 4:
        return float(g.sum() / (len(g) + 1.0))
    best = (1e-9, None, None)
    total, n = g.sum(), len(g)
    base = total * total / (n + 1)
    for j in range(x.shape[1]):
        count = np.bincount(x[:, j], minlength=33).cumsum()[:-1]
        part = np.bincount(x[:, j], weights=g, minlength=33).cumsum()[:-1]
        ok = (count > 0) & (count < n)
        gain = np.where(ok, part**2 / (count + 1) + (total - part) ** 2 / (n - count + 1) - base, -1)
        if gain.max() > best[0]:
            best = (gain.max(), j, int(gain.argmax()))
    if best[1] is None:
        return float(total / (n + 1.0))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], g[left], depth - 1), _tree(x[~left], g[~left], depth - 1)


def _apply(tree: object, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, b, low, high = tree
    left, out = x[:, j] <= b, np.empty(len(x))
    out[left], out[~left] = _apply(low, x[left]), _apply(high, x[~left])
    return out


class Boosted:
    """Squared-error boosting over 32 quantile bins of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = S.TREES, depth: int = S.TREE_DEPTH, rate: float = S.TREE_RATE) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        self.rate, self.base, self.trees = rate, float(y.mean()), []
        bins, at = self.bins(x), np.full(len(y), self.base)
        for _ in range(trees):
            tree = _tree(bins, y - at, depth)
            at = at + rate * _apply(tree, bins)
            self.trees.append(tree)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.base + self.rate * sum(_apply(t, bins) for t in self.trees)


def _row(day: pd.Timestamp, past: np.ndarray, closed: set) -> list[float]:
    return [day.dayofweek, day.month, day.dayofweek >= 5, day.date() in closed, past[-1], past[-7], past[-7:].mean()]


def boosted(y: np.ndarray, start: int, horizon: int, model: Boosted | None = None) -> tuple[np.ndarray, None, None]:
    """Trees on calendar and lags, stepping on their own predictions; no bounds."""
    days = pd.Timestamp(0) + pd.to_timedelta(np.arange(start, start + len(y) + horizon), unit="D")
    closed = set(holidays(days[0].year, days[-1].year))
    model = model or Boosted(np.array([_row(days[i], y[:i], closed) for i in range(7, len(y))], float), y[7:])
    past = list(y)
    for i in range(len(y), len(y) + horizon):
        past.append(float(model(np.array([_row(days[i], np.array(past), closed)], float))[0]))
    return np.array(past[len(y) :]), None, None


def _boosted_check(y: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(actual, predicted) on the test part of the days with a week before them; one step ahead, with true lags."""
    days = pd.Timestamp(0) + pd.to_timedelta(np.arange(start, start + len(y)), unit="D")
    closed = set(holidays(days[0].year, days[-1].year))
    x = np.array([_row(days[i], y[:i], closed) for i in range(7, len(y))], float)
    n, test = split_sizes(len(x))
    return y[7 + n :], Boosted(x[:n], y[7 : 7 + n])(x[n:]) if test else np.zeros(0)


MODELS: dict[str, Callable] = {"additif": additive, "arima": arima, "arbres": boosted}


def one_forecast(y: np.ndarray, start: int, model: str, horizon: int, floor: bool) -> pd.DataFrame:
    """Points of one model, with its validation errors; the plain mean if the history is too short. ValueError for an unknown model."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}: one of {sorted(MODELS)}")
    least = S.MIN_HISTORY_TREES if model == "arbres" else S.MIN_HISTORY
    rmse = mae = base = None
    if len(y) < least:
        value, low, high, status = np.full(horizon, y.mean() if len(y) else 0.0), None, None, "moyenne"
    else:
        status = "ok"
        n, test = split_sizes(len(y))
        if test:
            actual, seen = _boosted_check(y, start) if model == "arbres" else (y[n:], MODELS[model](y[:n], start, test)[0])
            seen = np.maximum(seen, 0) if floor else seen
            if len(actual):
                rmse, mae, base = float(np.sqrt(np.mean((actual - seen) ** 2))), float(np.mean(np.abs(actual - seen))), float(actual.mean())
        value, low, high = MODELS[model](y, start, horizon)
    clip = (lambda v: None if v is None else np.maximum(v, 0)) if floor else (lambda v: v)
    days = pd.to_datetime(np.arange(start + len(y), start + len(y) + horizon), unit="D")
    none = np.full(horizon, np.nan)
    return pd.DataFrame({"statut": status, "message": None, "i": np.arange(1, horizon + 1), "jour": days.date, "valeur": clip(value), "borne_basse": none if low is None else clip(low), "borne_haute": none if high is None else clip(high), "rmse": rmse, "mae": mae, "moyenne_validation": base})


def forecasts(series: DataFrame, horizon: int = 30, models: tuple[str, ...] = ("additif", "arima", "arbres"), floor: bool = True) -> DataFrame:
    """Rows POINTS for each series (serie, jour, y) and model. floor: no value below 0 (sales, not cash). A failed model has one row with its message."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}: choose from {sorted(MODELS)}")
    columns = [c.split()[0] for c in POINTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        serie, model = pdf["serie"].iloc[0], pdf["modele"].iloc[0]
        pdf = pdf.sort_values("jour")
        try:
            start = (pd.Timestamp(pdf["jour"].iloc[0]) - pd.Timestamp(0)).days
            out = one_forecast(pdf["y"].to_numpy(float), start, model, horizon, floor)
        except Exception as error:  # one failed model does not hide the others
            out = pd.DataFrame({"statut": ["erreur"], "message": [str(error)[:200]]})
        return out.assign(serie=serie, modele=model).reindex(columns=columns)

    each = series.select("serie", "jour", F.col("y").cast("double").alias("y"), F.explode(F.array(*map(F.lit, models))).alias("modele"))
    return each.groupBy("serie", "modele").applyInPandas(run, POINTS)


def warnings(models: tuple[str, ...], horizon: int) -> list[str]:
    """What to bear in mind: boosted trees feed on their own forecasts, so that their errors add up beyond two weeks."""
    return [f"Arbres : au-delà de {TREES_DAYS} jours, les erreurs se cumulent."] if "arbres" in models and horizon > TREES_DAYS else []


def best_model(points: DataFrame) -> DataFrame:
    """For each series the model of least validation RMSE, the spread of the models' totals and whether they diverge."""
    each = points.where("statut != 'erreur'").groupBy("serie", "modele").agg(F.max("rmse").alias("rmse"), F.sum("valeur").alias("total"))
    got = each.where("rmse IS NOT NULL").groupBy("serie").agg(F.min_by("modele", F.struct("rmse", "modele")).alias("meilleur_modele"), F.min("rmse").alias("rmse"), F.when(F.count("*") > 1, F.try_divide(F.max("total") - F.min("total"), F.avg("total"))).alias("dispersion"))
    return got.withColumn("divergent", F.coalesce(F.col("dispersion") > S.DIVERGENCE, F.lit(False)))


def chart_rows(series: DataFrame, points: DataFrame, days: int = S.HISTORY_DAYS) -> DataFrame:
    """One row a day: the last days as they were, then a column for each model; the last real day starts each line."""
    models = sorted(MODELS)
    last = series.agg(F.max("jour").alias("fin"))
    past = series.crossJoin(F.broadcast(last)).where(F.col("jour") > F.date_sub("fin", days))  # one row
    start = F.when(F.col("jour") == F.col("fin"), F.col("y"))
    past = past.select("jour", F.col("y").alias("reel"), *[start.alias(m) for m in models])
    ahead = points.where("i IS NOT NULL").groupBy("jour").pivot("modele", models).agg(F.first("valeur"))
    return past.unionByName(ahead.select("jour", F.lit(None).cast("double").alias("reel"), *models))
