"""Curve fits, bootstraps and closed forms; numpy on the rows of one group at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(x: np.ndarray) -> float:
    return np.add.reduce(x) / len(x)


def _nonneg_line(basis: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """a, b >= 0 and the squared error of y = a + b basis."""
    middle, level = _mean(basis), _mean(y)
    best = (max(0.0, level), 0.0)
    centred = basis - middle
    spread = centred @ centred
    if spread > 0:
        b = (centred @ y) / spread
        a = level - b * middle
        if b >= 0 and a >= 0:
            best = (a, b)
        elif b >= 0:
            best = (0.0, max(0.0, (basis @ y) / (basis @ basis)))
    return *best, float(((y - best[0] - best[1] * basis) ** 2).sum())


def _nonneg_errors(bases: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared error of the best a, b >= 0 for each row of bases."""
    mean, centred = bases.mean(axis=1), bases - bases.mean(axis=1, keepdims=True)
    spread, size = (centred**2).sum(axis=1), (bases**2).sum(axis=1)
    slope = np.divide(centred @ y, spread, out=np.zeros(len(bases)), where=spread > 0)
    through = np.maximum(0.0, np.divide(bases @ y, size, out=np.zeros(len(bases)), where=size > 0))
    floor = y.mean() - slope * mean
    b = np.where(floor >= 0, np.maximum(slope, 0.0), np.where(slope >= 0, through, 0.0))
    a = np.where((floor >= 0) & (slope >= 0), floor, np.where(slope >= 0, 0.0, max(0.0, y.mean())))
    return ((y - a[:, None] - b[:, None] * bases) ** 2).sum(axis=1)


def _golden(loss, a: float, b: float, rounds: int) -> float:
    """The minimiser of loss between a and b by golden section, one look a round."""
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    at_c, at_d = loss(c), loss(d)
    for _ in range(rounds):
        if at_c < at_d:
            b, d, at_d = d, c, at_c
            c = b - ratio * (b - a)
            at_c = loss(c)
        else:
            a, c, at_c = c, d, at_d
            d = a + ratio * (b - a)
            at_d = loss(d)
    return (a + b) / 2


def _best_rate(bases, y: np.ndarray, lo: float, hi: float, steps: int, rounds: int) -> float:
    """The rate with the least squared error, bases(rates) giving a row for each: a log grid, then golden section between its neighbours."""
    grid = np.exp(np.linspace(math.log(lo), math.log(hi), steps))
    i = int(np.argmin(_nonneg_errors(bases(grid), y)))
    loss = lambda rate: _nonneg_line(bases(np.array([rate]))[0], y)[2]
    found = _golden(loss, grid[max(0, i - 1)], grid[min(steps - 1, i + 1)], rounds)
    return min((found, float(grid[i])), key=loss)


def _errors(names: Sequence[str], values: Sequence[float], bounds: Sequence[tuple[float, float]], slopes: np.ndarray, sse: float) -> dict[str, float]:
    """Standard errors of the parameters from the slopes of the curve in each (a column a parameter) where it fits best.

    A parameter at one of its bounds has none and counts as fixed for the others; nor has any without more points than free parameters, or
    where the points can't tell the free ones apart.
    """
    inside = lambda v, lo, hi: v - lo > 1e-6 * max(abs(lo), 1e-3) and hi - v > 1e-6 * abs(v)
    free = [j for j, v in enumerate(values) if inside(v, *bounds[j])]
    found = dict.fromkeys((f"{n}_se" for n in names), float("nan"))
    spare, jacobian = len(slopes) - len(free), slopes[:, free]
    scale = np.sqrt((jacobian**2).sum(axis=0))
    if free and spare > 0 and (scale > 0).all() and np.linalg.matrix_rank(jacobian / scale, tol=1e-9) == len(free):
        scaled = jacobian / scale
        covariance = np.linalg.inv(scaled.T @ scaled) / np.outer(scale, scale) * sse / spare
        for j, v in zip(free, np.diag(covariance), strict=True):
            found[f"{names[j]}_se"] = math.sqrt(v)
    return found


#: Slots of a curve beyond which the middles of a sigmoid are compared by running sums first; middles looked at one by one then, the first ones always.
LONG, FIRST_MIDDLES, BEST_MIDDLES = 100, 34, 32


def _likely_middles(y: np.ndarray, grid: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Places in the grid, ascending, among which the best middle of a long curve (slots from 1) is: the first ones, and those with the least errors.

    The grid goes by half a slot, so all curves of a rate are windows of two tables of values, and the sums that make an error are running
    sums and one convolution: n log n for a rate instead of n for each rate and middle. Windows of the first middles hold
    small values only, which a convolution can't see; they are always among the places.
    """
    n, total = len(y), float(((y - y.mean()) ** 2).sum())
    errors = np.full(len(grid), np.inf)
    for rate in rates:
        for half in (0, 1):
            middles = grid[half::2]
            d = np.arange(n + len(middles) - 1) + (1 - middles[-1])
            v = 1 / (1 + np.exp(np.clip(rate * d, -500, 500)))
            window = lambda x: (t := np.r_[np.cumsum(x[::-1])[::-1], 0.0])[: len(x) - n + 1] - t[n:]
            size = 1 << (len(v) + n).bit_length()
            inner = np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(y[::-1], size), size)[n - 1 : len(v)]
            sums, squares = window(v), window(v * v)
            mean = sums / n
            spread = squares - n * mean * mean
            cross = inner - y.mean() * sums
            slope = np.divide(cross, spread, out=np.zeros(len(v) - n + 1), where=spread > 1e-9 * n)
            through = (y @ y) - np.divide(np.maximum(inner, 0) ** 2, squares, out=np.zeros(len(squares)), where=squares > 0)
            found = np.where(slope < 0, total, np.where(y.mean() - slope * mean >= 0, total - slope * cross, through))
            errors[half::2] = np.minimum(errors[half::2], found[::-1])
    best = np.argsort(errors[FIRST_MIDDLES:], kind="stable")[:BEST_MIDDLES] + FIRST_MIDDLES
    return np.r_[np.arange(FIRST_MIDDLES), np.sort(best)]


#: Bounds of the rates of both curves, and where a sigmoid's middle may lie (upper bound: times the number of slots).
EXPONENTIAL_RATES, SIGMOID_RATES, MIDDLES = (0.001, 50.0), (0.01, 50.0), (-10.0, 3)


def exponential_fit(k: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """a_inf + alpha exp(-beta (k - 1)), a_inf and alpha >= 0, beta in [0.001, 50]: for each beta the rest is linear. With standard errors."""
    shape = lambda beta: np.exp(-np.outer(beta, k - 1))
    beta = _best_rate(shape, y, *EXPONENTIAL_RATES, 200, 80)
    basis = shape(np.array([beta]))[0]
    a_inf, alpha, sse = _nonneg_line(basis, y)
    slopes = np.column_stack([np.ones(len(k)), basis, -alpha * (k - 1) * basis])
    errors = _errors(("a_inf", "alpha", "beta"), (a_inf, alpha, beta), ((0.0, math.inf), (0.0, math.inf), EXPONENTIAL_RATES), slopes, sse)
    return _summary({"a_inf": a_inf, "alpha": alpha, "beta": beta, "e_fit": alpha / beta}, y, sse) | errors


def sigmoid_fit(k: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """a_inf + alpha / (1 + exp(beta (k - k0))); e_fit is the area above a_inf from 1 on, (alpha / beta) ln(1 + exp(-beta (1 - k0))).

    a_inf and alpha >= 0, beta in [0.01, 50], k0 from -10 to three times the number of slots. For each k0 the best beta is looked for, for
    each beta the rest is linear; k0 comes from a grid of at most half a slot and is refined by golden section. Of curves longer than LONG the
    grid's errors are compared by running sums, the least again one by one. With standard errors.
    """
    low, high = MIDDLES[0], float(MIDDLES[1] * len(k))
    shape = lambda k0: lambda beta: 1 / (1 + np.exp(np.minimum(np.maximum(beta[:, None] * (k - k0), -500), 500)))
    rates = np.exp(np.linspace(*np.log(SIGMOID_RATES), 60))
    grid = np.linspace(low, high, 2 * math.ceil(high - low) + 1)
    likely = _likely_middles(y, grid, rates) if len(k) > LONG and (k == np.arange(1, len(k) + 1)).all() else np.arange(len(grid))
    i = int(likely[np.argmin([_nonneg_errors(shape(grid[j])(rates), y).min() for j in likely])])
    best = lambda k0: _best_rate(shape(k0), y, *SIGMOID_RATES, 60, 40)
    loss = lambda k0: _nonneg_line(shape(k0)(np.array([best(k0)]))[0], y)[2]
    k0 = _golden(loss, grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 40)
    k0 = min((k0, float(grid[i])), key=loss)
    beta = best(k0)
    basis = shape(k0)(np.array([beta]))[0]
    a_inf, alpha, sse = _nonneg_line(basis, y)
    area = alpha / beta * float(np.logaddexp(0, -beta * (1 - k0)))
    steep = alpha * basis * (1 - basis)
    slopes = np.column_stack([np.ones(len(k)), basis, -steep * (k - k0), steep * beta])
    bounds = ((0.0, math.inf), (0.0, math.inf), SIGMOID_RATES, (low, high))
    errors = _errors(("a_inf", "alpha", "beta", "k0"), (a_inf, alpha, beta, k0), bounds, slopes, sse)
    return _summary({"a_inf": a_inf, "alpha": alpha, "beta": beta, "k0": float(k0), "e_fit": area}, y, sse) | errors


def _summary(values: dict[str, float], y: np.ndarray, sse: float) -> dict[str, float]:
    total = float(((y - y.mean()) ** 2).sum())
    return values | {"rmse": math.sqrt(sse / len(y)), "r2": 1 - sse / total if total > 0 else float("nan")}


def fit_curves(curves: DataFrame, keys: Sequence[str], value: str, kind: str = "exponential", least: int = 3) -> DataFrame:
    """keys and the fit of each curve (k, value) with at least `least` points: parameters, e_fit, rmse, r2 and the parameters' standard errors
    (null for those at a bound, and without points to spare); a curve is one row's array, not a group in a worker. Curves are few bytes and much
    work, so they are dealt out to as many tasks as the session has shuffle partitions."""
    fit, parameters = {"exponential": (exponential_fit, ["a_inf", "alpha", "beta"]), "sigmoid": (sigmoid_fit, ["a_inf", "alpha", "beta", "k0"])}[kind]
    names = [*parameters, "e_fit", "rmse", "r2", *(f"{n}_se" for n in parameters)]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(curve: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit(np.arange(1.0, len(y) + 1), np.asarray(y, dtype=float)) for y in curve], columns=names)

    rows = curves.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("curve"))
    tasks = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where(F.size("curve") >= least).repartition(tasks, F.xxhash64("curve"))
    return dealt.select(*keys, run("curve").alias("fit")).select(*keys, "fit.*")


def seen_before(counts: DataFrame, keys: Sequence[str], count: str, slots: int) -> DataFrame:
    """keys, k, p: chance that the k-th draw (from 0) without replacement repeats a category drawn before.

    p = 1 - sum over categories of (c / N) C(N - c, k) / C(N - 1, k), with the ratio as a running product.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("N"))
    rows = counts.join(totals, keys).select(*keys, F.col(count).alias("c"), "N", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(slots).cast("long"), F.col("N")) - 1)).alias("k"))
    fresh = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("k")),
        F.lit(1.0),
        lambda p, i: F.when(i < F.col("k"), p * F.greatest(F.lit(0.0), (F.col("N") - F.col("c") - i) / (F.col("N") - 1 - i))).otherwise(p),
    )
    return rows.groupBy(*keys, "k").agg((1 - F.sum(F.col("c") / F.col("N") * fresh)).alias("p"))


def additive_curve(first: Column, drop_same: Column, repeat_chance: Column) -> Column:
    """Predicted curve: each slot costs the first slot's bits less the drop times the chance that its mode was seen."""
    return F.transform(repeat_chance, lambda p: F.greatest(first - drop_same * p, F.lit(0.0)))


def fractional_curve(first: Column, share: Column, repeat_chance: Column) -> Column:
    """Predicted curve by recurrence: each slot keeps 1 - share * p of the slot before."""
    return F.aggregate(
        repeat_chance,
        F.array().cast("array<double>"),
        lambda acc, p: F.array_append(acc, F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), first) * (1 - share * p)),
    )
