"""Local-level trends with drift for many series.

Model of one series: ln N[1] ~ N(ln y[1], 4), drift ~ N(0, 1), ln N[t+1] = ln N[t] +
drift + e with e ~ N(0, eps^2), ln y[t] ~ N(ln N[t], sigma^2), eps and sigma uniform on
(0, 2). Given (eps, sigma) all of it is Gaussian, so instead of sampling, the posterior is
a weighted mixture over a grid of (eps, sigma).

The grid is fitted to each series: coarse grids close in on the box that holds the posterior,
then grids of that box are made finer until the results settle. The density is smooth, so Gauss
nodes converge faster than any power of their number, and the change from one grid to the next
bounds the error. A series is one row of one task; Spark spreads the series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.design import SurveyDesign, lookup

# Priors of the trend model.
START_VARIANCE = 4.0
DRIFT_VARIANCE = 1.0
SD_LIMIT = 2.0
# Below this, variances drown in the rounding of the others'.
LEAST_SD = 1e-6

STATISTICS = ("mean", "sd", "lcl", "ucl", "median")
PARAMETERS = ("growth_rate", "process_sd", "observation_sd")


def series_prep(
    corrected: DataFrame, swans: DataFrame, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Both estimate tables as one set of gapless yearly series with log counts.

    A year without a row becomes a row with a NULL count, since the model steps by row. A
    count of zero or less gets a logarithm of minus infinity, which the model reports.
    """
    start = lookup(F.col("species"), dict(design.series_start), design.first_year)
    rows = corrected.unionByName(swans).filter(F.col("year") >= start)
    by_year = Window.partitionBy("species").orderBy("year")
    gap_end = F.greatest(F.lead("year").over(by_year) - 1, F.col("year"))
    filled = rows.withColumn("gap_end", gap_end).select(
        "species",
        F.explode(F.sequence("year", "gap_end")).alias("filled"),
        "year",
        "n",
    )
    n = F.when(F.col("filled") == F.col("year"), F.col("n"))
    log_n = F.when(F.col("n") <= 0, F.lit(float("-inf"))).otherwise(F.ln("n"))
    return filled.select("species", F.col("filled").alias("year"), n.alias("n")).withColumn(
        "log_n", log_n
    )


#: Nodes a side of the grids that find the box, and of those that are compared.
SEARCH_NODES = 10
NODES = (20, 32, 48, 72, 108)
#: Log density below the greatest one at which a node is left out of the box.
NEGLIGIBLE = 23.0
#: The same, by the four nodes around it on the grid before, for nodes that are not looked at.
UNLIKELY = 36.0

QUANTILES = np.array([0.025, 0.5, 0.975])


class _Grid:
    """Gauss nodes of a box in (u, v) with sd = 2 u^3: dense near zero, where short-noise series sit.

    Nodes at which a coarser grid has no density worth mentioning are left out.
    """

    def __init__(self, y: np.ndarray, box: np.ndarray, n: int, coarser: _Grid | None = None):
        self.x, weight = np.polynomial.legendre.leggauss(n)
        self.box, self.n = box, n
        self.u = box.mean(axis=1, keepdims=True) + np.diff(box) / 2 * self.x
        i, j = np.divmod(np.arange(n * n), n)
        if coarser is not None:
            likely = coarser.around(self.u[0][i], self.u[1][j])
            i, j = i[likely], j[likely]
        self.i, self.j, u, v = i, j, self.u[0][i], self.u[1][j]
        eps, sigma = (np.maximum(SD_LIMIT * c**3, LEAST_SD) for c in (u, v))
        log_lik, self.past, self.drift, self.drift_var = _forward(y, eps, sigma)
        self.density = log_lik + 2 * np.log(u) + 2 * np.log(v) + np.log(weight[i] * weight[j])

    def around(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether one of the four nodes around each place is likely."""
        all_of = np.full((self.n, self.n), -np.inf)
        all_of[self.i, self.j] = self.density
        places = [np.searchsorted(axis, c) for axis, c in zip(self.u, (u, v))]
        near = [[np.clip(at + step, 0, self.n - 1) for step in (-1, 0)] for at in places]
        most = np.max([all_of[a, b] for a in near[0] for b in near[1]], axis=0)
        return most > self.density.max() - UNLIKELY


def _forward(y: np.ndarray, eps: np.ndarray, sigma: np.ndarray):
    """Of each node: the log likelihood, the states on the way, and the drift's mean and variance."""
    size = len(eps)
    level, drift = np.full(size, y[0]), np.zeros(size)
    p, q, d = np.full(size, START_VARIANCE), np.zeros(size), np.full(size, DRIFT_VARIANCE)
    log_lik = np.zeros(size)
    past = []
    for value in y:
        seen = not np.isnan(value)
        s = p + sigma**2
        v = value - level if seen else np.zeros(size)
        past.append((level, p, q, v, s))
        if seen:
            log_lik -= 0.5 * (np.log(2 * np.pi * s) + v * v / s)
            level, drift = level + p / s * v, drift + q / s * v
            p, q, d = p * sigma**2 / s, q * sigma**2 / s, d - q * q / s
        level = level + drift
        p, q = p + 2 * q + d + eps**2, q + d
    return log_lik, past, drift, np.maximum(d, 0)


def _backward(y: np.ndarray, past: list) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of ln N at every step, given all of the series, for each node."""
    steps, size = len(y), len(past[0][0])
    mean, var = np.empty((steps, size)), np.empty((steps, size))
    r1, r2 = np.zeros(size), np.zeros(size)
    n11, n12, n22 = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in reversed(range(steps)):
        level, p, q, v, s = past[t]
        if np.isnan(y[t]):
            r1, r2 = r1, r1 + r2
            n11, n12, n22 = n11, n11 + n12, n11 + 2 * n12 + n22
        else:
            k1, k2 = 1 - (p + q) / s, -q / s
            r1, r2 = v / s + k1 * r1 + k2 * r2, r1 + r2
            n11, n12, n22 = (
                1 / s + k1 * k1 * n11 + 2 * k1 * k2 * n12 + k2 * k2 * n22,
                k1 * (n11 + n12) + k2 * (n12 + n22),
                n11 + 2 * n12 + n22,
            )
        mean[t] = level + p * r1 + q * r2
        var[t] = np.maximum(p - (p * p * n11 + 2 * p * q * n12 + q * q * n22), 0)
    return mean, var


def _box(y: np.ndarray) -> tuple[np.ndarray, int]:
    """The part of the grid's square that holds the posterior, and the nodes spent to find it."""
    box, spent = np.array([[0.0, 1.0], [0.0, 1.0]]), 0
    while True:
        grid = _Grid(y, box, SEARCH_NODES)
        spent += len(grid.i)
        held = grid.density > grid.density.max() - NEGLIGIBLE
        new = np.empty((2, 2))
        for axis, at in enumerate((grid.i[held], grid.j[held])):
            borders = np.concatenate([box[axis, :1], grid.u[axis], box[axis, 1:]])
            new[axis] = borders[at.min()], borders[at.max() + 2]  # a node more on each side
        done = np.prod(np.diff(new)) > 0.7 * np.prod(np.diff(box))
        box = new
        if done:
            return box, spent


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    # Rational approximation of the error function, absolute error below 1.5e-7.
    x = np.abs(z) / np.sqrt(2)
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (
        0.254829592
        + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))
    )
    upper = 0.5 * poly * np.exp(-x * x)
    return np.where(z > 0, 1 - upper, upper)


def _mixture_quantiles(w: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Quantiles (steps, 3) of mixtures of normals with weights w, means and variances (steps, nodes):
    halving until close, then Newton steps that stay within the last interval."""
    s = np.sqrt(np.maximum(v, 1e-300))
    low = np.repeat((m - 9 * s).min(axis=1)[:, None], 3, axis=1)
    high = np.repeat((m + 9 * s).max(axis=1)[:, None], 3, axis=1)
    for halving in range(19):
        middle = (low + high) / 2
        if halving >= 14:
            z = (at[:, :, None] - m[:, None]) / s[:, None]
            slope = (np.exp(-z * z / 2) / (s[:, None] * np.sqrt(2 * np.pi))) @ w
            step = at - (_normal_cdf(z) @ w - QUANTILES) / np.maximum(slope, 1e-300)
            at = np.clip(step, low, high)
            continue
        below = _normal_cdf((middle[:, :, None] - m[:, None]) / s[:, None]) @ w < QUANTILES
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        at = (low + high) / 2
    return at


def _marginal(grid: _Grid, axis: int, w: np.ndarray) -> np.ndarray:
    """Mean, sd, limits and median of sd = 2 u^3 from the weights of one side's nodes.

    Between nodes the density is the polynomial through them, whose integral Legendre's polynomials give.
    """
    value = SD_LIMIT * grid.u[axis] ** 3
    mean = w @ value
    fine = np.linspace(-1, 1, 200 * grid.n + 1)
    vander = np.polynomial.legendre.legvander
    shares, at = w @ vander(grid.x, grid.n - 1), vander(fine, grid.n)
    below = shares[0] * (fine + 1) / 2 + (at[:, 2:] - at[:, :-2]) @ shares[1:] / 2
    found = np.interp(QUANTILES, np.maximum.accumulate(below), fine)
    low, high = grid.box[axis]
    lcl, median, ucl = SD_LIMIT * ((low + high) / 2 + (high - low) / 2 * found) ** 3
    return np.array([mean, np.sqrt(w @ (value - mean) ** 2), lcl, ucl, median])


def _results(y: np.ndarray, grid: _Grid) -> tuple[np.ndarray, np.ndarray]:
    """Results on one grid: of N at every step, and of drift, eps and sigma; columns as STATISTICS."""
    w = np.exp(grid.density - grid.density.max())
    w /= w.sum()
    some = w > 1e-13
    part, past = w[some] / w[some].sum(), [tuple(c[some] for c in step) for step in grid.past]
    m, v = _backward(y, past)
    node = np.exp(m + v / 2)
    mean = node @ part
    variance = (node * node * np.expm1(v)) @ part + ((node - mean[:, None]) ** 2) @ part
    lcl, median, ucl = np.exp(_mixture_quantiles(part, m, v)).T
    levels = np.stack([mean, np.sqrt(variance), lcl, ucl, median], axis=1)

    drift, drift_var = grid.drift[some], grid.drift_var[some]
    growth = part @ drift
    spread = np.sqrt(part @ (drift_var + (drift - growth) ** 2))
    low, middle, high = _mixture_quantiles(part, drift[None], drift_var[None])[0]
    sides = [np.bincount(at, w, grid.n) for at in (grid.i, grid.j)]
    sds = [_marginal(grid, axis, side) for axis, side in enumerate(sides)]
    return levels, np.array([[growth, spread, low, high, middle], *sds])


def _fit(y: np.ndarray, settled: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Results of the first grid on which they have settled, their error there, and the nodes spent.
    Parameters may be a hundred times less exact, by their sd.

    The change to the second grid bounds its error. From the third on, changes shrink by a power
    that grows with the nodes, and what the next change would be is taken.
    """
    box, spent = _box(y)
    before = coarser = change = of_before = None
    error = np.inf
    for k, n in enumerate(NODES):
        grid = _Grid(y, box, n, coarser)
        spent += len(grid.i)
        levels, parameters = _results(y, grid)
        if before is not None:
            of_parameters = abs(parameters - of_before) / parameters[:, 1:2]
            last, change = change, max(abs(levels / before - 1).max(), of_parameters.max() / 100, 1e-15)
            error = change
            if last is not None and change < last:
                error = change * (change / last) ** ((n - NODES[k - 1]) / (NODES[k - 1] - NODES[k - 2]))
            if error < settled:
                break
        before, of_before, coarser = levels, parameters, grid
    return levels, parameters, float(error), spent


def _status(times: np.ndarray, y: np.ndarray) -> str:
    if len(set(times)) < len(times):
        return "several values at one time"
    if np.isinf(y).any():
        return "count without a logarithm"
    if np.isnan(y[0]):
        return "first value missing"
    return "ok"


def _per_series(frame_of, settled: float):
    """The per-partition function: one series in, the rows that ``frame_of`` makes of its fit out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                y = np.asarray(row.log_values, dtype=float)
                state = _status(row.times, y)
                none = np.full((len(y), 5), np.nan), np.full((len(PARAMETERS), 5), np.nan), np.nan, 0
                levels, parameters, error, nodes = _fit(y, settled) if state == "ok" else none
                labels, values = frame_of(row.times, levels, parameters)
                out = pd.DataFrame({"series": row.series, **labels})
                for i, name in enumerate(STATISTICS):
                    out[name] = pd.Series(values[:, i]).astype("Float64")
                out["error"] = pd.Series([error] * len(out)).astype("Float64")
                yield out.assign(nodes=nodes, status=state)

    return run


def _spread(series: DataFrame, key: str, time: str, log_value: str, tasks: int | None) -> DataFrame:
    """One row per series: its name, times and values, over a set number of tasks, since the rows are
    small and would otherwise be merged into one."""
    points = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(log_value).alias("v"))))
    arrays = series.groupBy(F.col(key).alias("series")).agg(points.alias("points"))
    work = arrays.select(
        "series",
        F.col("points.t").alias("times"),
        F.transform("points.v", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("log_values"),
    )
    return work.repartition(tasks or series.sparkSession.sparkContext.defaultParallelism, "series")


_RESULTS = ", ".join(f"{name} double" for name in STATISTICS) + ", error double, nodes int, status string"


def local_level_trend(
    series: DataFrame,
    key: str = "species",
    time: str = "year",
    log_value: str = "log_n",
    settled: float = 1e-8,
    tasks: int | None = None,
) -> DataFrame:
    """Posterior mean, sd, median and 95% limits of the level at every step of each series.

    ``series`` has one row per (key, time), NULL where nothing was counted. A series is as
    long as the survey has periods, so its array is short whatever the size of the counts, and
    one row holds all that its posterior needs. ``status`` is ``ok`` or says why a series has no
    estimates; other series are not touched by that. ``error`` is the relative error of the
    statistics that the grid leaves, below ``settled`` unless the finest grid was not fine enough;
    ``nodes`` were looked at in all.
    """
    kind = {c: series.schema[c].dataType.simpleString() for c in (key, time)}
    run = _per_series(lambda times, levels, parameters: ({"time": times}, levels), settled)
    out = _spread(series, key, time, log_value, tasks).mapInPandas(
        run, f"series {kind[key]}, time {kind[time]}, {_RESULTS}"
    )
    return out.withColumnsRenamed({"series": key, "time": time})


def trend_parameters(
    series: DataFrame,
    key: str = "species",
    time: str = "year",
    log_value: str = "log_n",
    settled: float = 1e-8,
    tasks: int | None = None,
) -> DataFrame:
    """Posterior mean, sd, median and 95% limits of each series' parameters: the mean growth rate of ln N,
    the sd of its yearly changes and the sd of observations. Columns as in ``local_level_trend``.
    """
    kind = series.schema[key].dataType.simpleString()
    run = _per_series(lambda times, levels, parameters: ({"parameter": list(PARAMETERS)}, parameters), settled)
    out = _spread(series, key, time, log_value, tasks).mapInPandas(run, f"series {kind}, parameter string, {_RESULTS}")
    return out.withColumnRenamed("series", key)


def trend_with_survey(
    trend: DataFrame, survey: DataFrame, keys: tuple[str, ...] = ("species", "year")
) -> DataFrame:
    """The trend with the survey estimate beside it, NULL in a year without a survey."""
    return trend.join(survey.select(*keys, "n"), list(keys), "left")
