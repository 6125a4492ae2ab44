"""Student-t location, correlation and regression by maximum likelihood.

Each iteration is one distributed aggregate over the pairs of all groups that have not settled; the
driver holds a few sums a group and nothing else. Location and the shape of the scatter move by
expectation-maximisation, the overall scale and the degrees of freedom, which hang together, by a
joint Newton step. Standard errors and limits come from the observed information: one more aggregate
of moments up to the fourth order, weighted as the likelihood's second derivatives are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NU_RANGE = (1.0, 200.0)


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift -= 1 / x
        x += 1
    i = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _trigamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return shift + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))


def _scale_and_nu_step(
    v: float, dims: int, m: dict, fixed_nu: bool, nu_range: tuple[float, float]
) -> tuple[float, float]:
    """Newton step in (log scale, log nu) from the likelihood's sums at the current state;
    where it is not concave, or nu is held or at the end of its range, each coordinate moves on
    its own."""
    n, pull, bend, up = m["n"], m["pull"], m["bend"], (v + dims) / 2
    g_s = -n * dims + 2 * up * pull
    h_ss = -4 * up * v * bend
    first = (
        n / 2 * (_digamma(up) - _digamma(v / 2) - dims / v) - m["log_tail"] / 2 + up * pull / v
    )
    second = (
        n / 4 * (_trigamma(up) - _trigamma(v / 2) + 2 * dims / v**2)
        + pull / v
        - up * (pull + v * bend) / v**2
    )
    g_v, h_vv = v * first, v * v * second + v * first
    h_sv = v * (pull - 2 * up * bend)
    det = h_ss * h_vv - h_sv**2
    at_edge = (v >= nu_range[1] and g_v > 0) or (v <= nu_range[0] and g_v < 0)
    if fixed_nu or at_edge:
        step = -g_s / h_ss, 0.0
    elif det > 0 and h_vv < 0:
        step = -(h_vv * g_s - h_sv * g_v) / det, -(h_ss * g_v - h_sv * g_s) / det
    else:
        step = -g_s / h_ss, math.copysign(0.7, g_v)
    return tuple(max(-1.0, min(1.0, d)) for d in step)


# One aggregate per iteration: the squared distance d of a pair from its group's current centre or line,
# nu the degrees of freedom, and the group's other parameters are columns.
_SUMS = {
    "n": "count(1)",
    "w": "sum({w})",
    "wx": "sum({w} * x)",
    "wy": "sum({w} * y)",
    "wxx": "sum({w} * x * x)",
    "wxy": "sum({w} * x * y)",
    "wyy": "sum({w} * y * y)",
    "log_tail": "sum(log1p(d / nu))",
    "pull": "sum(d / (d + nu))",
    "bend": "sum(d / (d + nu) / (d + nu))",
}
# Powers of x and y in a squared distance.
_POWERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))
#: Groups that the driver will hold the sums of.
MOST_GROUPS = 100_000
#: Of a standard normal, the share of 0.975.
_WIDE = 1.959963984540054


@dataclass(frozen=True)
class _Model:
    """A fit in standardised pairs. ``free`` turns a state into unbounded parameters, without nu, and
    ``state`` back; ``square`` is the coefficients of _POWERS in the squared distance, ``log_det`` the
    logarithm of the scatter's determinant."""

    dims: int
    start: dict[str, float]
    update: Callable[[dict, dict, float], dict]
    free: Callable[[dict], list[float]]
    state: Callable[[Sequence[float]], dict]
    square: Callable[[dict], list[float]]
    log_det: Callable[[dict], float]


def _with_state(pairs: DataFrame, states: dict[int, dict], model: _Model) -> DataFrame:
    """Pairs of the groups that have a state, with nu and the squared distance d."""
    names = [f"c{i}{j}" for i, j in _POWERS]
    rows = [(g, float(p["nu"]), *map(float, model.square(p))) for g, p in states.items()]
    kinds = ", ".join(f"{c} double" for c in ("nu", *names))
    joined = pairs.join(pairs.sparkSession.createDataFrame(rows, f"g int, {kinds}"), "g")
    distance = " + ".join(c + " * x" * i + " * y" * j for c, (i, j) in zip(names, _POWERS))
    return joined.selectExpr("g", "x", "y", "nu", f"greatest({distance}, 0D) AS d")


def _iterate(
    pairs: DataFrame,
    groups: Sequence[int],
    model: _Model,
    nu: float | None,
    tol: float,
    max_iter: int,
    nu_range: tuple[float, float],
) -> dict[int, dict]:
    """The state of each group when it has settled, or after ``max_iter`` steps."""
    first = float(nu) if nu else min(max(10.0, nu_range[0]), nu_range[1])
    states = {g: {**model.start, "nu": first, "converged": False, "n_iter": 0} for g in groups}
    going = list(groups)
    for step in range(1, max_iter + 1):
        if not going:
            break
        spaced = _with_state(pairs, {g: states[g] for g in going}, model)
        w = f"((nu + {model.dims}) / (d + nu))"
        sums = [F.expr(e.format(w=w)).alias(k) for k, e in _SUMS.items()]
        for m in map(lambda r: r.asDict(), spaced.groupBy("g").agg(*sums).collect()):
            old = states[m["g"]]
            d_scale, d_nu = _scale_and_nu_step(old["nu"], model.dims, m, nu is not None, nu_range)
            new = model.update(old, m, math.exp(2 * d_scale))
            v = old["nu"]
            new["nu"] = max(nu_range[0], min(nu_range[1], v * math.exp(d_nu))) if nu is None else v
            moved = max(abs(new[k] - old[k]) / (abs(old[k]) + 1.0) for k in new)
            states[m["g"]] = {**new, "converged": moved < tol, "n_iter": step}
        going = [g for g in going if not states[g]["converged"]]
    for p in states.values():
        p["nu_at_bound"] = nu is None and not nu_range[0] < p["nu"] < nu_range[1]
    return states


def _derivatives(f: Callable[[list[float]], np.ndarray], at: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a smooth function of few parameters, by central differences."""
    k, h = len(at), 1e-4
    steps = np.eye(k) * h
    here = np.array(at)
    first = np.array([(f(here + e) - f(here - e)) / (2 * h) for e in steps])
    second = np.array(
        [[(f(here + a + b) - f(here + a - b) - f(here - a + b) + f(here - a - b)) / (4 * h * h) for b in steps] for a in steps]
    )
    return first, second


def _covariances(pairs: DataFrame, states: dict[int, dict], model: _Model, nu: float | None) -> dict[int, np.ndarray]:
    """Of each group, the inverse of the observed information in (free parameters, log nu): NaN where it
    is not positive; nothing for nu where it is held or at its bound."""
    moments = {f"a{i}{j}": f"sum(s" + " * x" * i + " * y" * j + ")" for i, j in _POWERS}
    fourth = sorted({(a + c, b + d) for a, b in _POWERS for c, d in _POWERS})
    moments |= {f"b{i}{j}": f"sum(s * s" + " * x" * i + " * y" * j + ")" for i, j in fourth}
    spaced = _with_state(pairs, states, model).selectExpr("g", "x", "y", "1 / (nu + d) AS s")
    sums = [F.count(F.lit(1)).alias("n"), *[F.expr(e).alias(k) for k, e in moments.items()]]
    out = {}
    for m in spaced.groupBy("g").agg(*sums).collect():
        p = states[m["g"]]
        v, n, dims = p["nu"], m["n"], model.dims
        at = model.free(p)
        c1, c2 = _derivatives(lambda t: np.array(model.square(model.state(t))), at)
        _, log_det = _derivatives(lambda t: np.array(model.log_det(model.state(t))), at)
        one = np.array([m[f"a{i}{j}"] for i, j in _POWERS])
        two = np.array([m[f"b{i}{j}"] for i, j in _POWERS])
        square = np.array([[m[f"b{a + c}{b + d}"] for c, d in _POWERS] for a, b in _POWERS])
        k = len(at)
        bent = np.zeros((k + 1, k + 1))
        bent[:k, :k] = -n / 2 * log_det - (v + dims) / 2 * (c2 @ one) + (v + dims) / 2 * (c1 @ square @ c1.T)
        bent[k, :k] = bent[:k, k] = -v / 2 * (c1 @ (one - (v + dims) * two))
        second = n / 4 * (_trigamma((v + dims) / 2) - _trigamma(v / 2)) + n * dims / (2 * v * v)
        second += (n - v * one[0]) / v - (v + dims) / 2 * (n - v * v * two[0]) / (v * v)
        bent[k, k] = v * v * second  # the first derivative is zero at the fit
        held = nu is not None or p["nu_at_bound"]
        info = -bent[:k, :k] if held else -bent
        full = np.full((k + 1, k + 1), np.nan)
        if np.isfinite(info).all() and np.linalg.eigvalsh(info)[0] > 0:
            full[: len(info), : len(info)] = np.linalg.inv(info)
        out[m["g"]] = full
    return out


@contextmanager
def _standardized(df: DataFrame, x: str, y: str, by: Sequence[str]) -> Iterator[tuple[DataFrame, dict[int, dict]]]:
    """Pairs (g, x, y) centred and scaled by group, cached across iterations, and of each group its values
    of ``by`` and the moments that undo it. What the pairs come from is computed once, for moments and
    scaling. A cached block lost with its executor is computed again
    from its source."""
    pairs = df.dropna(subset=[x, y]).select(
        *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)],
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    keys = [f"by{i}" for i in range(len(by))]
    moments = {"n": F.count(F.lit(1)), "mx": F.avg("x"), "my": F.avg("y"), "sx": F.stddev_samp("x"), "sy": F.stddev_samp("y")}
    try:
        found = pairs.groupBy(*keys).agg(*[f.alias(k) for k, f in moments.items()]).limit(MOST_GROUPS + 1).collect()
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        groups = {g: row.asDict() for g, row in enumerate(found)}
        usable = [(g, *[p[c] for c in (*keys, "mx", "my", "sx", "sy")]) for g, p in groups.items() if p["sx"] and p["sy"]]
        if not by and not usable:
            raise ValueError("needs at least two pairs and some spread in both columns")
        kinds = [f"k{i} {pairs.schema[c].dataType.simpleString()}" for i, c in enumerate(keys)]
        schema = ", ".join(["g int", *kinds, *[f"{c} double" for c in ("mx", "my", "sx", "sy")]])
        table = df.sparkSession.createDataFrame(usable, schema)
        same = F.lit(True)
        for i, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"k{i}"))
        joined = pairs.join(table, same) if keys else pairs.withColumns(
            {"g": F.lit(0), **{c: F.lit(v) for c, v in zip(("mx", "my", "sx", "sy"), usable[0][1:])}}
        )
        scaled = joined.selectExpr("g", "(x - mx) / sx AS x", "(y - my) / sy AS y").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield scaled, groups
        finally:
            scaled.unpersist()
    finally:
        pairs.unpersist()


def _fitted(
    df: DataFrame, x: str, y: str, by: Sequence[str], model: _Model, options: tuple, describe: Callable
) -> DataFrame:
    """A row per group: its values of ``by``, what ``describe`` says of each parameter (estimate, standard
    error, limits), and how the fit went."""
    nu, tol, max_iter, nu_range = options
    with _standardized(df, x, y, by) as (pairs, groups):
        usable = [g for g, s in groups.items() if s["sx"] and s["sy"]]
        states = _iterate(pairs, usable, model, nu, tol, max_iter, nu_range)
        spread = _covariances(pairs, states, model, nu) if states else {}
    names = list(describe({"sx": 1.0, "sy": 1.0, "mx": 0.0, "my": 0.0}, {**model.start, "nu": 1.0}, np.eye(9)))
    rows = []
    for g, s in groups.items():
        own = [s[f"by{i}"] for i in range(len(by))]
        if g not in states:
            rows.append((*own, *[None] * (4 * len(names)), s["n"], 0, False, False))
            continue
        p = states[g]
        told = describe(s, p, spread[g])
        numbers = [None if math.isnan(v) else float(v) for four in told.values() for v in four]
        rows.append((*own, *numbers, s["n"], p["n_iter"], p["converged"], p["nu_at_bound"]))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    kinds += [f"{name}{end} double" for name in names for end in ("", "_se", "_lcl", "_ucl")]
    schema = ", ".join([*kinds, "n_pairs long, n_iter int, converged boolean, nu_at_bound boolean"])
    return df.sparkSession.createDataFrame(rows, schema)


def _plain(estimate: float, variance: float) -> tuple[float, ...]:
    se = math.sqrt(variance) if variance >= 0 else math.nan
    return estimate, se, estimate - _WIDE * se, estimate + _WIDE * se


def _on_log(estimate: float, variance: float) -> tuple[float, ...]:
    se = math.sqrt(variance) if variance >= 0 else math.nan
    return estimate, estimate * se, estimate * math.exp(-_WIDE * se), estimate * math.exp(_WIDE * se)


def _scatter(t: Sequence[float]) -> dict:
    sx, sy, r = math.exp(t[2]), math.exp(t[3]), math.tanh(t[4])
    return {"mx": t[0], "my": t[1], "sxx": sx * sx, "sxy": r * sx * sy, "syy": sy * sy}


def robust_bivariate(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    nu: float | None = None,
    tol: float = 1e-6,
    max_iter: int = 100,
    nu_range: tuple[float, float] = NU_RANGE,
) -> DataFrame:
    """Bivariate Student-t: centre, scales, correlation and degrees of freedom, one row per ``by``.

    Each comes with its standard error and 95% limits (``_se``, ``_lcl``, ``_ucl``) by the observed
    information, those of scales and degrees of freedom on the log scale, of the correlation by Fisher's
    transformation; null where the information is not positive, and for degrees of freedom that are
    given or at a bound. ``converged`` tells whether the fit settled within ``max_iter`` steps,
    ``nu_at_bound`` whether the degrees of freedom ended at a bound of ``nu_range``. A group without
    two pairs or without spread has nulls; without ``by`` that is an error.
    """

    def update(p: dict, m: dict, scale2: float) -> dict:
        mx, my = m["wx"] / m["w"], m["wy"] / m["w"]
        sxx = m["wxx"] / m["w"] - mx * mx
        sxy = m["wxy"] / m["w"] - mx * my
        syy = m["wyy"] / m["w"] - my * my
        size = math.sqrt((p["sxx"] * p["syy"] - p["sxy"] ** 2) / (sxx * syy - sxy**2)) * scale2
        return {"mx": mx, "my": my, "sxx": sxx * size, "sxy": sxy * size, "syy": syy * size}

    def square(p: dict) -> list[float]:
        det = p["sxx"] * p["syy"] - p["sxy"] ** 2
        xx, xy, yy = p["syy"] / det, -p["sxy"] / det, p["sxx"] / det
        mx, my = p["mx"], p["my"]
        return [
            xx * mx * mx + 2 * xy * mx * my + yy * my * my,
            -2 * (xx * mx + xy * my),
            -2 * (xy * mx + yy * my),
            xx,
            2 * xy,
            yy,
        ]

    def free(p: dict) -> list[float]:
        r = p["sxy"] / math.sqrt(p["sxx"] * p["syy"])
        return [p["mx"], p["my"], math.log(p["sxx"]) / 2, math.log(p["syy"]) / 2, math.atanh(r)]

    def describe(s: dict, p: dict, cov: np.ndarray) -> dict[str, tuple[float, ...]]:
        r = p["sxy"] / math.sqrt(p["sxx"] * p["syy"])
        se = math.sqrt(cov[4, 4]) if cov[4, 4] >= 0 else math.nan
        return {
            "mu_x": _plain(s["mx"] + p["mx"] * s["sx"], cov[0, 0] * s["sx"] ** 2),
            "mu_y": _plain(s["my"] + p["my"] * s["sy"], cov[1, 1] * s["sy"] ** 2),
            "sigma_x": _on_log(math.sqrt(p["sxx"]) * s["sx"], cov[2, 2]),
            "sigma_y": _on_log(math.sqrt(p["syy"]) * s["sy"], cov[3, 3]),
            "rescor": (r, (1 - r * r) * se, *(math.tanh(math.atanh(r) + k * _WIDE * se) for k in (-1, 1))),
            "nu": _on_log(p["nu"], cov[5, 5]),
        }

    start = {"mx": 0.0, "my": 0.0, "sxx": 1.0, "sxy": 0.0, "syy": 1.0}
    model = _Model(2, start, update, free, _scatter, square, lambda p: math.log(p["sxx"] * p["syy"] - p["sxy"] ** 2))
    return _fitted(df, x, y, by, model, (nu, tol, max_iter, nu_range), describe)


def robust_regression(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    nu: float | None = None,
    tol: float = 1e-6,
    max_iter: int = 100,
    nu_range: tuple[float, float] = NU_RANGE,
) -> DataFrame:
    """Straight line of ``y`` on ``x`` with Student-t errors, one row per ``by``; else as
    ``robust_bivariate``.
    """

    def update(p: dict, m: dict, scale2: float) -> dict:
        cxy = m["wxy"] - m["wx"] * m["wy"] / m["w"]
        cxx = m["wxx"] - m["wx"] ** 2 / m["w"]
        slope = cxy / cxx
        return {
            "slope": slope,
            "intercept": (m["wy"] - slope * m["wx"]) / m["w"],
            "s2": p["s2"] * scale2,
        }

    def square(p: dict) -> list[float]:
        a, b = p["intercept"], p["slope"]
        return [c / p["s2"] for c in (a * a, 2 * a * b, -2 * a, b * b, -2 * b, 1.0)]

    def free(p: dict) -> list[float]:
        return [p["intercept"], p["slope"], math.log(p["s2"]) / 2]

    def state(t: Sequence[float]) -> dict:
        return {"intercept": t[0], "slope": t[1], "s2": math.exp(2 * t[2])}

    def describe(s: dict, p: dict, cov: np.ndarray) -> dict[str, tuple[float, ...]]:
        slope = p["slope"] * s["sy"] / s["sx"]
        shift = np.array([s["sy"], -s["mx"] * s["sy"] / s["sx"]])
        return {
            "intercept": _plain(s["my"] + p["intercept"] * s["sy"] - slope * s["mx"], shift @ cov[:2, :2] @ shift),
            "slope": _plain(slope, cov[1, 1] * (s["sy"] / s["sx"]) ** 2),
            "sigma": _on_log(math.sqrt(p["s2"]) * s["sy"], cov[2, 2]),
            "nu": _on_log(p["nu"], cov[3, 3]),
        }

    model = _Model(1, {"slope": 0.0, "intercept": 0.0, "s2": 1.0}, update, free, state, square, lambda p: math.log(p["s2"]))
    return _fitted(df, x, y, by, model, (nu, tol, max_iter, nu_range), describe)


def fitted_r2(df: DataFrame, x: str, y: str, fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``fits``, rows of ``robust_regression`` over the same pairs, with the share of variance that each
    line explains: var(fit) / (var(fit) + var(residual))."""
    lines = fits.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
    pairs = df.dropna(subset=[x, y])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not by:
        one = fits.select("intercept", "slope").first()
        pairs = pairs.withColumns({"__a": F.lit(one[0]), "__b": F.lit(one[1])})
    else:
        pairs = pairs.join(lines, same)
    fit = F.col(x) * F.col("__b") + F.col("__a")
    parts = pairs.select(*by, fit.alias("fit"), (F.col(y) - fit).alias("residual"))
    fit_var, rest_var = F.var_samp("fit"), F.var_samp("residual")
    shares = parts.groupBy(*by).agg(F.try_divide(fit_var, fit_var + rest_var).alias("r2"))
    if not by:
        return fits.withColumn("r2", F.lit(shares.first()[0]))
    shares = shares.select(*[F.col(c).alias(f"__{c}") for c in by], "r2")
    return fits.join(shares, same, "left").drop(*[f"__{c}" for c in by])


def model_r2(df: DataFrame, x: str, y: str, intercept: float, slope: float) -> DataFrame:
    """Share of variance explained by a given line: var(fit) / (var(fit) + var(residual))."""
    fit = F.col(x) * slope + intercept
    pairs = df.dropna(subset=[x, y]).select(fit.alias("fit"), (F.col(y) - fit).alias("residual"))
    fit_var, rest_var = F.var_samp("fit"), F.var_samp("residual")
    return pairs.agg(F.try_divide(fit_var, fit_var + rest_var).alias("r2"))
