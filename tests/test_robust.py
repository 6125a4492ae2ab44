"""Student-t fits against a direct maximisation and known parameters."""

import math

import numpy as np
import pytest

from fieldcount.operators import robust


def t_pairs(n=1500, nu=4.0, rho=0.6, seed=2):
    rng = np.random.default_rng(seed)
    z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
    z /= np.sqrt(rng.chisquare(nu, n) / nu)[:, None]
    return np.column_stack([10 + 3 * z[:, 0], -4 + 2 * z[:, 1]])


def frame(spark, pairs):
    rows = [(float(a), float(b)) for a, b in pairs] + [(None, 1.0), (2.0, None)]
    return spark.createDataFrame(rows, "a double, b double").repartition(5)


def log_lik(pairs, mx, my, sx, sy, rho, nu):
    a, b = (pairs[:, 0] - mx) / sx, (pairs[:, 1] - my) / sy
    d = (a * a - 2 * rho * a * b + b * b) / (1 - rho * rho)
    scale = math.log(sx * sy * math.sqrt(1 - rho * rho))
    const = math.lgamma((nu + 2) / 2) - math.lgamma(nu / 2) - math.log(nu * math.pi)
    return len(pairs) * (const - scale) - (nu + 2) / 2 * np.log1p(d / nu).sum()


def test_bivariate_is_a_maximum(spark):
    pairs = t_pairs()
    r = robust.robust_bivariate(frame(spark, pairs), "a", "b").first()
    assert r.n_pairs == len(pairs)
    best = [r.mu_x, r.mu_y, r.sigma_x, r.sigma_y, r.rescor, r.nu]
    top = log_lik(pairs, *best)
    for i, step in enumerate((0.02, 0.02, 0.02, 0.02, 0.01, 0.1)):
        for sign in (-1, 1):
            moved = list(best)
            moved[i] += sign * step
            assert log_lik(pairs, *moved) < top
    assert r.rescor == pytest.approx(0.6, abs=0.05)
    assert r.nu == pytest.approx(4, abs=1)


def test_bivariate_with_fixed_nu(spark):
    r = robust.robust_bivariate(frame(spark, t_pairs()), "a", "b", nu=7.0).first()
    assert r.nu == 7.0


def test_regression_shrugs_off_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 800)
    y = 2 + 0.5 * x + rng.normal(0, 0.1, 800)
    y[:60] += 30
    r = robust.robust_regression(frame(spark, np.column_stack([x, y])), "a", "b").first()
    assert r.slope == pytest.approx(0.5, abs=0.01)
    assert r.intercept == pytest.approx(2, abs=0.05)


def test_light_tails_end_at_the_upper_limit(spark):
    rng = np.random.default_rng(5)
    r = robust.robust_bivariate(frame(spark, rng.uniform(0, 1, (400, 2))), "a", "b").first()
    assert r.nu == robust.NU_RANGE[1]


@pytest.mark.parametrize("nu_range", [(1.0, 5.0), (2.0, 200.0)])
def test_a_bound_gives_what_the_same_nu_gives(spark, nu_range):
    rng = np.random.default_rng(8)
    pairs = np.column_stack([rng.normal(0, 1, 3000), rng.normal(0, 1, 3000)])
    df = frame(spark, pairs)
    for fit in (robust.robust_regression, robust.robust_bivariate):
        bound, given = fit(df, "a", "b", nu_range=nu_range).first(), fit(df, "a", "b", nu=nu_range[1]).first()
        if bound.nu == nu_range[1]:
            assert bound.nu_at_bound and bound.converged
            for c in set(bound.asDict()) & {"sigma", "sigma_x", "sigma_y", "slope", "rescor"}:
                assert bound[c] == pytest.approx(given[c], rel=1e-4)
        assert nu_range[1] > 5 or bound.nu == 5


def dense_errors(log_lik, best):
    """Standard errors by second differences of a log likelihood."""
    k, h = len(best), np.array([1e-3 * max(1, abs(b)) for b in best])
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(k):
            total = 0
            for a in (-1, 1):
                for b in (-1, 1):
                    moved = np.array(best, float)
                    moved[i] += a * h[i]
                    moved[j] += b * h[j]
                    total += a * b * log_lik(*moved)
            hess[i, j] = total / (4 * h[i] * h[j])
    return np.sqrt(np.diag(np.linalg.inv(-hess)))


def test_standard_errors_are_those_of_the_observed_information(spark):
    pairs = t_pairs(800)
    r = robust.robust_bivariate(frame(spark, pairs), "a", "b").first()
    names = ["mu_x", "mu_y", "sigma_x", "sigma_y", "rescor", "nu"]
    wanted = dense_errors(lambda *p: log_lik(pairs, *p), [r[n] for n in names])
    assert [r[f"{n}_se"] for n in names] == pytest.approx(list(wanted), rel=0.01)
    assert all(r[f"{n}_lcl"] < r[n] < r[f"{n}_ucl"] for n in names)

    line = robust.robust_regression(frame(spark, pairs), "a", "b").first()

    def of_line(a, b, s, nu):
        d = ((pairs[:, 1] - a - b * pairs[:, 0]) / s) ** 2
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - math.log(nu * math.pi) / 2 - math.log(s)
        return len(pairs) * const - (nu + 1) / 2 * np.log1p(d / nu).sum()

    names = ["intercept", "slope", "sigma", "nu"]
    wanted = dense_errors(of_line, [line[n] for n in names])
    assert [line[f"{n}_se"] for n in names] == pytest.approx(list(wanted), rel=0.01)


def test_groups_are_fitted_as_if_alone(spark):
    sets = {"p": t_pairs(300, seed=1), None: t_pairs(400, 6.0, -0.3, seed=5), "q": t_pairs(200, 3.0, 0.9, seed=9)}
    rows = [(k, float(a), float(b)) for k, ps in sets.items() for a, b in ps] + [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "kind string, a double, b double").repartition(4)
    for fit in (robust.robust_bivariate, robust.robust_regression):
        got = {r.kind: r for r in fit(df, "a", "b", by=["kind"]).collect()}
        assert set(got) == {"p", None, "q", "one", "flat"}
        for k, ps in sets.items():
            alone = fit(frame(spark, ps), "a", "b").first().asDict()
            for c, v in alone.items():
                assert got[k][c] == pytest.approx(v, rel=1e-6) if isinstance(v, float) else got[k][c] == v
        assert (got["one"].nu, got["one"].n_pairs, got["one"].converged) == (None, 1, False)
        assert got["flat"].nu is None
    fits = robust.robust_regression(df, "a", "b", by=["kind"])
    shares = {r.kind: r.r2 for r in robust.fitted_r2(df, "a", "b", fits, ["kind"]).collect()}
    line = {r.kind: r for r in fits.collect()}["p"]
    fit = line.intercept + line.slope * sets["p"][:, 0]
    rest = np.var(sets["p"][:, 1] - fit)
    assert shares["p"] == pytest.approx(np.var(fit) / (np.var(fit) + rest))
    assert shares["one"] is None


def test_variance_share(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (-1) ** i) for i in range(40)], "a double, b double")
    r2 = robust.model_r2(df, "a", "b", 0.0, 2.0).first().r2
    fit = np.var([2.0 * i for i in range(40)], ddof=1)
    rest = np.var([(-1.0) ** i for i in range(40)], ddof=1)
    assert r2 == pytest.approx(fit / (fit + rest))
