"""The trend against an independent dense calculation, and its own convergence."""

import math

import numpy as np
import pytest

from fieldcount.operators import trend

RNG = np.random.default_rng(7)


def make_series(steps=12, noise=0.3, missing=(4,)):
    level = 8 + np.cumsum(RNG.normal(0.05, 0.2, steps))
    y = level + RNG.normal(0, noise, steps)
    y[list(missing)] = np.nan
    return y


def dense(y, grid=100):
    """Weights, means and variances of ln N, conditioning one big Gaussian node by node."""
    steps = len(y)
    u = (np.arange(grid) + 0.5) / grid
    sd, slope = 2 * u**2, u  # another substitution than the operator's
    k = np.arange(steps)
    seen = ~np.isnan(y)
    miss = y[seen] - y[0]
    logs, means, variances = [], [], []
    for e, we in zip(sd, slope):
        prior = 4.0 + np.outer(k, k) * 1.0 + np.minimum.outer(k, k) * e * e
        for s, ws in zip(sd, slope):
            total = prior[np.ix_(seen, seen)] + s * s * np.eye(seen.sum())
            gain = np.linalg.solve(total, prior[seen]).T
            means.append(y[0] + gain @ miss)
            variances.append(np.diag(prior - gain @ prior[seen]))
            fit = -0.5 * (np.linalg.slogdet(total)[1] + miss @ np.linalg.solve(total, miss))
            logs.append(fit + math.log(we * ws))
    w = np.exp(np.array(logs) - max(logs))
    return w / w.sum(), np.array(means), np.array(variances)


def frame(spark, series):
    rows = [
        (name, t, None if math.isnan(v) else float(v))
        for name, y in series.items()
        for t, v in enumerate(y, start=2001)
    ]
    return spark.createDataFrame(rows, "species string, year int, log_n double")


def fit(spark, df, **options):
    rows = trend.local_level_trend(df, **options).orderBy("species", "year").collect()
    return {s: [r for r in rows if r.species == s] for s in {r.species for r in rows}}


def test_matches_dense_gaussian_conditioning(spark):
    y = make_series()
    got = fit(spark, frame(spark, {"a": y}))["a"]
    w, m, v = dense(y)
    mean = w @ np.exp(m + v / 2)
    sd = np.sqrt(w @ np.exp(2 * m + 2 * v) - mean**2)
    assert [r["mean"] for r in got] == pytest.approx(list(mean), rel=3e-3)
    assert [r.sd for r in got] == pytest.approx(list(sd), rel=1e-2)


def test_limits_are_quantiles_of_the_dense_mixture(spark):
    y = make_series()
    got = fit(spark, frame(spark, {"a": y}))["a"]
    w, m, v = dense(y)
    for t, row in enumerate(got):
        for name, p in (("lcl", 0.025), ("median", 0.5), ("ucl", 0.975)):
            z = (math.log(row[name]) - m[:, t]) / np.sqrt(2 * v[:, t])
            below = sum(wi * 0.5 * math.erfc(-zi) for wi, zi in zip(w, z))
            assert below == pytest.approx(p, abs=2e-3)


def whole_square(y, n=130):
    """Results on one grid that is fine everywhere."""
    return trend._results(np.asarray(y), trend._Grid(np.asarray(y), np.array([[0.0, 1.0], [0.0, 1.0]]), n))


@pytest.mark.parametrize("noise", [0.8, 0.3, 0.02])
@pytest.mark.parametrize("steps", [2, 8, 20, 60])
def test_the_fitted_grid_gives_what_a_fine_one_gives(steps, noise):
    y = make_series(steps, noise, missing=(4,) if steps > 4 else ())
    levels, parameters = whole_square(y)
    found, of_parameters, error, nodes = trend._fit(y, 1e-8)
    assert found == pytest.approx(levels, rel=3e-7)
    assert of_parameters == pytest.approx(parameters, rel=1e-4, abs=1e-6)
    assert error < 1e-8


def test_four_digits_take_less_than_half_of_a_full_grid():
    spent = []
    for steps, noise in ((2, 0.3), (8, 0.3), (20, 0.8), (60, 0.3)):
        y = make_series(steps, noise, missing=())
        found, _, _, nodes = trend._fit(y, 1e-4)
        assert found == pytest.approx(whole_square(y)[0], rel=1e-4)
        spent.append(nodes)
    assert sum(spent) / len(spent) < 6400 / 2


def test_parameters_match_dense_conditioning(spark):
    y = make_series(14)
    rows = trend.trend_parameters(frame(spark, {"a": y})).collect()
    got = {r.parameter: r for r in rows}
    grid = 100
    w, _, _ = dense(y, grid)
    sds = 2 * ((np.arange(grid) + 0.5) / grid) ** 2
    for name, weight in (("process_sd", w.reshape(grid, grid).sum(1)), ("observation_sd", w.reshape(grid, grid).sum(0))):
        mean = weight @ sds
        assert got[name]["mean"] == pytest.approx(mean, rel=2e-3)
        assert got[name].sd == pytest.approx(math.sqrt(weight @ (sds - mean) ** 2), rel=5e-3)
        for c, p in (("lcl", 0.025), ("median", 0.5), ("ucl", 0.975)):
            assert np.interp(got[name][c], sds, np.cumsum(weight) - weight / 2) == pytest.approx(p, abs=5e-3)
    # the drift is what the level gains a step in the long run
    y = 5 + 0.1 * np.arange(40) + RNG.normal(0, 0.02, 40)
    growth = trend.trend_parameters(frame(spark, {"a": y})).filter("parameter = 'growth_rate'").first()
    assert growth["mean"] == pytest.approx(0.1, abs=0.01)
    assert growth.lcl < 0.1 < growth.ucl


def test_a_bad_series_has_no_parameters(spark):
    rows = trend.trend_parameters(frame(spark, {"late": [math.nan, 1.0]})).collect()
    assert [(r.parameter, r["mean"], r.status) for r in rows] == [
        (p, None, "first value missing") for p in ("growth_rate", "process_sd", "observation_sd")
    ]


def test_a_bad_series_leaves_the_others_alone(spark):
    good = make_series(8)
    rows = frame(spark, {"a": good, "late": [math.nan, 1.0, 2.0], "zero": [1.0, -math.inf, 2.0]})
    twice = spark.createDataFrame([("twice", 2001, 1.0), ("twice", 2001, 2.0)], rows.schema)
    got = fit(spark, rows.unionByName(twice))
    assert {s: {r.status for r in rs} for s, rs in got.items()} == {
        "a": {"ok"},
        "late": {"first value missing"},
        "zero": {"count without a logarithm"},
        "twice": {"several values at one time"},
    }
    assert [r["mean"] for r in got["a"]] == [r["mean"] for r in fit(spark, frame(spark, {"a": good}))["a"]]
    assert all(r["mean"] is None and r.ucl is None for s in ("late", "zero", "twice") for r in got[s])
