"""Forecasts over chunks against loops over whole series."""

import numpy as np
import pytest
from marlstone.operators import forecasting as T

RNG = np.random.default_rng(4)
SERIES = {name: 1000 * (i + 1) + np.arange(n) * (i - 0.5) + 20 * np.sin(np.arange(n) * 2 * np.pi / 7) + RNG.normal(0, 5, n) for i, (name, n) in enumerate({"long": 83, "mid": 30, None: 41, "eight": 8, "five": 5, "one": 1}.items())}


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, 3 * t, float(y), 1) for k, ys in SERIES.items() for t, y in enumerate(ys)]
    rows += [("mid", 10, None, 1), ("mid", 11, float("nan"), 1), ("empty", 1, None, 1)]
    return spark.createDataFrame(rows, "k string, t int, y double, _t int").repartition(4).cache()


def smooth(y, s, alpha, beta, gamma, phi):
    season = y[:s] - y[:s].mean() if s > 1 else np.zeros(1)
    level, trend = y[:s].mean(), (y[s] - y[0]) / s if beta is not None else 0.0
    miss = []
    for t, v in enumerate(y):
        miss.append(v - level - phi * trend - season[t % s])
        if t < len(y) - 1:
            new = alpha * (v - season[t % s]) + (1 - alpha) * (level + phi * trend)
            trend = beta * (new - level) + (1 - beta) * phi * trend if beta is not None else 0.0
            if s > 1:
                season[t % s] = gamma * (v - new) + (1 - gamma) * season[t % s]
            level = new
    return np.mean(np.square(miss)), level, trend, season


@pytest.mark.parametrize(("period", "betas", "phi"), [(7, (0.1, 0.3), 1.0), (7, (0.2,), 0.9), (1, (0.1, 0.2), 1.0), (7, None, 1.0), (1, None, 1.0)])
@pytest.mark.parametrize("chunk", [1, 9, 1 << 16])
def test_smoothing(df, period, betas, phi, chunk):
    if chunk == 1 and (betas is None or phi < 1):
        pytest.skip("chunks of one row are tried with two settings")
    got = {r["k"]: r for r in T.holt_winters(df, ["k"], "t", "y", 10, period, (0.2, 0.6), betas, (0.1, 0.4), phi, chunk).collect()}
    assert set(got) == set(SERIES)
    for k, y in SERIES.items():
        if len(y) <= period:
            assert got[k]["forecast"] is None and got[k]["n"] == len(y)
            continue
        tried = [((a, b, g), smooth(y, period, a, b, g, phi)) for a in (0.2, 0.6) for b in (betas or [None]) for g in ((0.1, 0.4) if period > 1 else [0.0])]
        (a, b, g), (mse, level, trend, season) = min(tried, key=lambda x: x[1][0])
        ahead = np.array([sum(phi**j for j in range(h + 1)) for h in range(10)])
        want = level + trend * ahead + np.array([season[(len(y) + h) % period] for h in range(10)])
        r = got[k]
        assert (r["alpha"], r["beta"], r["gamma"], r["n"]) == (a, b or 0.0, g, len(y))
        assert [r["mse"], r["level"], r["trend"]] == pytest.approx([mse, level, trend], rel=1e-8, abs=1e-8)
        assert r["forecast"] == pytest.approx(want.tolist()) and len(r["seasons"]) == (period if period > 1 else 0)


@pytest.mark.parametrize(("p", "d", "q", "seasonal"), [(1, 1, 1, 0), (2, 0, 2, 0), (0, 1, 1, 0), (1, 2, 0, 0), (2, 1, 1, 1)])
@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_arima(df, p, d, q, seasonal, chunk):
    got = {r["k"]: r for r in T.arima(df, ["k"], "t", "y", 9, p, d, q, seasonal, 7, chunk=chunk).collect()}
    assert set(got) == set(SERIES)
    for k, y in SERIES.items():
        stages = [y]
        for lag in [7] * seasonal + [1] * d:
            stages.append(stages[-1][lag:] - stages[-1][:-lag])
        z = stages[-1]
        if len(z) <= p:
            assert got[k]["forecast"] is None and got[k]["n"] == len(y)
            continue
        x = np.column_stack([z[p - i - 1 : len(z) - i - 1] for i in range(p)]) if p else np.zeros((len(z), 0))
        a = np.linalg.solve(x.T @ x + 1e-6 * np.eye(p), x.T @ z[p:])
        c = np.mean(z[p:] - x @ a)
        r = z[p:] - x @ a - c
        theta = [float(np.clip(np.mean(r[i:] * r[:-i]) / (r.var() + 1e-10), -0.99, 0.99)) if len(r) > i else 0.0 for i in range(1, q + 1)]
        zs, rs, ahead = list(z), [0.0] * q + list(r), []
        for _ in range(9):
            ahead.append(c + sum(a[i] * zs[-1 - i] for i in range(p)) + sum(theta[i] * rs[-1 - i] for i in range(q)))
            zs.append(ahead[-1])
            rs.append(0.0)
        for lag, stage in zip([1] * d + [7] * seasonal, stages[-2::-1]):
            full = list(stage)
            for v in ahead:
                full.append(v + full[-lag])
            ahead = full[len(stage) :]
        g = got[k]
        assert g["coefficients"] == pytest.approx(a.tolist(), rel=1e-6) and g["moving"] == pytest.approx(theta, rel=1e-6, abs=1e-9)
        assert [g["intercept"], g["sigma2"]] == pytest.approx([c, r.var()], rel=1e-6, abs=1e-6)
        assert g["forecast"] == pytest.approx(ahead, rel=1e-6)
        assert g["upper"][3] - g["forecast"][3] == pytest.approx(1.96 * 2 * r.std(), abs=1e-6) and g["lower"][0] == pytest.approx(ahead[0] - 1.96 * r.std(), rel=1e-6)


def test_no_rows(df):
    assert T.holt_winters(df.limit(0), ["k"], "t", "y", 3).count() == 0 and T.arima(df.limit(0), ["k"], "t", "y", 3).count() == 0
    with pytest.raises(ValueError):
        T.arima(df, ["k"], "t", "y", 3, chunk=2)
