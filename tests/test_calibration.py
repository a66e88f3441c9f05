"""Small linear systems, tails of distributions and calibration tests against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import chi2_tail, erfc, place_among, quadratic_form
from riskloom.operators.calibration import INSTRUMENTS, calibration_table


def test_tails(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 4.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(erfc(F.col("z"))).collect()]
    assert all(abs(g - math.erfc(x)) <= 1e-12 + 1e-9 * math.erfc(x) for g, x in zip(got, z, strict=True))
    grid = np.linspace(0, 60, 600_001)
    for k in range(1, 7):
        x = [0.5, 3.841, 7.0, 20.0]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(chi2_tail(F.col("x"), k)).collect()]
        density = grid[1:] ** (k / 2 - 1) * np.exp(-grid[1:] / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        want = [density[grid[1:] > v].sum() * (grid[1] - grid[0]) for v in x]
        assert np.allclose(got, want, atol=1e-4), k


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_quadratic_form(spark, k):
    rng = np.random.default_rng(k)
    rows, want = [], []
    for lost in range(4):
        x = rng.normal(size=(40, k)) * 10.0 ** rng.integers(-4, 4, k)
        if lost == 1 and k > 1:
            x[:, -1] = x[:, 0] * 3
        if lost == 2:
            x[:, 0] = 5
        if lost == 3 and k > 2:
            x[:, 1] = x[:, 0] - x[:, 2]
        c, m = np.cov(x.T).reshape(k, k), x.mean(axis=0)
        scale = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1))
        rank = int(np.linalg.matrix_rank(c / scale / scale[:, None], tol=1e-8))
        want.append((rank, float(m @ np.linalg.solve(c, m)) if rank == k else None))
        rows.append((lost, m.tolist(), c.tolist()))
    df = spark.createDataFrame(rows, "n int, m array<double>, c array<array<double>>")
    rank, form = quadratic_form([F.col("m")[i] for i in range(k)], {(i, j): F.col("c")[i][j] for i in range(k) for j in range(i, k)})
    for (r, f), (a, b) in zip([tuple(x) for x in df.orderBy("n").select(rank, form).collect()], want, strict=True):
        assert r == a and ((f is None and b is None) or abs(f - b) <= 1e-6 * abs(b))


def test_place_among(spark):
    cuts = [1.0, 2.0, 2.0, 5.0]
    got = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.9, 5.0, 9.0)], "v double").select(place_among(F.array(*map(F.lit, cuts)), F.col("v"), 4)).collect()
    assert [r[0] for r in got] == [0, 1, 3, 3, 4, 4]


def hac(x, lags):
    z = x - x.mean(axis=0)
    v = z.T @ z / len(x)
    for k in range(1, min(lags, len(x) - 1) + 1):
        a = z[k:].T @ z[:-k] / len(x)
        v += (1 - k / (lags + 1)) * (a + a.T)
    return v / len(x)


def test_conditional_calibration(spark):
    """One task of ordinary rows, one too sparse for p-values, one without a breach, whose covariances are singular."""
    rng, rows = np.random.default_rng(1), []
    for model, often in (("a", 0.1), ("b", 0.02), ("c", 0.0)):
        for t in range(500):
            var, es = 1 + rng.random(), 2.5 + rng.random()
            hit = bool(rng.random() < often)
            y = var + rng.random() if hit else var - 0.1 - rng.random()
            rows.append((model, t, 0.95, int(hit), es - var - max(y - var, 0) / (1 - 0.95), es))
    df = spark.createDataFrame(rows, "model string, t long, tau double, hit int, tail_residual double, es double")
    got = {r.model: r for r in calibration_table(df, ["model", "tau"], 20).collect()}
    for model in "abc":
        mine = [r for r in rows if r[0] == model]
        h, u, size = (np.array(x) for x in zip(*[(r[3] - 0.05, r[4] / r[5], np.log(r[5])) for r in mine], strict=True))
        lag = np.concatenate([[np.nan] * 2, h[:-2]])
        given = np.column_stack([h * 1, h * lag, h * size, u * 1, u * lag, u * size])[2:]
        r, breaches = got[model], int((h > 0).sum())
        assert (r.n, r.conditional_n, r.breaches, r.sparse) == (500, 498, breaches, breaches < 30)
        assert abs(r.rate_high - r.breach_rate - 1.96 * np.sqrt(max(hac(h[:, None], 20)[0, 0], 0))) < 1e-9
        for name, x in (("joint", np.column_stack([h, u])), ("conditional", given[:, :3]), ("conditional_joint", given)):
            stat, rank, p = r[f"{name}_statistic"], r[f"{name}_rank"], r[f"{name}_p"]
            if model == "c":  # h is constant, and so is its product with the lagged breach
                assert stat is None and p is None and rank < x.shape[1]
            else:
                m = x.mean(axis=0)
                assert rank == x.shape[1] and abs(stat - m @ np.linalg.solve(hac(x, 20), m)) < 1e-6 * stat
                assert (p is None) == (breaches < 30)
    assert len(INSTRUMENTS) == 3 and calibration_table(df.limit(0), ["model", "tau"], 20).count() == 0
