"""Exact quantiles and parameter tables against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.parameters import persistence, spread, upper_triangle
from riskloom.operators.evaluate import summary
from riskloom.operators.selection import exact_quantiles, with_quantiles

LEVELS = (0.0, 0.025, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize(("rounds", "cuts"), [(0, 4), (1, 4), (2, 8), (1, 256), (3, 2)])
def test_exact_quantiles(spark, rounds, cuts):
    """Heavy tails, ties that hold a third of a group, one value, two values, nulls and a null key."""
    rng = np.random.default_rng(8)
    groups = {"wide": rng.standard_cauchy(3000), "ties": np.where(rng.random(1500) < 0.4, 7.0, rng.normal(7, 2, 1500).round(1)), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), None: rng.random(400), "same": np.full(300, -0.25)}
    rows = [(k, float(x), "x") for k, v in groups.items() for x in v] + [("wide", None, "x"), ("empty", None, "x")]
    df = spark.createDataFrame(rows, "rank string, v double, bucket string")
    found = exact_quantiles(df, ["rank"], "v", LEVELS, rounds, cuts).collect()
    got = {(r["rank"], r.level): (r.n, r.quantile) for r in found}
    assert len(found) == len(got) == len(groups) * len(LEVELS)
    for k, v in groups.items():
        for x in LEVELS:
            n, q = got[k, x]
            assert n == len(v) and q == pytest.approx(np.quantile(v, x), rel=1e-12, abs=1e-12), (k, x)
    built_in = {(r["rank"], x): r[f"p{k}"] for r in df.where("v is not null").groupBy("rank").agg(*[F.percentile("v", x).alias(f"p{k}") for k, x in enumerate(LEVELS)]).collect() for k, x in enumerate(LEVELS)}
    assert all(abs(got[k][1] - v) <= 1e-9 * max(1, abs(v)) for k, v in built_in.items())
    assert exact_quantiles(df.limit(0), ["rank"], "v", LEVELS, rounds, cuts).count() == 0


def test_quantiles_beside_groups(spark):
    """Columns of quantiles stand beside their groups, null keys and groups without values among them; summaries have the built-in median and no percentile in their plan."""
    rng = np.random.default_rng(9)
    rows = [(k, t, float(x), float(x) ** 2, int(x > 1), float(x), None if k == "none" else float(x)) for k in ("a", None, "none") for t, x in enumerate(rng.normal(0, 1, 301).round(2))]
    df = spark.createDataFrame(rows, "key string, t long, v double, score double, hit int, var double, es double")
    wanted = {"low": ("v", 0.1), "high": ("v", 0.9), "mid": ("es", 0.5)}
    got = {r["key"]: r for r in with_quantiles(df.groupBy("key").agg(F.count("*").alias("n")), df, ["key"], wanted, cuts=8).collect()}
    want = df.groupBy("key").agg(*[F.percentile(v, x).alias(n) for n, (v, x) in wanted.items()]).collect()
    assert len(got) == len(want) == 3
    for r in want:
        assert all(got[r["key"]][n] == (None if r[n] is None else pytest.approx(r[n], rel=1e-12)) for n in wanted) and got[r["key"]].n == 301
    told = summary(df, "key")
    assert {(r["key"], r.n_dates, r.n_tasks, r.median_es) for r in told.collect()} == {(r["key"], 301, 301, r.mid) for r in want}
    assert "percentile(" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_parameter_tables(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [[1.0, 0.5, 0.2], [0.5, 1.0, 0.1], [0.2]]), (2, None, [[1.0, 2.0]]), (3, ["a"], None)], "i int, names array<string>, matrix array<array<double>>")
    got = sorted(((r.i, r.node_i, r.node_j, r.value) for r in upper_triangle(df, ["i"], "names", "matrix").collect()), key=repr)
    assert got == [(1, "a", "b", 0.5), (1, "a", "c", 0.2), (1, "b", "c", 0.1), (2, None, None, 2.0)]
    fits = persistence(spark.createDataFrame([("x", 1.0, 0.1, 0.8), ("x", 3.0, 0.2, 0.8), ("x", 2.0, 0.0, 0.5)], "k string, omega double, alpha double, beta double"))
    assert sorted(r.long_run_variance or 0 for r in fits.collect()) == pytest.approx([0.0, 4.0, 10.0])
    r = spread(fits, ["k"], ["omega", "long_run_variance"]).first()
    assert (r.omega_min, r.omega_median, r.omega_max, r.long_run_variance_max) == pytest.approx((1.0, 2.0, 3.0, 10.0))
