"""Numbering, frames, recursions and as-of joins in parts against plain loops."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.joins import latest_completed
from riskloom.operators.ordered import affine_scan, framed, numbered
from riskloom.plans import panel_queries
from riskloom.plans.base import panel, returns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered(spark):
    rng = random.Random(2)
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(9000)) for _ in range(700)] + [None]
    df = spark.createDataFrame([(d, 1, k) for k, d in enumerate(days)], "d date, bucket int, before long")
    found = numbered(df, "d", F.year("d"))
    got = sorted(((r.t, r.d) for r in found.collect()), key=lambda r: r[0])
    assert [t for t, _ in got] == list(range(1, 702)) and [d for _, d in got] == [None, *sorted(d for d in days if d)]
    assert found.columns == ["t", "d", "bucket", "before"] and numbered(df.limit(0), "d", F.year("d")).count() == 0


def test_panel_has_no_single_task(spark):
    """Neither the panel, nor its increments, nor outcomes pass through one partition."""
    folder = "/root/testdata/sf0.001"
    for df in (panel(spark, folder), returns(spark, folder), panel_queries.QUERIES["outcome_tasks_h20"](spark, folder), panel_queries.QUERIES["rolling_return_sum"](spark, folder)):
        assert "SinglePartition" not in plan_of(df)


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_framed(spark, size):
    rows = [(k, t, float(t * t % 17)) for k in "ab" for t in range(3, 60)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    made = lambda w: [F.sum("v").over(w.rowsBetween(-5, 3)).alias("s"), F.lead("v", 2).over(w).alias("next"), F.lag("v", 4).over(w).alias("past")]
    got = {(r.k, r.t): (r.s, r.next, r.past) for r in framed(df, made, before=5, after=3, by=["k"], size=size).collect()}
    v = {t: x for _, t, x in rows}
    assert got == {(k, t): (sum(v.get(u, 0.0) for u in range(t - 5, t + 4)), v.get(t + 2), v.get(t - 4)) for k, t, _ in rows}


@pytest.mark.parametrize(("size", "levels"), [(4, 3), (16, 1), (5000, 0), (256, 2)])
@pytest.mark.parametrize("floor", [None, 2.0])
def test_affine_scan(spark, size, levels, floor):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, factor, first in (("a", 0.9, 1.5), ("b", 0.0, -3.0), ("c", 1.0, 0.25)):
        x = first
        for t in range(7, 907):
            add = float(rng.normal())
            rows.append((key, t, add, factor, f"n{t}"))
            entry, x = x, max(add + factor * x, -1e308 if floor is None else floor)
            want[key, t] = (entry, x, f"n{t}")
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, int(t), float(a), float(f), n) for k, t, a, f, n in rows], "i string, piece long, a double, f double, steps string")
    first = spark.createDataFrame([("a", 1.5), ("b", -3.0), ("c", 0.25)], "i string, first double")
    found = affine_scan(df, ["i"], "piece", F.col("a"), F.col("f"), first, floor, ["steps"], size, levels)
    got = {(r.i, r.piece): (r.entry, r.state, r.steps) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k][:2], want[k][:2], rtol=1e-11, atol=1e-11) and got[k][2] == want[k][2] for k in want)


def test_affine_scan_refuses(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0)], "k string, t long, a double")
    with pytest.raises(Exception, match="a step is null"):
        affine_scan(df, ["k"], "t", F.col("a"), 0.5, F.lit(0.0)).collect()
    with pytest.raises(Exception, match="a step is null"):
        affine_scan(df.where("t = 2"), ["k"], "t", F.col("a"), -0.5, F.lit(0.0)).collect()
    assert affine_scan(df.limit(0), ["k"], "t", F.col("a"), 0.5, F.lit(0.0)).count() == 0


def test_unkeyed_asof_with_a_hot_moment(spark):
    """A third of the left rows share one time; right has gaps, repeated times and a row without one."""
    rng = random.Random(4)
    left = [(k, 5_000 if k % 3 == 0 else rng.randrange(10_000), "x") for k in range(3_000)] + [(9_999_999, None, "y"), (9_999_998, -5, None)]
    right = [(rng.choice([rng.randrange(100, 900), rng.randrange(6_000, 7_000), 4_321]), f"v{k}", k) for k in range(800)] + [(None, "never", 1)]
    a, b = spark.createDataFrame(left, "id long, at long, part string"), spark.createDataFrame(right, "known long, v string, task long")
    best = {}
    for row in right:
        if row[0] is not None:
            best[row[0]] = max(best.get(row[0], row), row)
    times = sorted(best)
    found = latest_completed(a, b, "at", "known")
    got = {r.id: (r.at, r.part, r.known, r.v, r.task) for r in found.collect()}
    assert len(got) == len(left) == found.count()
    for k, at, part in left:
        n = bisect.bisect_right(times, at) if at is not None else 0
        assert got[k] == (at, part, *(best[times[n - 1]] if n else (None,) * 3))
    assert sorted((r.id, r.v) for r in latest_completed(a.limit(2), b.limit(0), "at", "known").collect()) == [(0, None), (1, None)]
    assert latest_completed(a.limit(0), b, "at", "known").count() == 0
    plan = plan_of(found)
    assert "SinglePartition" not in plan and "hashpartitioning(part" in plan and "task" in plan.split("hashpartitioning(part")[1][:40]
