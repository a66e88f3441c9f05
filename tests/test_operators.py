"""Operators on small hand-made tables, and readers and writers."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import fz0, task_losses
from riskloom.operators import inference as I
from riskloom.operators.evaluate import factorial, hac_variance
from riskloom.operators.filters import Garch, filtered, normal_draws, task_sets
from riskloom.operators.joins import components_of, latest_completed, one_to_one
from riskloom.operators.panel import columns
from riskloom.operators.reshape import duplicate_keys, matrix, require_empty
from riskloom.operators.risk import sets, var_es, weighted_var_es
from riskloom.sources import io


def test_cash_identity(spark):
    """The compact formula equals the valuation of fixed quantities, whatever the increments."""
    a, b = (0.1, -0.2, 0.3, 0.05), (-0.4, 0.2, 0.1, 0.0)
    df = spark.createDataFrame([(*a, *b)], [*(f"a{k}" for k in range(1, 5)), *(f"b{k}" for k in range(1, 5))])
    got = {(x.book, x.report): x.loss for x in df.select(task_losses(columns("a"), columns("b")).alias("x")).first().x}
    w = (0.4, 0.1, -0.3, -0.2)
    start = sum(x * math.exp(p) for x, p in zip(w, a, strict=True))
    end = sum(x * math.exp(p + q) for x, p, q in zip(w, a, b, strict=True))
    assert abs(got["net_cashflows", "base"] - (start - end)) < 1e-14
    assert abs(got["net_cashflows", "s1"] - (start / math.exp(a[0]) - end / math.exp(a[0] + b[0]))) < 1e-14


def test_var_es_and_weights(spark):
    x = spark.createDataFrame([(1, k, float(k), 0.05) for k in range(1, 21)], "t int, s int, loss double, w double")
    plain = {str(r.tau): (r["var"], r.es) for r in var_es(sets(x, "t"), ["t"]).collect()}
    assert plain["0.95"] == (19.0, pytest.approx(19 + 1 / 20 / 0.05)) and plain["0.99"][0] == 20.0
    held = x.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("loss", "s", "w"))).alias("x"))
    weighted = {str(r.tau): (r["var"], r.es) for r in weighted_var_es(held, ["t"]).collect()}
    assert weighted["0.95"] == (19.0, pytest.approx(plain["0.95"][1]))


def test_score_domain(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0), (0.0, 0.5, -1.0), (0.0, 2.0, 1.0)], "y double, q double, e double")
    got = [r[0] for r in df.select(fz0(F.col("y"), F.col("q"), F.col("e"), F.lit(0.95).cast("decimal(3,2)"))).collect()]
    assert got[0] == pytest.approx(0.5 / 0.05 + 0.5 - 1) and got[1:] == [None, None]


def test_latest_completed(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "who string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "who string, known int, v string")
    assert {(r.who, r.at): r.v for r in latest_completed(left, right, "at", "known", ["who"]).collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_joins_refuse_bad_input(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, y double")
    assert [tuple(r) for r in one_to_one(left, right, ["k"]).collect()] == [(1, "a", 1.0)]
    with pytest.raises(Exception, match="occurs twice"):
        one_to_one(left, right.union(right), ["k"]).collect()
    rows = [(1, "A", 1.0, 2.0, 0.5), (1, "B", 1.5, 2.5, 0.5), (1, "C", 9.0, 9.0, 0.9)]
    f, chosen = spark.createDataFrame(rows, "t int, model string, var double, es double, actual double"), spark.createDataFrame([("A",), ("B",)], "model string")
    assert [tuple(r) for r in components_of(f, chosen, ["model"], ["t"]).collect()] == [(1, 0.5, ["A", "B"], [1.0, 1.5], [2.0, 2.5])]
    for bad, what in ((f.where("model <> 'B'"), "lacks"), (f.union(f.where("model = 'A'")), "twice"), (f.withColumn("actual", F.when(F.col("model") == "B", 0.6).otherwise(0.5)), "disagree")):
        with pytest.raises(Exception, match=what):
            components_of(bad, chosen, ["model"], ["t"]).collect()


def test_block_draws_are_explicit(spark):
    """Means and medians of draws equal those of the dates that their starts name; starts are spread evenly."""
    n, block = 39, 7
    daily = spark.createDataFrame([("a", 10 * k, float(k % 11), 3.0 * (k % 11) + 2) for k in range(1, n + 1)], "g string, t long, x double, y double")
    starts = I.block_starts(spark.createDataFrame([("a", n)], "g string, n long"), [block, 60], 400, 1).collect()
    mean = {(r.block, r.rep, r.contrast): r["mean"] for r in I.block_means(daily, ["g"], ["x", "y"], [block, 60], 400, 1).collect()}
    median = {(r.block, r.rep, r.contrast): r["median"] for r in I.block_medians(daily, ["g"], ["x", "y"], [block, 60], 400, 1).collect()}
    drawn = {}
    for r in starts:
        drawn.setdefault((r.block, r.rep), []).extend((r.start + k) % n for k in range(r.length))
    assert len(drawn) == 800 and all(len(v) == n for v in drawn.values())
    for (b, rep), dates in drawn.items():
        values = sorted(float((k + 1) % 11) for k in dates)
        assert mean[b, rep, "x"] == pytest.approx(sum(values) / n) and mean[b, rep, "y"] == pytest.approx(3 * sum(values) / n + 2)
        assert median[b, rep, "x"] == values[n // 2] and median[b, rep, "y"] == 3 * values[n // 2] + 2
    begins = [r.start for r in starts if r.block == block]
    assert set(begins) == set(range(n)) and abs(sum(begins) / len(begins) - (n - 1) / 2) < 1.0


def test_bands_cover_by_family(spark):
    draws = spark.createDataFrame([("f", k, c, m * ((k % 21) - 10) / 10) for k in range(210) for c, m in (("x", 1.0), ("y", 2.0))], "f string, rep long, contrast string, mean double")
    band = {r.contrast: r for r in I.bands(draws, spark.createDataFrame([("x", 0.0), ("y", 0.0)], "contrast string, estimate double"), ["f"]).collect()}
    assert band["x"].critical == pytest.approx(band["y"].critical) and band["y"].se == pytest.approx(2 * band["x"].se)
    assert band["x"].one_sided_high <= band["x"].simultaneous_high and band["x"].simultaneous_low == pytest.approx(-band["x"].simultaneous_high)


def test_hac_is_the_sum_over_lags(spark):
    v = [float((7 * k * k) % 13) for k in range(50)]
    got = hac_variance(spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "g string, t long, v double"), "v", 6, "g").first()
    z = [x - sum(v) / 50 for x in v]
    want = sum(z[i] * z[j] * max(0.0, 1 - abs(i - j) / 7) for i in range(50) for j in range(50)) / 2500
    assert got.variance == pytest.approx(want) and got.n == 50


def test_variance_path_is_causal(spark):
    r = np.sin(np.arange(600.0))
    p = Garch(0.1, 5.0, 0.08, 0.9, 30.0)

    def path(values):
        rows = [(t, float(v), 0.0, 0.0, 0.0) for t, v in enumerate(values, 1)]
        f = filtered(spark.createDataFrame(rows, "t long, r1 double, r2 double, r3 double, r4 double"), p)
        return [x.h for x in f.where("reference = 'base' and node = 's1'").orderBy("t").collect()]

    h, want = path(r), [30.0]
    for x in r[:-1]:
        want.append(5.0 + 0.08 * (100 * x - 0.1) ** 2 + 0.9 * want[-1])
    assert np.allclose(h, want, rtol=1e-13) and path([]) == []
    changed = r.copy()
    changed[300:] = 7
    assert path(changed)[:301] == h[:301]


def test_factorial_with_clashing_names(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 2, 2))
    rows = [(t, a, b, float(x[t, a, b])) for t in range(3) for a in range(2) for b in range(2)]
    df = spark.createDataFrame(rows, "value int, mean0 int, total int, v double").withColumnRenamed("total", "ss")
    got = {r.factor: r for r in factorial(df, ["value"], ["mean0", "ss"], F.col("v")).collect()}
    g = x.mean(axis=(1, 2), keepdims=True)
    first, second = x.mean(axis=2, keepdims=True) - g, x.mean(axis=1, keepdims=True) - g
    assert got["mean0"]["ss"] == pytest.approx(2 * (first**2).sum()) and got["ss"]["ss"] == pytest.approx(2 * (second**2).sum())
    assert sum(r.share for r in got.values()) == pytest.approx(1) and got["ss"].total == pytest.approx(((x - g) ** 2).sum())


def test_discard(spark):
    kept = io.stored(spark.range(3), "three")
    assert kept.count() == 3
    paths = list(io.MADE)
    assert io.discard(spark) >= 1 and not io.MADE and not any(Path(p).exists() for p in paths)


def test_matrix_refuses_gaps(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 4.0)], "t int, m string, v double")
    assert sorted(map(tuple, matrix(df, ["t"], "m", ["b", "a"], "v").collect())) == [(1, 2.0, 1.0), (2, 4.0, 3.0)]
    with pytest.raises(Exception, match="gap"):
        matrix(df.where("not (t = 2 and m = 'b')"), ["t"], "m", ["b", "a"], "v").collect()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1e-17)], "k long, v double")
    io.write_csv(df, f"{tmp_path}/a")
    assert sorted(io.read_csv(spark, f"{tmp_path}/a", "k long, v double").collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="exist"):
        io.write_csv(df, f"{tmp_path}/a")
    df.write.parquet(f"{tmp_path}/p1")
    df.withColumn("k", F.col("k") + 2).write.parquet(f"{tmp_path}/p2")
    assert sorted(r.k for r in io.merge_shards(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"], ["k"], 4).collect()) == [1, 2, 3, 4]
    io.write_csv(df, f"{tmp_path}/z", compressed=True)
    digests = spark.createDataFrame(io.file_digests(spark, f"{tmp_path}/z/*.gz").collect())
    lines = io.gunzipped(spark, f"{tmp_path}/z/*.gz", digests).where("value <> 'k,v'").collect()
    assert sorted(r.value.split(",")[0] for r in lines) == ["1", "2"]
    with pytest.raises(ValueError, match="digest differs"):
        io.gunzipped(spark, f"{tmp_path}/z/*.gz", digests.limit(0))
    with pytest.raises(ValueError, match="digest differs"):
        io.gunzipped(spark, f"{tmp_path}/z/*.gz", digests.union(spark.createDataFrame([("gone.gz", "0")], digests.schema)))
    file = next((tmp_path / "z").glob("*.gz"))
    held = bytearray(file.read_bytes())
    held[4] ^= 1  # the time stamp: the content would still inflate
    file.write_bytes(held)
    (tmp_path / "z" / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match=file.name):
        io.gunzipped(spark, f"{tmp_path}/z/*.gz", digests)
    with pytest.raises(ValueError):
        io.merge_shards(spark, [f"{tmp_path}/p1", f"{tmp_path}/p1"], ["k"])
    (tmp_path / "par.json").write_text('{"cutoff": "2000-12-29", "fits": [{"reference": "base", "nodes": ["s1", "s2"], "garch": [{"mu": 0.1}, {"mu": 0.2}]}]}')
    assert [(r.reference, r.node, r.mu) for r in io.read_parameters(spark, f"{tmp_path}/par.json").collect()] == [("base", "s1", 0.1), ("base", "s2", 0.2)]
    made = io.write_manifest(spark, f"{tmp_path}/m", {"df": df}, status="completed")
    assert made["tables"]["df"]["rows"] == 2 and io.lineage(df.orderBy(F.desc("k"))).first() == io.lineage(df).first()
    with pytest.raises(ValueError):
        io.write_manifest(spark, f"{tmp_path}/m2", {}, x=float("nan"))
    (tmp_path / "t.md").write_text("| a | b |\n| --- | --- |\n| 1 | x y |\n")
    assert [r.cells for r in io.read_pipe_table(spark, f"{tmp_path}/t.md").orderBy("line").collect()] == [["a", "b"], ["1", "x y"]]
    assert [r.row for r in io.pipe_rows(df.limit(1)).collect()] == ["| 1 | 0.3000 |"]


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="twice"):
        require_empty(duplicate_keys(df, "k"), "twice")
    require_empty(duplicate_keys(df.distinct(), "k"), "twice")


def test_normal_draws_and_sets():
    z = normal_draws(2000, 1)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and np.abs(np.corrcoef(z.T) - np.eye(8)).max() < 0.1
    assert (normal_draws(300, 1) == z[:300]).all() and not (normal_draws(300, 2) == z[:300]).any()
    a, b = 0.1 * z[:50, :4], 0.1 * z[:50, 4:]
    got = {(book, report): x for book, report, x in task_sets(a, b)}
    w = np.array((0.25, 0.25, 0.25, 0.25))
    want = (np.exp(a) @ w - 1) / np.exp(a[:, 0]) - (np.exp(a + b) @ w - 1) / np.exp(a + b)[:, 0]
    assert np.allclose(got["funded_assets", "s1"], np.sort(want), atol=1e-14)
