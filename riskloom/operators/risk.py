"""Realised outcomes, scenario losses, VaR/ES and scores."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import expected_shortfall, fz0, inverse_cdf, tail_residual, task_losses
from riskloom.operators.books import BOOKS, REPORTS
from riskloom.operators.ordered import framed
from riskloom.operators.panel import SERIES, columns, increments

TAUS = (Decimal("0.95"), Decimal("0.99"))
NOTIONAL = 100_000_000.0


def outcomes(panel: DataFrame, h: int = 1, books=BOOKS) -> DataFrame:
    """(t, d, start_d, target_d, book, report, actual_loss, reference_notional, q0..q4): fixed quantities bought at t, lost from t + 1 to t + 1 + h, in reported units of t."""
    ahead = lambda w: [F.lead("d", 1).over(w).alias("start_d"), F.lead("d", 1 + h).over(w).alias("target_d"), *[F.lead(f"p{k}", n).over(w).alias(f"{x}{k}") for k in SERIES for x, n in (("u", 1), ("v", 1 + h))]]
    at = framed(panel.select("t", "d", *[f"p{k}" for k in SERIES]), ahead, after=1 + h).where(F.col("target_d").isNotNull())
    tasks = []
    for book, (base, weights) in books.items():
        q = [F.lit(NOTIONAL * base), *[F.lit(NOTIONAL * w) / F.col(f"p{k}") for k, w in zip(SERIES, weights, strict=True)]]
        value = lambda x, q=q: sum((q[k] * F.col(f"{x}{k}") for k in SERIES), q[0])
        for report, n in REPORTS.items():
            p, u, v = (F.col(f"{x}{n}") if n else F.lit(1.0) for x in "puv")
            notional = F.lit(NOTIONAL) / p
            tasks.append(F.struct(F.lit(book).alias("book"), F.lit(report).alias("report"), ((value("u") / u - value("v") / v) / notional).alias("actual_loss"), notional.alias("reference_notional"), *[x.alias(f"q{k}") for k, x in enumerate(q)]))
    return at.select("t", "d", "start_d", "target_d", F.explode(F.array(*tasks)).alias("x")).select("t", "d", "start_d", "target_d", "x.*")


def realised(returns: DataFrame, h: int = 1) -> DataFrame:
    """(t, book, report, actual): the same outcome from log increments."""
    return priced(returns, h).select(F.col("s").alias("t"), "book", "report", F.col("loss").alias("actual"))


def window_of(value: Column, rows: int, *keys: str, until: int = 0) -> Column:
    """Array of the values of the last ``rows`` rows of a group in order of s, the one ``until`` rows before the last; null before there are as many."""
    w = Window.partitionBy(*keys).orderBy("s").rowsBetween(1 - rows - until, -until)
    return F.when(F.count("*").over(w) == rows, F.collect_list(value).over(w))


def priced(returns: DataFrame, h: int = 1) -> DataFrame:
    """(s, book, report, loss): each task's loss over the increments of row s and the h that follow."""
    return increments(returns, h).select("s", F.explode(task_losses(columns("a"), columns("b"))).alias("x")).select("s", "x.*")


def historical_sets(returns: DataFrame, window: int, h: int = 1) -> DataFrame:
    """(t, book, report, x): each task's losses, ascending, under the window - h increments known at t.

    Losses of past increments do not depend on the origin, so they are priced once
    and an origin takes a sliding array of them: one shuffle of a row a (date, task).
    """
    slid = priced(returns, h).select((F.col("s") + h + 1).alias("t"), "book", "report", window_of(F.col("loss"), window - h, "book", "report").alias("x"))
    return slid.where(F.col("x").isNotNull()).withColumn("x", F.sort_array("x"))


def sets(losses: DataFrame, *keys: str) -> DataFrame:
    """(keys, x): losses of each group, ascending. A group is one scenario set, whose size the window or the number of draws bounds."""
    return losses.groupBy(*keys).agg(F.sort_array(F.collect_list("loss")).alias("x"))


def pooled(*frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, x): the mixture of the scenario sets of each key, that is all their losses together."""
    out = frames[0].select(*keys, "x")
    for f in frames[1:]:
        out = out.unionAll(f.select(*keys, "x"))
    return out.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))


def var_es(scenarios: DataFrame, keys: list[str], taus=TAUS) -> DataFrame:
    """keys, n, tau, var, es: empirical VaR and fractional-tail ES of each set (keys, x)."""
    told = scenarios.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("var", inverse_cdf(F.col("x"), F.col("tau")))
    return told.select(*keys, F.size("x").cast("long").alias("n"), "tau", "var", expected_shortfall(F.col("x"), F.col("var"), F.col("tau")).alias("es"))


def weighted_var_es(scenarios: DataFrame, keys: list[str], taus=TAUS) -> DataFrame:
    """keys, tau, var, es of sets (keys, x: array<struct<loss, s, w>>, ascending) whose weights w sum to one: var is the smallest loss whose running weight reaches tau."""
    told = scenarios.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("var"))

    def step(state: Column, x: Column) -> Column:
        run = state["run"] + x["w"]
        return F.struct(run.alias("run"), F.coalesce(state["var"], F.when(F.round(run, 12) >= F.col("tau").cast("double"), x["loss"])).alias("var"))

    told = told.withColumn("var", F.aggregate("x", start, step, lambda s: s["var"]))
    excess = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["w"] * F.greatest(x["loss"] - F.col("var"), F.lit(0.0)))
    return told.select(*keys, "tau", "var", (F.col("var") + excess / (1 - F.col("tau").cast("double"))).alias("es"))


def scored(forecasts: DataFrame, actual: DataFrame, on=("t", "book", "report")) -> DataFrame:
    """Forecasts with actual, hit, tail_residual and score; those outside the score's domain are left out."""
    j = forecasts.join(actual, list(on))
    y, q, e, tau = (F.col(c) for c in ("actual", "var", "es", "tau"))
    out = j.withColumn("hit", (y > q).cast("int")).withColumn("tail_residual", tail_residual(y, q, e, tau)).withColumn("score", fz0(y, q, e, tau))
    return out.where(F.col("score").isNotNull())
