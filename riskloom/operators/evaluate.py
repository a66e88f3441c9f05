"""Grouped evaluation of forecasts: summaries, ranks, dispersion, calibration and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh, inverse_cdf, tail_place
from riskloom.operators.selection import with_quantiles
from riskloom.sources.io import stored


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    """Dates, tasks, mean score, breach rate, mean VaR and ES, and median ES of each group. Scores are made once and read from the shared folder; no task holds a group's values."""
    rows = stored(scores.select(*dict.fromkeys([*keys, "t", "score", "hit", "var", "es"])), "scores")
    told = rows.groupBy(*keys).agg(
        F.count_distinct("t").alias("n_dates"),
        F.count("*").alias("n_tasks"),
        F.avg("score").alias("mean_score"),
        F.avg("hit").alias("breach_rate"),
        F.avg("var").alias("mean_var"),
        F.avg("es").alias("mean_es"),
    )
    return with_quantiles(told, rows, keys, {"median_es": ("es", 0.5)})


def competition_rank(df: DataFrame, value: str, *within: str) -> DataFrame:
    """df with rank: 1 + the number of smaller values in the group, ties sharing the smallest."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(value)).cast("long"))


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key over its members: range, mean absolute value, their ratio (null where the mean is 0), and max over min."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(v) - F.min(v)).alias("span"), F.avg(F.abs(v)).alias("mean_abs"), F.max(v).alias("high"), F.min(v).alias("low"))
    ratio = F.when(F.col("mean_abs") > 0, F.col("span") / F.col("mean_abs"))
    return g.select(*keys, "n", "span", "mean_abs", ratio.alias("relative"), F.when(F.col("low") != 0, F.col("high") / F.col("low")).alias("max_over_min"))


def pair_contrasts(df: DataFrame, keys: Sequence[str], member: str, value: str, scale_member: str) -> DataFrame:
    """(keys, a, b, contrast): signed difference of every unordered pair of members, over the absolute value of the scale member. Members of a key are few; pairs come from one array a key."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).alias("v")))).alias("x"), F.max(F.when(F.col(member) == scale_member, F.abs(F.col(value)))).alias("scale"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["m"] > a["m"]), lambda b: F.struct(a["m"].alias("a"), b["m"].alias("b"), (a["v"] - b["v"]).alias("d")))))
    p = g.where("scale > 0").select(*keys, "scale", F.explode(pairs).alias("p"))
    return p.select(*keys, "p.a", "p.b", (F.col("p.d") / F.col("scale")).alias("contrast"))


def pit(scenarios: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mid-distribution PIT of the outcome in its scenario set x, both one-sided values, and whether it lies outside their range."""
    x, y = F.col("x"), F.col("actual")
    share = lambda keep: F.size(F.filter(x, keep)) / F.size(x)
    g = scenarios.join(actual, list(keys)).select(*keys, share(lambda v: v < y).alias("cdf_left"), share(lambda v: v <= y).alias("cdf_right"), (y < F.element_at(x, 1)).cast("int").alias("below_support"), (y > F.element_at(x, -1)).cast("int").alias("above_support"))
    return g.select(*keys, ((F.col("cdf_left") + F.col("cdf_right")) / 2).alias("pit"), "cdf_left", "cdf_right", "below_support", "above_support")


def decile(x: Column) -> Column:
    """0 to 9; 1 belongs to the last."""
    edges = [F.when(x >= k / 10, 1).otherwise(0) for k in range(1, 10)]
    return sum(edges[1:], edges[0])


def ks_distance(df: DataFrame, value: str, *within: str) -> DataFrame:
    """Largest distance between the empirical distribution of value and the uniform one."""
    w = Window.partitionBy(*within)
    r = df.select(*within, F.col(value).alias("u"), F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    return r.groupBy(*within).agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n"))).alias("ks"))


def tail_leverage(scenarios: DataFrame, keys: Sequence[str], taus) -> DataFrame:
    """Largest scenario loss and its share of all excess over VaR (0 without excess), from each set x itself."""
    told = scenarios.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("var", inverse_cdf(F.col("x"), F.col("tau")))
    high = F.element_at("x", -1)
    every = F.aggregate(F.slice("x", tail_place(F.col("x"), F.col("tau")), F.size("x")), F.lit(0.0), lambda s, v: s + (v - F.col("var")))
    return told.select(*keys, "tau", high.alias("maximum_loss"), F.when(every > 0, (high - F.col("var")) / every).otherwise(0.0).alias("share"), F.size("x").cast("long").alias("n"))


def wasserstein(scenarios: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """(keys, a, b, w1): mean distance of order statistics between the sets x of members with equally many values. Members of a key are few."""
    p = scenarios.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), "x"))).alias("g"))
    pairs = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: (b["m"] > a["m"]) & (F.size(b["x"]) == F.size(a["x"]))), lambda b: F.struct(a["m"].alias("a"), b["m"].alias("b"), F.aggregate(F.zip_with(a["x"], b["x"], lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v).alias("gap"), F.size(a["x"]).alias("n")))))
    e = p.select(*keys, F.explode(pairs).alias("p"))
    return e.select(*keys, "p.a", "p.b", (F.col("p.gap") / F.col("p.n")).alias("w1"))


def factorial(df: DataFrame, cell: Sequence[str], factors: Sequence[str], value: Column, *scope: str) -> DataFrame:
    """(scope, factor, ss, total, share): sums of squares of every main effect and interaction within each cell.

    A cell holds a full grid of factor levels. An effect is the margin's mean less
    all effects of smaller margins, by inclusion and exclusion over window means.
    """
    margins = [m for n in range(len(factors) + 1) for m in combinations(factors, n)]
    (at,) = fresh(df, "value")
    named = dict(zip(margins, fresh(df, *(f"mean{k}" for k in range(len(margins)))), strict=True))
    x = df.select(*cell, *factors, *[c for c in scope if c not in cell], value.alias(at))
    for m in margins:
        x = x.withColumn(named[m], F.avg(at).over(Window.partitionBy(*cell, *m)))
    mean = lambda m: F.col(named[m])
    effects = {}
    for m in margins[1:]:
        terms = [((-1) ** (len(m) - n), s) for n in range(len(m) + 1) for s in combinations(m, n)]
        effects[" x ".join(m)] = sum((F.lit(float(sign)) * mean(s) for sign, s in terms[1:]), F.lit(float(terms[0][0])) * mean(terms[0][1]))
    total = F.sum(F.pow(F.col(at) - mean(()), 2))
    each = F.array(*[F.struct(F.lit(n).alias("factor"), F.sum(e * e).alias("ss")) for n, e in effects.items()])
    g = x.groupBy(*scope).agg(total.alias("total"), each.alias("effects"))
    return g.select(*scope, "total", F.explode("effects").alias("e")).select(*scope, "e.factor", "e.ss", "total", F.when(F.col("total") > 0, F.col("e.ss") / F.col("total")).alias("share"))


def known_lag(scores: DataFrame, value: str, lag: int, *within: str) -> DataFrame:
    """scores with known_<value>: the value of the origin ``lag`` rows before, whose target is complete at this origin."""
    return scores.withColumn(f"known_{value}", F.lag(value, lag).over(Window.partitionBy(*within).orderBy("t")))


def hac_covariances(df: DataFrame, values: Sequence[str], lags: int, *within: str) -> DataFrame:
    """(within, n, mean_<value>, cov_<value>_<value>): Bartlett-weighted long-run covariances of the means, divided by n.

    Bartlett weights over lags are what sums over lags + 1 neighbouring values
    give when they are multiplied and added up, with zeros before the first and
    after the last value: two running sums instead of a term a lag.
    """
    w = Window.partitionBy(*within)
    z = df.select(*within, "t", *[F.col(v).cast("double").alias(v) for v in values])
    z = z.select(*within, "t", *[F.avg(v).over(w).alias(f"mean_{v}") for v in values], *[(F.col(v) - F.avg(v).over(w)).alias(f"z_{v}") for v in values])
    near, rest = w.orderBy("t").rowsBetween(-lags, 0), w.orderBy("t").rowsBetween(0, lags)  # all that is left, for the last rows
    last = F.count("*").over(rest) <= lags
    sums = z.select(*within, *[f"mean_{v}" for v in values], *[F.sum(f"z_{v}").over(near).alias(f"near_{v}") for v in values], *[F.when(last, F.sum(f"z_{v}").over(rest)).otherwise(0.0).alias(f"tail_{v}") for v in values])
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k:]]
    each = [(F.sum(F.col(f"near_{a}") * F.col(f"near_{b}") + F.col(f"tail_{a}") * F.col(f"tail_{b}")) / (lags + 1) / F.count("*") / F.count("*")).alias(f"cov_{a}_{b}") for a, b in pairs]
    return sums.groupBy(*within).agg(F.count("*").alias("n"), *[F.first(f"mean_{v}").alias(f"mean_{v}") for v in values], *each)


def hac_variance(df: DataFrame, value: str, lags: int, *within: str) -> DataFrame:
    """(within, n, mean, variance) of one value."""
    g = hac_covariances(df, [value], lags, *within)
    return g.select(*within, "n", F.col(f"mean_{value}").alias("mean"), F.col(f"cov_{value}_{value}").alias("variance"))
