"""Tests of forecasts against their outcomes: breach rates, identification of ES, and both given what was known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import chi2_tail, quadratic_form
from riskloom.operators.evaluate import hac_covariances, known_lag

#: Instruments that are known at an origin: a constant, the last completed breach, the size of the forecast.
INSTRUMENTS = ("one", "lag", "size")
#: p-values are withheld below so many breaches.
LEAST_BREACHES = 30


def moments(scores: DataFrame, *task: str) -> DataFrame:
    """(task, t, hit, h, u, and h and u times each instrument): h the breach less its probability, u the tail residual over ES.

    Products with the last completed breach, that of two origins before, are null at
    a task's first two origins.
    """
    rows = known_lag(scores, "hit", 2, *task)
    alpha = 1 - F.col("tau").cast("double")
    h, u = F.col("hit") - alpha, F.col("tail_residual") / F.col("es")
    known = {"one": F.lit(1.0), "lag": F.col("known_hit") - alpha, "size": F.log("es")}
    return rows.select(*task, "t", F.col("hit").cast("double").alias("hit"), h.alias("h"), u.alias("u"), *[(m * known[i]).alias(f"{n}_{i}") for n, m in (("h", h), ("u", u)) for i in INSTRUMENTS])


def wald(g: DataFrame, keep: Sequence[str], tests: dict[str, Sequence[str]], breaches: str) -> DataFrame:
    """(keep, and for each test <name>_statistic, _rank and _p that the means of its values are all zero) from g's long-run covariances: null where they are singular, _p also where breaches are too few.

    Each stage is a projection of its own, so that no expression is worked out again inside the next.
    """
    forms = []
    for name, values in tests.items():
        cov = {(i, j): F.col(f"cov_{a}_{b}") for i, a in enumerate(values) for j, b in enumerate(values) if i <= j}
        rank, form = quadratic_form([F.col(f"mean_{v}") for v in values], cov)
        forms += [rank.cast("long").alias(f"{name}_rank"), form.alias(f"{name}_statistic")]
    told = g.select(*keep, breaches, *forms)
    tails = {f"{name}_p": F.when(F.col(breaches) >= LEAST_BREACHES, chi2_tail(F.col(f"{name}_statistic"), len(values))) for name, values in tests.items()}
    return told.withColumns(tails)


def calibration_table(scores: DataFrame, task: Sequence[str], lags: int) -> DataFrame:
    """One row a task: breaches against their expectation, the breach rate and mean of u with 1.96 standard errors either way, and Wald tests with Bartlett-weighted covariances over ``lags``.

    joint: the means of h and u (two degrees of freedom). conditional: of h times
    each instrument (three). conditional_joint: of both times each (six). The
    conditional ones take the conditional_n rows whose last completed breach is known.
    """
    m = moments(scores, *task)
    plain = hac_covariances(m, ["h", "u"], lags, *task)
    products = [f"{n}_{i}" for n in "hu" for i in INSTRUMENTS]
    given = hac_covariances(m.where(F.col("h_lag").isNotNull()), products, lags, *task)
    sums = m.groupBy(*task).agg(F.sum("hit").cast("long").alias("breaches"), F.avg("hit").alias("breach_rate"))
    breaches, alpha = F.col("breaches"), 1 - F.col("tau").cast("double")
    band = lambda mean, v: [(mean + F.lit(x * 1.96) * F.sqrt(F.greatest(v, F.lit(0.0)))) for x in (-1.0, 1.0)]
    rate, use = band(F.col("breach_rate"), F.col("cov_h_h")), band(F.col("mean_u"), F.col("cov_u_u"))
    facts = {"expected": alpha * F.col("n"), "rate_low": rate[0], "rate_high": rate[1], "es_mean": F.col("mean_u"), "es_low": use[0], "es_high": use[1]}
    first = wald(plain.join(sums, list(task)).withColumns(facts), [*task, "n", "breach_rate", *facts], {"joint": ["h", "u"]}, "breaches")
    second = wald(given.withColumnRenamed("n", "conditional_n").join(sums, list(task)), [*task, "conditional_n"], {"conditional": products[:3], "conditional_joint": products}, "breaches")
    return first.join(second.drop("breaches"), list(task), "left").withColumn("sparse", breaches < LEAST_BREACHES)
