"""Tables the named queries share: panel, increments, forecasts and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.panel import log_returns, price_panel
from riskloom.operators.risk import historical_sets, realised, scored, var_es
from riskloom.plans.sql import WINDOWS

KEYS = ["t", "book", "report"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    return price_panel(read(spark, sf_dir, "lineitem"), bucket)


def returns(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    return log_returns(panel(spark, sf_dir, bucket))


def forecasts(spark: SparkSession, sf_dir: str, windows=WINDOWS) -> DataFrame:
    """(model, t, book, report, n, tau, var, es) of historical simulation over each window."""
    r = returns(spark, sf_dir)
    each = [var_es(historical_sets(r, w), KEYS).select(F.lit(f"HS{w}").alias("model"), "*") for w in windows]
    return reduce(DataFrame.unionByName, each)


def scores(spark: SparkSession, sf_dir: str, windows=WINDOWS) -> DataFrame:
    return scored(forecasts(spark, sf_dir, windows), realised(returns(spark, sf_dir)))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with their origin date."""
    return scores(spark, sf_dir).join(panel(spark, sf_dir).select("t", "d"), "t")
