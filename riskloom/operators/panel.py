"""From long observations to a complete-case panel, its clock, and log increments.

Aggregation to (bucket, series) is the only step whose input grows with the raw
table: it is a partial aggregate over the scan's few columns. All that follows
works on one row a bucket, numbered by years and then taken in spans of its
numbers, so no task holds the whole calendar, however fine its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import framed, numbered

SERIES = (1, 2, 3, 4)


def clean(obs: DataFrame, value: str, status: str | None = None, accept: str = "A", last: str | None = None, date: str = "d") -> DataFrame:
    """Positive values of the accepted status, up to the date last, which counts."""
    kept = obs.where(F.col(value) > 0)
    kept = kept.where(F.col(status) == accept) if status else kept
    return kept.where(F.col(date) <= F.lit(last).cast("date")) if last else kept


def unit_prices(lineitem: DataFrame, bucket: str = "day") -> DataFrame:
    """(d, k, px): average unit price of line number k = 1..4 in each day or week (its Monday)."""
    d = F.col("l_shipdate").cast("date") if bucket == "day" else F.date_trunc(bucket, "l_shipdate").cast("date")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    kept = lineitem.where(F.col("l_linenumber").between(1, 4) & (F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0))
    return kept.groupBy(d.alias("d"), F.col("l_linenumber").alias("k")).agg((exact("l_extendedprice") / exact("l_quantity")).alias("px"))


def pivot_panel(long: DataFrame, key: str = "d", series: str = "k", value: str = "px", names: Sequence[int] = SERIES) -> DataFrame:
    """One row a key with a column p<name> a series; gaps are null."""
    wide = long.groupBy(key).pivot(series, list(names)).agg(F.first(value))
    return wide.select(key, *[F.col(str(n)).alias(f"p{n}") for n in names])


def complete_case(wide: DataFrame, key: str = "d") -> DataFrame:
    """Rows without a gap, numbered t = 1, 2, ... in order of the key, a date."""
    return numbered(wide.dropna(), key, F.year(key))


def price_panel(lineitem: DataFrame, bucket: str = "day") -> DataFrame:
    """(t, d, p1..p4)."""
    return complete_case(pivot_panel(unit_prices(lineitem, bucket)))


def log_returns(panel: DataFrame) -> DataFrame:
    """(t, d, r1..r4): log increments from row t to t + 1, which are not known at t; the last row has none and is left out."""
    out = framed(panel, lambda w: [F.log(F.lead(f"p{k}", 1).over(w) / F.col(f"p{k}")).alias(f"r{k}") for k in SERIES], after=1)
    return out.where(F.col("r1").isNotNull()).select("t", "d", *[f"r{k}" for k in SERIES])


def rolling_sum(returns: DataFrame, h: int) -> DataFrame:
    """(t, h1..h4): increments of the rows t + 1 to t + h together; rows without h successors are left out."""
    summed = framed(returns, lambda w: [F.count("*").over(w.rowsBetween(1, h)).alias("n"), *[F.sum(f"r{k}").over(w.rowsBetween(1, h)).alias(f"h{k}") for k in SERIES]], after=h)
    return summed.where(F.col("n") == h).select("t", *[f"h{k}" for k in SERIES])


def increments(returns: DataFrame, h: int = 1) -> DataFrame:
    """(s, a1..a4, b1..b4): the increment of row s and the sum of the h that follow it."""
    summed = framed(returns, lambda w: [F.count("*").over(w.rowsBetween(1, h)).alias("n"), *[F.sum(f"r{k}").over(w.rowsBetween(1, h)).alias(f"b{k}") for k in SERIES]], after=h)
    return summed.where(F.col("n") == h).select(F.col("t").alias("s"), *[F.col(f"r{k}").alias(f"a{k}") for k in SERIES], *[f"b{k}" for k in SERIES])


def history(pairs: DataFrame, window: int, h: int = 1, key: str = "s") -> DataFrame:
    """Each row s under every origin t whose window of ``window`` known increments holds it: s + h + 1 <= t <= s + window, t > window.

    A rolling-history join without a join: a row generates its origins, window - h of them.
    """
    out = pairs.withColumn("t", F.explode(F.sequence(F.col(key) + h + 1, F.col(key) + window)))
    return out.where(F.col("t") > window)


def columns(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in SERIES]
