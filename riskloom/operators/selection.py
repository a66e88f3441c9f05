"""Exact order statistics of groups of any size.

A group's order statistic is looked for in a bucket of it: approximate quantiles
cut every group into buckets, one pass counts them, and only the rows of the bucket
that holds the rank go on, with the rank within it. After a few rounds what is left is
sorted. Equal values are counted, not kept. No task holds a group, and counts alone cross the rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh, place_among


def ranked_values(rows: DataFrame, wanted: DataFrame, rounds: int, cuts: int) -> DataFrame:
    """(key, rank, v) of each wanted (key, rank), ranks from 0, among rows (key, v)."""
    if not rounds:
        counted = rows.groupBy("key", "v").agg(F.count("*").alias("size"))
        run = counted.withColumn("until", F.sum("size").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        j = run.join(wanted, "key").where((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("size")))
        return j.select("key", "rank", "v")
    parts = [k / cuts for k in range(1, cuts)]
    marks = rows.groupBy("key").agg(F.array_distinct(F.percentile_approx("v", parts, 10 * cuts)).alias("marks"))
    dealt = rows.join(marks, "key").select(F.struct("key", place_among(F.col("marks"), F.col("v"), cuts).alias("bucket")).alias("bucket"), "v")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).withColumn("key", F.col("bucket.key"))
    run = sizes.withColumn("until", F.sum("size").over(Window.partitionBy("key").orderBy("bucket.bucket").rowsBetween(Window.unboundedPreceding, 0)))  # at most cuts rows a key
    found = run.join(wanted, "key").where((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("size")))
    inner = found.select("bucket", "rank", (F.col("rank") - F.col("until") + F.col("size")).alias("inside"))
    live = dealt.join(inner.select("bucket").distinct(), "bucket", "left_semi").withColumnRenamed("bucket", "key")
    values = ranked_values(live, inner.select(F.col("bucket").alias("key"), F.col("inside").alias("rank")).distinct(), rounds - 1, cuts)
    told = inner.join(values.select(F.col("key").alias("bucket"), F.col("rank").alias("inside"), "v"), ["bucket", "inside"])
    return told.select(F.col("bucket.key").alias("key"), "rank", "v")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], rounds: int = 1, cuts: int = 256) -> DataFrame:
    """(keys, level, n, quantile): quantiles between order statistics, as percentile() gives them; nulls do not count, a group without values has no row.

    rounds: how often buckets are cut again; each leaves about one row in ``cuts`` of a group. Null keys are a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("none"), *keys).alias("key"), F.col(value).cast("double").alias("v"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    place = counts.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("at", F.col("level") * (F.col("n") - 1))
    ends = place.withColumn("low", F.floor("at")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    wanted = ends.select("key", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = ranked_values(rows, wanted, rounds, cuts)
    low, high = (values.select("key", F.col("rank").alias(e), F.col("v").alias(f"v_{e}")) for e in ("low", "high"))
    j = ends.join(low, ["key", "low"]).join(high, ["key", "high"])
    between = F.col("v_low") + (F.col("at") - F.col("low")) * (F.col("v_high") - F.col("v_low"))
    quantile = F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise(between)
    return j.select(*[F.col("key")[k].alias(k) for k in keys], "level", "n", quantile.alias("quantile"))


def with_quantiles(grouped: DataFrame, rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], rounds: int = 1, cuts: int = 256) -> DataFrame:
    """grouped, a row a group of keys, with a column for each name of ``wanted``: name -> (value, level), that exact quantile of the group's rows.

    Null where a group has no value; null keys are a group. rows are read several times: store them first if they are costly.
    """
    (at,) = fresh(grouped, "key")
    group = F.struct(F.lit(0).alias("none"), *keys).alias(at)
    out = grouped.select("*", group)
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        mine = {name: float(x) for name, (v, x) in wanted.items() if v == value}
        found = exact_quantiles(rows, keys, value, sorted(set(mine.values())), rounds, cuts)
        wide = found.groupBy(group).agg(*[F.max(F.when(F.col("level") == x, F.col("quantile"))).alias(name) for name, x in mine.items()])
        out = out.join(wide, at, "left")
    return out.drop(at)
