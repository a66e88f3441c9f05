"""Reconciliation of two tables that should say the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh


def reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], scope: Sequence[str] = (), absolute: float = 1e-12, relative: float = 1e-9) -> DataFrame:
    """(scope, column, matched, only_left, only_right, repeated, nulls_differ, max_abs, max_rel, within) of each column, over a full outer join by keys.

    repeated: key values that either side has more than once; they are compared by
    their smallest and largest values together. max_rel is over the larger size of both values. within: every
    key is matched once, nulls agree, and each gap keeps the absolute or the relative bound. scope: some of the keys.
    Null keys match each other. Gaps of infinite values are infinite unless both are the same.
    """
    here, there = fresh(left.select(*scope), "here", "there")

    def sided(df: DataFrame, mark: str) -> DataFrame:
        ends = [F.struct(F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high"), F.count(v).alias("n")).alias(f"v{k}") for k, v in enumerate(values)]
        g = df.groupBy(F.struct(*keys).alias("k")).agg(F.struct(F.count("*").alias("times"), *ends).alias("v"))
        return g.select(F.struct("k", "v").alias(mark))

    a, b = sided(left, here), sided(right, there)
    same = [F.col(f"{here}.k.{k}").eqNullSafe(F.col(f"{there}.k.{k}")) for k in keys]
    j = a.join(b, same, "full")
    each = []
    for k, v in enumerate(values):
        p, q = F.col(f"{here}.v.v{k}"), F.col(f"{there}.v.v{k}")
        pair = lambda s, t: F.when(s == t, 0.0).otherwise(F.abs(s - t))
        gap = F.greatest(pair(p["low"], q["low"]), pair(p["high"], q["high"]), pair(p["low"], q["high"]), pair(p["high"], q["low"]))
        size = F.greatest(F.abs(p["low"]), F.abs(p["high"]), F.abs(q["low"]), F.abs(q["high"]))
        each.append(F.struct(F.lit(v).alias("column"), gap.alias("gap"), F.when(size > 0, gap / size).otherwise(0.0).alias("ratio"), ((p["n"] > 0) != (q["n"] > 0)).alias("null")))
    often = F.greatest(F.col(f"{here}.v.times"), F.col(f"{there}.v.times")) > 1
    rows = j.select(*[F.coalesce(F.col(f"{here}.k.{k}"), F.col(f"{there}.k.{k}")).alias(k) for k in scope], F.col(here).isNotNull().alias(here), F.col(there).isNotNull().alias(there), F.explode(F.array(*each)).alias("x"), often.alias("often"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = F.col(here) & F.col(there)
    wide = both & (F.col("x.gap") > absolute) & (F.col("x.ratio") > relative)
    g = rows.groupBy(*scope, F.col("x.column").alias("column")).agg(
        count(both).alias("matched"), count(F.col(here) & ~F.col(there)).alias("only_left"), count(F.col(there) & ~F.col(here)).alias("only_right"), count(F.col("often")).alias("repeated"), count(both & F.col("x.null")).alias("nulls_differ"),
        F.max(F.when(both, F.col("x.gap"))).alias("max_abs"), F.max(F.when(both, F.col("x.ratio"))).alias("max_rel"), count(wide).alias("wide"),
    )
    return g.select(*[c for c in g.columns if c != "wide"], (F.col("only_left") + F.col("only_right") + F.col("repeated") + F.col("nulls_differ") + F.col("wide") == 0).alias("within"))
