"""Reshapes, samples of the calendar, and checks of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.books import REFERENCES, basis
from riskloom.operators.joins import refused


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises if there is any row."""
    if rows := violations.take(3):
        raise ValueError(f"{what}: {rows}")


def matrix(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str) -> DataFrame:
    """(keys, a column a name): mean values side by side, in the order given; the job fails at the first gap."""
    wide = df.groupBy(*keys).pivot(column, list(names)).agg(F.avg(value))
    gap = F.greatest(*[F.col(f"`{n}`").isNull() for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`").isNull()
    return refused(wide, gap, f"{column} by {', '.join(keys)} has a gap")


def basis_long(returns: DataFrame) -> DataFrame:
    """(t, reference, node, r): log increments of every node in every reference frame."""
    each = []
    for ref in REFERENCES:
        for node, c in basis(ref):
            r = sum((F.lit(float(x)) * F.col(f"r{k}") for k, x in enumerate(c, 1)), F.lit(0.0))
            each.append(F.struct(F.lit(ref).alias("reference"), F.lit(node).alias("node"), r.alias("r")))
    return returns.select("t", F.explode(F.array(*each)).alias("x")).select("t", "x.*")


def monthly_middle(calendar: DataFrame) -> DataFrame:
    """The row in the middle of each month: number n div 2, counted from 0."""
    m = Window.partitionBy(F.year("d"), F.month("d"))
    n = calendar.select("t", "d", F.row_number().over(m.orderBy("t")).alias("rn"), F.count("*").over(m).alias("n"))
    return n.where(F.expr("rn = n div 2 + 1")).select("t", "d")


def yearly_stride(calendar: DataFrame, per_year: int) -> DataFrame:
    """About per_year evenly spaced rows of each year, its first included."""
    y = Window.partitionBy(F.year("d"))
    n = calendar.select("t", "d", F.row_number().over(y.orderBy("t")).alias("rn"), F.count("*").over(y).alias("n"))
    return n.where(F.expr(f"(rn - 1) % greatest(n div {per_year}, 1) = 0")).select("t", "d")


def every_nth(calendar: DataFrame, n: int) -> DataFrame:
    """Every n-th row of the calendar, the first included."""
    return calendar.where((F.col("t") - 1) % n == 0).select("t", "d")


def yearly_ends(calendar: DataFrame) -> DataFrame:
    """First, middle (number n div 2, from 0) and last row of each year."""
    y = Window.partitionBy(F.year("d"))
    n = calendar.select("t", "d", F.row_number().over(y.orderBy("t")).alias("rn"), F.count("*").over(y).alias("n"))
    return n.where(F.expr("rn in (1, n div 2 + 1, n)")).select("t", "d")


def evenly_spaced(calendar: DataFrame, k: int) -> DataFrame:
    """k rows from the first to the last, their distances as equal as whole numbers allow (rounded down)."""
    last = calendar.agg(F.max("t").alias("last"))
    places = last.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "last").select((F.floor(F.col("i") * (F.col("last") - 1) / (k - 1)) + 1).alias("t")).distinct()
    return calendar.join(F.broadcast(places), "t").select("t", "d")  # k rows


def listed(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """The rows whose day is listed."""
    return calendar.join(days, "d", "left_semi").select("t", "d")


def eligible(calendar: DataFrame, window: int, h: int, first_year: int, last_year: int) -> DataFrame:
    """Origins with a full window before them and their endpoint in the panel, in the years given."""
    last = calendar.agg(F.max("t").alias("last"))
    return calendar.join(F.broadcast(last)).where((F.col("t") > window) & (F.col("t") + 1 + h <= F.col("last")) & F.year("d").between(first_year, last_year)).select("t", "d")


def pseudo_observations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df with u_<col>: the rank of each value, ties averaged, over one more than the number of rows."""
    out, total = df, df.agg(F.count("*").alias("rows"))
    for c in cols:
        out = out.withColumn(f"u_{c}", F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    return out.join(F.broadcast(total)).select(*df.columns, *[(F.col(f"u_{c}") / (F.col("rows") + 1)).alias(f"u_{c}") for c in cols])
