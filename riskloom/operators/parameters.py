"""Tables of yearly parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh


def upper_triangle(df: DataFrame, keys: Sequence[str], nodes: str, matrix: str, value: str = "value") -> DataFrame:
    """(keys, node_i, node_j, value): entries above the diagonal of a nested matrix whose rows and columns are the array ``nodes``. Ragged rows give what they have; a null matrix gives none."""
    names, i, j, row, cell = fresh(df, "names", "i", "j", "row", "cell")
    rows = df.select(*keys, F.col(nodes).alias(names), F.posexplode(matrix).alias(i, row))
    cells = rows.select(*keys, names, i, F.posexplode(row).alias(j, cell)).where(F.col(i) < F.col(j))
    name = lambda k: F.try_element_at(names, F.col(k) + 1)
    return cells.select(*keys, name(i).alias("node_i"), name(j).alias("node_j"), F.col(cell).alias(value))


def persistence(parameters: DataFrame) -> DataFrame:
    """parameters (omega, alpha, beta, ...) with persistence, alpha + beta, and the long-run variance, null where persistence is 1 or more."""
    told = parameters.withColumn("persistence", F.col("alpha") + F.col("beta"))
    return told.withColumn("long_run_variance", F.when(F.col("persistence") < 1, F.col("omega") / (1 - F.col("persistence"))))


def spread(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, <value>_min, _median, _max of each value)."""
    return df.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("median", F.median), ("max", F.max))])
