"""Ordered work without one ordered task: numbering, frames of rows, recursions over long series.

Rows are dealt into spans of their order. What crosses from one span to the next is
small: how many rows came before, the rows a frame reaches, or the state of a
recursion. Spans are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh

#: Rows of a span, and of a piece of a recursion.
SPAN, PIECE = 1024, 256


def numbered(df: DataFrame, key: str, bucket: Column, name: str = "t") -> DataFrame:
    """df with name: 1, 2, ... in order of the key, first among the columns.

    bucket: anything that never falls as the key rises, such as the year of a date.
    Rows are numbered within their bucket, and a bucket's number starts behind
    those before it; only the table of buckets, a row each, is compared with itself. Null keys come first if their bucket is null. Equal keys are numbered in any order.
    """
    b, rank, before = fresh(df, "bucket", "rank", "before")
    rows = df.withColumn(b, bucket)
    sizes = rows.groupBy(b).agg(F.count("*").alias("size"))
    mine, other = sizes.select(b), sizes.select(F.col(b).alias("earlier"), "size")
    precedes = (F.col("earlier") < F.col(b)) | (F.col("earlier").isNull() & F.col(b).isNotNull())
    starts = mine.join(F.broadcast(other), precedes, "left").groupBy(b).agg(F.coalesce(F.sum("size"), F.lit(0)).alias(before)).withColumnRenamed(b, f"{b}_of")  # a row a bucket
    local = rows.withColumn(rank, F.row_number().over(Window.partitionBy(b).orderBy(key)))
    joined = local.join(F.broadcast(starts), F.col(b).eqNullSafe(F.col(f"{b}_of")))
    return joined.select((F.col(before) + F.col(rank)).cast("long").alias(name), *df.columns)


def framed(df: DataFrame, made: Callable[[WindowSpec], Sequence[Column]], at: str = "t", before: int = 0, after: int = 0, by: Sequence[str] = (), size: int = SPAN) -> DataFrame:
    """df with what ``made`` gives over windows in order of ``at`` that reach at most ``before`` and ``after`` rows.

    at: whole numbers without gaps, within ``by``. A span of numbers gets a copy of the rows
    beside it that its frames reach, so each span is a window partition of its own.
    """
    (span,) = fresh(df, "span")
    spans = F.sequence(F.floor((F.col(at) - after) / size), F.floor((F.col(at) + before) / size))
    dealt = df.withColumn(span, F.explode(spans))
    told = dealt.select(*dealt.columns, *made(Window.partitionBy(*by, span).orderBy(at)))
    return told.where(F.floor(F.col(at) / size) == F.col(span)).drop(span)


def affine_scan(rows: DataFrame, keys: Sequence[str], at: str, add: Column, factor: Column | float, first: Column | DataFrame, floor: float | None = None, keep: Sequence[str] = (), size: int = PIECE, levels: int = 2) -> DataFrame:
    """(keys, at, keep, entry, state) of x' = max(floor, add + factor * x) along ``at`` within keys: entry is x before a row, state after it.

    first: the entry of a series' first row, as a column of its rows' keys or a table (keys, first).
    Steps of this kind compose into one of their kind, max(C, A + B x), for factors
    of zero and more. Pieces of ``size`` rows become one step each, ``levels`` times over;
    the steps of the last level, one for size ** (levels + 1) rows, are walked a series at once, and
    every piece is then walked again from its own entry. No group holds more than a piece.
    Rows of one series and place are taken in order of their steps; a null step or a negative factor fails the job. A series without a first value in a table is left out.
    """
    b, low = F.lit(factor) if isinstance(factor, float) else factor, F.lit(floor if floor is not None else -1e308)
    wrong = F.when(add.isNull() | b.isNull() | (b < 0), F.raise_error(F.lit("a step is null or turns the order round")).cast("double"))
    key = lambda df: F.struct(F.lit(0).alias("none"), *[F.col(c) for c in keys if c in df.columns])
    steps = rows.select(key(rows).alias("key"), F.col(at).cast("long").alias("i"), F.coalesce(wrong, add).alias("a"), b.cast("double").alias("b"), low.alias("c"), F.struct(F.lit(0).alias("none"), *keep).alias("kept"))
    start = first if isinstance(first, Column) else first.select(key(first).alias("key"), F.col("first").cast("double").alias("entry"))
    entered = walked(steps, start, size, levels)
    s = F.col("step")
    return entered.select(*[F.col("key")[c].alias(c) for c in keys], s["i"].alias(at), *[s["kept"][c].alias(c) for c in keep], "entry", F.greatest(s["a"] + s["b"] * F.col("entry"), s["c"]).alias("state"))


def walked(steps: DataFrame, first: Column | DataFrame, size: int, levels: int) -> DataFrame:
    """(key, step, entry) of each step (key, i, a, b, c, kept)."""
    piece = F.floor(F.col("i") / size) if levels else F.lit(0).cast("long")
    packed = steps.groupBy("key", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "c", "kept"))).alias("steps"))
    if not levels:
        start = packed.withColumn("entry", first) if isinstance(first, Column) else packed.join(first, "key")
    else:
        none = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(-1e308).alias("c"))
        one = F.aggregate("steps", none, lambda s, f: F.struct((f["a"] + f["b"] * s["a"]).alias("a"), (f["b"] * s["b"]).alias("b"), F.greatest(f["a"] + f["b"] * s["c"], f["c"]).alias("c")))
        whole = packed.select("key", F.col("piece").alias("i"), one.alias("f")).select("key", "i", "f.a", "f.b", "f.c", F.struct(F.lit(0).alias("none")).alias("kept"))
        entries = walked(whole, first, size, levels - 1).select("key", F.col("step.i").alias("piece"), "entry")
        start = packed.join(entries, ["key", "piece"])
    from_here = F.struct(F.col("entry").alias("x"), F.array().cast("array<double>").alias("out"))
    walk = F.aggregate("steps", from_here, lambda s, f: F.struct(F.greatest(f["a"] + f["b"] * s["x"], f["c"]).alias("x"), F.concat(s["out"], F.array(s["x"])).alias("out")))
    each = F.explode(F.arrays_zip("steps", walk["out"].alias("entry")))
    return start.select("key", each.alias("e")).select("key", F.col("e.steps").alias("step"), F.col("e.entry").alias("entry"))
