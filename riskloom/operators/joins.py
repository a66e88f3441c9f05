"""As-of and validated joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import fresh, place_among


def latest_completed(left: DataFrame, right: DataFrame, at: str, known_at: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row of left with the latest row of right, of the same keys, that is known at its time or before; nulls where there is none.

    Both sides are sorted together by key and time, and each left row takes the
    last right row before it: nothing is paired that is not returned. Without keys the
    order is cut into parts (latest_in_parts). Of right rows known at one time the greatest counts.
    """
    values = [c for c in right.columns if c not in by]
    if not by:
        return latest_in_parts(left, right, at, known_at)
    time, mine, row, value = fresh(left.select(*by), "time", "mine", "row", "value")
    known = right.where(F.col(known_at).isNotNull()).select(*by, F.col(known_at).alias(time), F.struct(*values).alias(value))
    return filled(left.select(*by, F.col(at).alias(time), F.struct(*left.columns).alias(row)), known, list(by), (time, mine, row, value)).select(f"{row}.*", *[F.col(f"{value}.{c}").alias(c) for c in values if c not in left.columns])


def filled(left: DataFrame, right: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """left (by, time, row) with the value of the last right row (by, time, value) at its time or before."""
    time, mine, row, value = names
    a = left.withColumn(mine, F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.withColumn(mine, F.lit(0)).withColumn(row, F.lit(None).cast(left.schema[row].dataType))
    w = Window.partitionBy(*by).orderBy(time, mine, value).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(mine) == 1)


def latest_in_parts(left: DataFrame, right: DataFrame, at: str, known_at: str) -> DataFrame:
    """The as-of join of whole tables, in as many tasks as the session shuffles into, or more.

    right shrinks to a row a time. Quantiles of those times cut the order into parts of
    about equally many of them; a part begins with the last row of the parts before it, so
    empty parts cost nothing. A part with more left rows than its share, one moment that a third
    of all rows have included, is dealt over several tasks, each with the part's right rows.
    Cuts and the parts' sizes, a number each a part, are all that the driver sees.
    """
    spark, parts = left.sparkSession, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = right.schema[known_at].dataType
    known = right.where(F.col(known_at).isNotNull()).groupBy(F.col(known_at).alias("time")).agg(F.max(F.struct(*right.columns)).alias("value"))
    cuts = sorted(set(known.agg(F.percentile_approx("time", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []))
    place = place_among(F.array(*[F.lit(c).cast(kind) for c in cuts]), F.col("time").cast(kind), len(cuts)) if cuts else F.lit(0)
    mine = left.select(F.col(at).alias("time"), F.struct(*left.columns).alias("row")).withColumn("part", place)
    sizes = {r.part: r["count"] for r in mine.groupBy("part").count().collect()}
    share = max(1, sum(sizes.values()) // parts)
    tasks = spark.createDataFrame([(p, -(-n // share)) for p, n in sizes.items()], "part int, tasks int")
    known = known.withColumn("part", place)
    last = known.groupBy("part").agg(F.max_by("value", "time").alias("carried")).withColumnRenamed("part", "from")
    earlier = tasks.select("part").join(F.broadcast(last), F.col("from") < F.col("part"), "left")  # a row a part
    carried = earlier.groupBy("part").agg(F.max_by("carried", "from").alias("carried"))
    tasks = F.broadcast(tasks.join(carried, "part"))
    dealt = mine.join(tasks, "part").withColumn("task", F.floor(F.rand(1) * F.col("tasks")).cast("int")).drop("tasks")
    copies = known.join(tasks, "part").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    out = filled(dealt, copies, ["part", "task"], ("time", "mine", "row", "value"))
    value = F.coalesce("value", "carried")
    return out.select("row.*", *[value[c].alias(c) for c in right.columns if c not in left.columns])


def year_cutoff(calendar: DataFrame) -> DataFrame:
    """(t, d, cutoff, cutoff_d): each row with the last row of the year before, where there is one."""
    last = calendar.groupBy((F.year("d") + 1).alias("y")).agg(F.max("t").alias("cutoff"), F.max("d").alias("cutoff_d"))
    return calendar.withColumn("y", F.year("d")).join(F.broadcast(last), "y").select("t", "d", "cutoff", "cutoff_d")


def refused(df: DataFrame, fault: Column, what: str) -> DataFrame:
    """df; the job fails at the first row where fault holds."""
    return df.where(F.when(fault, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys; the job fails where a key occurs twice on either side."""

    def single(df: DataFrame) -> DataFrame:
        (rows,) = fresh(df, "key_rows")
        many = df.withColumn(rows, F.count("*").over(Window.partitionBy(*keys)))
        return refused(many, F.col(rows) > 1, f"a key of {', '.join(keys)} occurs twice").drop(rows)

    return single(left).join(single(right), list(keys))


def components_of(forecasts: DataFrame, selectors: DataFrame, on: Sequence[str], task: Sequence[str], tolerance: float = 1e-13) -> DataFrame:
    """(task, var_<model>.. as arrays): forecasts that a selector row names, one row a task with all of them in order of the model.

    The job fails where a task lacks a selected model or has one twice, where its
    target dates differ, or where its outcomes differ by more than the tolerance.
    """
    chosen = forecasts.join(F.broadcast(selectors), list(on), "left_semi")  # selectors: a row a component
    wanted = selectors.select("model").distinct().agg(F.count("*").alias("wanted"))
    facts = F.struct(F.count("*").alias("rows"), F.count_distinct("model").alias("models"), (F.max("actual") - F.min("actual")).alias("apart"), F.first("actual").alias("actual"), F.sort_array(F.collect_list(F.struct("model", "var", "es"))).alias("x"))
    g = chosen.groupBy(F.struct(*task).alias("task")).agg(facts.alias("facts")).crossJoin(F.broadcast(wanted))  # wanted: one row
    f = lambda c: F.col(f"facts.{c}")
    g = refused(g, f("models") != F.col("wanted"), "a task lacks a selected component")
    g = refused(g, f("rows") != f("models"), "a task has a component twice")
    g = refused(g, f("apart") > tolerance, "components disagree about an outcome")
    return g.select("task.*", f("actual").alias("actual"), f("x.model").alias("models"), f("x.var").alias("var"), f("x.es").alias("es"))
