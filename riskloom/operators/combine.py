"""Yearly choices from completed outcomes, applied to the year that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import fz0

#: Strengths of score weights: none, and a hundred from 1e-6 to 1000 in equal ratios. The limit of one winner comes after them.
STRENGTHS = (0.0, *(10 ** (-6 + 9 * k / 99) for k in range(100)))


def completed_before(scores: DataFrame, calendar: DataFrame, dates: int, delay: int = 2) -> DataFrame:
    """scores with year: each row under every year whose cutoff, the last date before it, has it among the last ``dates`` origins that were complete by then. Years with fewer have none.

    calendar: (t, d). The outcome of origin t is complete at t + delay.
    """
    cut = calendar.groupBy((F.year("d") + 1).cast("long").alias("year")).agg(F.max("t").alias("cutoff"))
    rows = scores.join(F.broadcast(cut), (F.col("t") + delay <= F.col("cutoff")) & (F.col("t") > F.col("cutoff") - delay - dates))  # cut: a row a year
    enough = rows.groupBy("year").agg(F.count_distinct("t").alias("have")).where(F.col("have") == dates).select("year")
    return rows.join(F.broadcast(enough), "year").drop("cutoff")


def yearly_choice(past: DataFrame, member: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(year, within, member, past_score): the member of the smallest mean score, each date's mean over its tasks first; ties, at nine decimals, go by ``order``."""
    m = past.groupBy("year", *within, member, "t").agg(F.avg("score").alias("s")).groupBy("year", *within, member).agg(F.avg("s").alias("past_score"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(member))
    g = m.where(place > 0).groupBy("year", *within).agg(F.min(F.struct(F.round("past_score", 9).alias("r"), place.alias("place"), F.col(member).alias("m"), "past_score")).alias("x"))
    return g.select("year", *within, F.col("x.m").alias(member), F.col("x.past_score").alias("past_score"))


def side_by_side(forecasts: DataFrame, keys: Sequence[str], members: Sequence[str], *shared: str) -> DataFrame:
    """(keys, shared, var, es): arrays in order of ``members``; keys that lack one are left out. forecasts have a row a key and model."""
    g = forecasts.groupBy(*keys).agg(*[F.first(c).alias(c) for c in shared], *[F.first(F.when(F.col("model") == m, F.col(v)), ignorenulls=True).alias(f"{v}_{k}") for k, m in enumerate(members) for v in ("var", "es")])
    whole = g.dropna(subset=[f"var_{k}" for k in range(len(members))])
    return whole.select(*keys, *shared, *[F.array(*[f"{v}_{k}" for k in range(len(members))]).alias(v) for v in ("var", "es")])


def dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def score_weights(past: DataFrame, task: Sequence[str], strengths: Sequence[float] = STRENGTHS) -> DataFrame:
    """(year, task, strength, objective, weights): weights falling exponentially with a member's sum of scores, as strongly as served best.

    past: (year, t, task, actual, var, es), arrays by member (side_by_side). Sums are
    taken from the best member's up and over their largest, so strengths have one
    scale. Each strength's weights are tried on the past rows; the smallest mean score,
    at twelve decimals, wins, ties to the weaker. A strength of null is the limit: all weight on
    the best members, shared equally. Members with equal sums share equally at strength 0.
    """
    tau = F.col("tau")
    own = past.withColumn("scores", F.zip_with("var", "es", lambda v, e: fz0(F.col("actual"), v, e, tau)))
    n = F.size(F.first("scores"))
    sums = own.groupBy("year", *task).agg(F.transform(F.sequence(F.lit(0), n - 1), lambda k: k).alias("places"), *[F.sum(F.try_element_at("scores", F.lit(k + 1))).alias(f"s{k}") for k in range(MOST)])
    known = F.slice(F.array(*[f"s{k}" for k in range(MOST)]), 1, F.size("places"))
    shifted = sums.select("year", *task, known.alias("sums")).withColumn("low", F.array_min("sums")).select("year", *task, F.transform("sums", lambda s: s - F.col("low")).alias("above"))
    scale = F.array_max("above")
    delta = F.transform("above", lambda a: F.when(F.col("scale") < 1e-12, 0.0).otherwise(a / F.col("scale")))
    ready = shifted.withColumn("scale", scale).withColumn("delta", delta)
    grid = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(float(s)).alias("strength")) for k, s in enumerate(strengths)], F.struct(F.lit(len(strengths)).alias("place"), F.lit(None).cast("double").alias("strength")))
    raw = F.transform("delta", lambda x: F.when(F.col("g.strength").isNull(), F.when(x * F.col("scale") <= 1e-12, 1.0).otherwise(0.0)).otherwise(F.exp(-F.col("g.strength") * x)))
    tried = ready.withColumn("g", F.explode(grid)).withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda s, x: s + x))
    weights = tried.select("year", *task, F.col("g.place").alias("place"), F.col("g.strength").alias("strength"), F.transform("raw", lambda x: x / F.col("total")).alias("weights"))
    packed = weights.groupBy("year", *task).agg(F.sort_array(F.collect_list(F.struct("place", "strength", "weights"))).alias("grid"))  # a row a year and task, of some hundred strengths
    rows = past.join(packed, ["year", *task]).select("year", *task, "actual", "var", "es", F.explode("grid").alias("g"))
    loss = fz0(F.col("actual"), dot(F.col("g.weights"), F.col("var")), dot(F.col("g.weights"), F.col("es")), tau)
    g = rows.groupBy("year", *task, "g.place").agg(F.avg(loss).alias("objective"), F.first("g.strength").alias("strength"), F.first("g.weights").alias("weights"))
    best = g.groupBy("year", *task).agg(F.min(F.struct(F.round("objective", 12).alias("r"), "place", "strength", "objective", "weights")).alias("x"))
    return best.select("year", *task, "x.strength", "x.objective", "x.weights")


#: Members that score weights are worked out for.
MOST = 16


def weighted_forecasts(forecasts: DataFrame, choices: DataFrame, task: Sequence[str]) -> DataFrame:
    """(year, task, t, var, es): forecasts (year, t, task, var, es as arrays) of the years that have weights, combined."""
    j = forecasts.join(choices, ["year", *task])
    return j.select("year", *task, "t", dot(F.col("weights"), F.col("var")).alias("var"), dot(F.col("weights"), F.col("es")).alias("es"))
