"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r is repeated as often as the
inverse of the Poisson distribution with mean r has it at a number in [0, 1)
that a seeded hash of its id gives. Copies are then spread over the whole output
in the order of another seeded hash. Everything is a column expression; the one
shuffle that moves texts is the global one, by equal ranges of a hash, which no
source or hot key can tilt, and texts are read once for it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1), a multiple of 2**-52, from the MD5 of the seed and the parts, colon-joined; null parts count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_tables(rates: DataFrame, key: str, rate: str, table: str) -> DataFrame:
    """rates with a column ``table``: the cumulative probabilities of 0, 1, ... under a Poisson distribution, ascending; none where the rate is 0.

    Probabilities are summed from n = 0 up, in logarithms, each the one before
    times rate / n, to twelve standard deviations and 40 beyond the mean, where
    less than one in 2**52 is left.
    """
    r = F.col(rate)
    rows = rates.where(r > 0).select(key, rate, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(r + 12 * F.sqrt(r) + 40))).alias("poisson_n"))
    run = Window.partitionBy(key, rate).orderBy("poisson_n")
    n = F.col("poisson_n")
    summed = rows.withColumn("poisson_log", F.sum(F.when(n == 0, -r).otherwise(F.log(r / n))).over(run))
    summed = summed.select(key, rate, n, F.sum(F.exp("poisson_log")).over(run).alias("poisson_sum"))
    made = summed.groupBy(key, rate).agg(F.sort_array(F.collect_list(F.struct("poisson_n", "poisson_sum"))).alias(table)).select(F.col(key).alias("poisson_key"), F.transform(table, lambda x: x["poisson_sum"]).alias(table))
    return rates.join(made, F.col(key).eqNullSafe(F.col("poisson_key")), "left").drop("poisson_key")


def poisson_count(u: Column, table: Column) -> Column:
    """Inverse Poisson distribution: the number of n >= 0 whose cumulative probability is u or less, by halving steps; 0 without a table."""
    table = F.coalesce(table, F.array().cast("array<double>"))
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(table) + 1)).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    reach = lambda at, step: (at + step <= F.size(table)) & (F.try_element_at(table, at + step) <= u)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at))


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, total: int | None, exponent: float) -> DataFrame:
    """(source, rate) of every source of docs: total * weight / documents, rounded to 12 decimals."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0)).cast("double")
    weighed = counts.withColumn("w", weight)
    sums = weighed.agg(F.sum(F.round("w", 9)).alias("all_w"), F.sum("n").alias("all_n"))
    want = F.lit(total).cast("double") if total is not None else F.col("all_n").cast("double")
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return weighed.join(F.broadcast(sums)).select("source", F.round(share * want / F.col("n"), 12).alias("rate"))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: Mapping[str, float] | None = None, total: int | None = None, exponent: float = 0.5, seed: int = 17, broadcast_numbers: int = 4_000_000, copy_col: str | None = "copy", shuffle_col: str | None = "shuffle_key") -> DataFrame:
    """docs with each row repeated by its Poisson count, in a global pseudo-random order.

    weights: target share of each source (any scale; sources left out get none);
    None: in proportion to the documents of a source to the power exponent.
    total: expected rows of the mixture, None as many as docs has. copy_col
    numbers the copies of a row from 0, shuffle_col holds the number in [0, 1)
    that orders them; either may be None to leave it out, and takes a name with
    trailing underscores where docs has the column already. A null source is a
    source of its own (under weights: the one named ""). Rows with the same id,
    null included, get the same count. An empty table returns none.

    A source's cumulative probabilities are made once and looked up by its
    documents. These tables are broadcast while they hold at most broadcast_numbers
    numbers of 8 bytes; beyond that the join is dealt by source and one of 64
    salts, so that no source meets in one task. Copies go to the partition that
    their number in [0, 1) names, in equal ranges, so no sample is drawn first.
    """
    source, rate, salt, table, copies, shuffle = fresh(docs, "mix_source", "mix_rate", "mix_salt", "mix_table", copy_col or "copy", shuffle_col or "shuffle_key")
    rates = source_rates(docs, source_col, weights, total, exponent).select(F.col("source").alias(source), F.col("rate").alias(rate))
    rates = cut_lineage(poisson_tables(rates, source, rate, table))
    numbers = rates.agg(F.coalesce(F.sum(F.size(F.coalesce(table, F.array().cast("array<double>"))) + 4), F.lit(0))).first()[0]
    same = docs[f"`{source_col}`"].eqNullSafe(F.col(source))
    if numbers <= broadcast_numbers:
        rated = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
        spread = docs.withColumn(f"{salt}d", F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(64)).cast("int"))
        rated = spread.join(salted, spread[f"`{source_col}`"].eqNullSafe(F.col(source)) & (F.col(f"{salt}d") == F.col(salt))).drop(salt, f"{salt}d")
    ident = F.col(f"`{id_col}`")
    count = poisson_count(unit(seed, ident), F.col(table))
    repeated = rated.withColumn(copies, count).where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = repeated.withColumn(shuffle, unit(seed + 1, ident, F.col(copies)))
    mixed = keyed.repartitionById(parts, F.floor(F.col(shuffle) * parts).cast("int")).sortWithinPartitions(shuffle, id_col, copies)
    out = [F.col(f"`{c}`") for c in docs.columns]
    return mixed.select(*out, *([copies] if copy_col else []), *([shuffle] if shuffle_col else []))
