"""Evaluation of longer holding periods: one set of tables a horizon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.operators import inference as I
from riskloom.operators.books import REFERENCES
from riskloom.operators.risk import historical_sets, realised, scored, var_es
from riskloom.plans.base import KEYS, panel, returns
from riskloom.plans.inference_queries import REPS, band_query, bands_sql, centred_sql, draws_sql, drawn_sql, hac_sql
from riskloom.plans.risk_queries import FHS, FKEYS, TAU, filtered_sets, paths_sql, told
from riskloom.plans.sql import each_task, r6 as q6, returns_step, risk_step, score_step, set_step, sql

QUERIES, SQL = {}, {}
HORIZONS, WINDOWS_H, BLOCKS_H = (5, 20), (250, 1250), (20, 60, 120)


def query(name: str, text: str):
    def add(f):
        QUERIES[name], SQL[name] = f, text
        return f

    return add


STEPS_H: dict = {}
for h_ in HORIZONS:
    STEPS_H |= {
        f"pairs_h{h_}": (returns_step(h_), ("returns",)),
        f"priced_h{h_}": (each_task("s", f"pairs_h{h_}"), (f"pairs_h{h_}",)),
        f"realised_h{h_}": (f"SELECT s AS t, book, report, loss AS actual FROM priced_h{h_}", (f"priced_h{h_}",)),
        **{f"sets_h{h_}_{w}": (set_step(f"priced_h{h_}", w, h_), (f"priced_h{h_}",)) for w in WINDOWS_H},
        **{f"risk_h{h_}_{w}": (risk_step(f"sets_h{h_}_{w}", "t, book, report"), (f"sets_h{h_}_{w}", "taus")) for w in WINDOWS_H},
        f"forecasts_h{h_}": (" UNION ALL ".join(f"SELECT 'HS{w}' AS model, * FROM risk_h{h_}_{w}" for w in WINDOWS_H), tuple(f"risk_h{h_}_{w}" for w in WINDOWS_H)),
        f"scores_h{h_}": (score_step(f"forecasts_h{h_}", realised=f"realised_h{h_}"), (f"forecasts_h{h_}", f"realised_h{h_}")),
    }
STEPS_H["hscores"] = (" UNION ALL ".join(f"SELECT {h} AS horizon, * FROM scores_h{h}" for h in HORIZONS), tuple(f"scores_h{h}" for h in HORIZONS))


def horizon_scores(spark, d) -> DataFrame:
    """(horizon, model, t, book, report, tau, var, es, actual, hit, tail_residual, score) of historical simulation over two windows at each horizon."""
    r, out = returns(spark, d), []
    for h in HORIZONS:
        each = [var_es(historical_sets(r, w, h), KEYS).select(F.lit(f"HS{w}").alias("model"), "*") for w in WINDOWS_H]
        out.append(scored(reduce(DataFrame.unionByName, each), realised(r, h)).select(F.lit(h).alias("horizon"), "*"))
    return reduce(DataFrame.unionByName, out)


MEANS = ", ".join(f"{q6(e)} AS {n}" for n, e in (("mean_score", "avg(score)"), ("breach_rate", "avg(hit)"), ("mean_var", "avg(var)"), ("mean_es", "avg(es)"), ("median_es", "median(es)")))


def grouped(keys: str, source: str = "hscores") -> str:
    given = keys.replace("tau", f"{source}.tau")
    return f"SELECT {keys.replace('tau', TAU)}, count(DISTINCT t) AS n_dates, count(*) AS n_tasks, {MEANS} FROM {source} GROUP BY {given}"


@query("horizon_task_summary", sql(grouped("horizon, tau, model, book, report"), "hscores", extra=STEPS_H))
def horizon_task_summary(spark, d):
    return told(E.summary(horizon_scores(spark, d), "horizon", "tau", "model", "book", "report"))


@query("horizon_model_summary", sql(grouped("horizon, tau, model"), "hscores", extra=STEPS_H))
def horizon_model_summary(spark, d):
    return told(E.summary(horizon_scores(spark, d), "horizon", "tau", "model"))


@query("horizon_yearly_summary", sql(grouped("year, horizon, tau, model", "hdated"), "hdated", extra=STEPS_H | {"hdated": ("SELECT s.*, CAST(year(p.d) AS INTEGER) AS year FROM hscores s JOIN panel p USING (t)", ("hscores", "panel"))}))
def horizon_yearly_summary(spark, d):
    years = panel(spark, d).select("t", F.year("d").alias("year"))
    return told(E.summary(horizon_scores(spark, d).join(F.broadcast(years), "t"), "year", "horizon", "tau", "model"))  # years: a row a date


HDAILY = STEPS_H | {"hdaily": ("SELECT * FROM (SELECT horizon, tau, t, avg(CASE WHEN model = 'HS250' THEN score END) - avg(CASE WHEN model = 'HS1250' THEN score END) AS HS250 FROM hscores GROUP BY ALL) WHERE HS250 IS NOT NULL", ("hscores",))}


@query("horizon_score_contrasts", sql(band_query(f"horizon, {TAU}, block, contrast", "horizon, tau, block"), "told", "crit", extra=HDAILY | draws_sql("horizon, tau", "hdaily", ["HS250"], BLOCKS_H) | bands_sql("horizon, tau, block")))
def horizon_score_contrasts(spark, d):
    """The short window's daily score less the long one's, with bands at three block lengths."""
    at = lambda m: F.avg(F.when(F.col("model") == m, F.col("score")))
    daily = horizon_scores(spark, d).groupBy("horizon", "tau", "t").agg((at("HS250") - at("HS1250")).alias("HS250")).dropna()
    return told(I.bands(*I.bootstrap(daily, ["horizon", "tau"], ["HS250"], BLOCKS_H, REPS), ["horizon", "tau", "block"]))


HKEYS = "horizon, model, book, report, tau"
INTERVALS = ", ".join(f"{q6(e)} AS {n}" for n, e in (("breach_rate", "mean_hit"), ("rate_low", "mean_hit - 1.96 * sqrt(greatest(cov_hit_hit, 0))"), ("rate_high", "mean_hit + 1.96 * sqrt(greatest(cov_hit_hit, 0))"), ("es_identification", "mean_u"), ("es_low", "mean_u - 1.96 * sqrt(greatest(cov_u_u, 0))"), ("es_high", "mean_u + 1.96 * sqrt(greatest(cov_u_u, 0))")))


@query("horizon_calibration", sql(" UNION ALL ".join(f"SELECT horizon, model, book, report, {TAU}, {lags} AS lags, n, CAST(round(mean_hit * n) AS BIGINT) AS breaches, {q6('n * (1 - CAST(c.tau AS DOUBLE))')} AS expected, {INTERVALS}, round(mean_hit * n) < 30 AS sparse FROM hcov{lags} c" for lags in BLOCKS_H), *(f"hcov{lags}" for lags in BLOCKS_H), extra=STEPS_H | {"hcentred": (centred_sql(HKEYS, "hscores"), ("hscores",)), **{f"hcov{lags}": (hac_sql(("hit", "u"), lags, "hcentred", HKEYS), ("hcentred",)) for lags in BLOCKS_H}}))
def horizon_calibration(spark, d):
    """Breach rate and ES identification with normal intervals from long-run variances at three lags."""
    s, keys = horizon_scores(spark, d).withColumn("u", F.col("tail_residual") / F.col("es")), ["horizon", "model", "book", "report", "tau"]
    each = reduce(DataFrame.unionByName, [E.hac_covariances(s, ["hit", "u"], lags, *keys).withColumn("lags", F.lit(lags)) for lags in BLOCKS_H])
    at = lambda v, sign: F.col(f"mean_{v}") + F.lit(sign * 1.96) * F.sqrt(F.greatest(F.col(f"cov_{v}_{v}"), F.lit(0.0)))
    breaches = F.round(F.col("mean_hit") * F.col("n"))
    return told(each.select(*keys, "lags", "n", breaches.cast("long").alias("breaches"), (F.col("n") * (1 - F.col("tau").cast("double"))).alias("expected"), F.col("mean_hit").alias("breach_rate"), at("hit", -1).alias("rate_low"), at("hit", 1).alias("rate_high"), F.col("mean_u").alias("es_identification"), at("u", -1).alias("es_low"), at("u", 1).alias("es_high"), (breaches < 30).alias("sparse")))


@query("horizon_reporting_effects", sql(" UNION ALL ".join(f"SELECT {h} AS horizon, book, count(*) AS n, {q6('stddev_samp(b)')} AS sd_base, {q6('stddev_samp(s)')} AS sd_s1, {q6('avg(abs(s - b))')} AS mean_abs_difference, {q6('max(abs(s - b))')} AS max_abs_difference FROM (SELECT t, book, max(CASE WHEN report = 'base' THEN actual END) AS b, max(CASE WHEN report = 's1' THEN actual END) AS s FROM realised_h{h} GROUP BY 1, 2) GROUP BY book" for h in HORIZONS), *(f"realised_h{h}" for h in HORIZONS), extra=STEPS_H))
def horizon_reporting_effects(spark, d):
    r, gap = returns(spark, d), F.abs(F.col("s1") - F.col("base"))
    every = reduce(DataFrame.unionByName, [realised(r, h).withColumn("horizon", F.lit(h)) for h in HORIZONS])
    wide = every.groupBy("horizon", "t", "book").pivot("report", ["base", "s1"]).agg(F.first("actual"))
    return told(wide.groupBy("horizon", "book").agg(F.count("*").alias("n"), F.stddev_samp("base").alias("sd_base"), F.stddev_samp("s1").alias("sd_s1"), F.avg(gap).alias("mean_abs_difference"), F.max(gap).alias("max_abs_difference")))


RANGE_REPS = 1000
FIVE = paths_sql("z", False, 250, 5)
RANGES = FIVE | {
    "frange": ("SELECT tau, t, book || '_' || report AS task, max(es) - min(es) AS span, (max(es) - min(es)) / max(CASE WHEN reference = 'base' THEN es END) AS relative FROM frisk WHERE es > 0 GROUP BY ALL HAVING count(*) = 5", ("frisk",)),
    "franges": ("SELECT tau, task, t, relative FROM frange", ("frange",)),
}


def reference_ranges(spark, d) -> DataFrame:
    """(tau, t, task, span, relative): range of five-day ES over frames, and over the numeraire's ES, where all five are positive."""
    f = var_es(filtered_sets(spark, d, window=250, h=5), FKEYS).where("es > 0")
    base = F.max(F.when(F.col("reference") == "base", F.col("es")))
    g = f.groupBy("tau", "t", F.concat_ws("_", "book", "report").alias("task")).agg((F.max("es") - F.min("es")).alias("span"), ((F.max("es") - F.min("es")) / base).alias("relative"), F.count("*").alias("n"))
    return g.where("n = 5").drop("n")


@query("horizon_reference_ranges", sql(f"SELECT {TAU}, task, n, median_relative, p90_relative, median_span, {q6('low')} AS median_low, {q6('high')} AS median_high FROM (SELECT tau, task, count(*) AS n, {q6('median(relative)')} AS median_relative, {q6('quantile_cont(relative, 0.9)')} AS p90_relative, {q6('median(span)')} AS median_span FROM frange GROUP BY ALL) AS own JOIN (SELECT tau, task, quantile_cont(median, 0.025) AS low, quantile_cont(median, 0.975) AS high FROM medians GROUP BY ALL) USING (tau, task)", "frange", "medians", extra=RANGES | drawn_sql("tau, task", "franges", ["relative"], (60,), RANGE_REPS), recursive=True))
def horizon_reference_ranges(spark, d):
    x = reference_ranges(spark, d)
    own = x.groupBy("tau", "task").agg(F.count("*").alias("n"), F.percentile("relative", 0.5).alias("median_relative"), F.percentile("relative", 0.9).alias("p90_relative"), F.percentile("span", 0.5).alias("median_span"))
    m = I.block_medians(x.drop("span"), ["tau", "task"], ["relative"], (60,), RANGE_REPS)
    return told(own.join(m.groupBy("tau", "task").agg(F.percentile("median", 0.025).alias("median_low"), F.percentile("median", 0.975).alias("median_high")), ["tau", "task"]))


FRAMES = [(a, b) for k, a in enumerate(REFERENCES) for b in REFERENCES[k + 1 :]]
PAIR_NAMES = [f"{a}_less_{b}" for a, b in FRAMES]
CELL = "max(CASE WHEN reference = '{0}' THEN es END)"
PAIRS = FHS | {
    "fcells": ("SELECT tau, book || '_' || report AS task, t, " + ", ".join(f"({CELL.format(a)} - {CELL.format(b)}) / {CELL.format('base')} AS {n}" for (a, b), n in zip(FRAMES, PAIR_NAMES, strict=True)) + " FROM frisk WHERE es > 0 GROUP BY ALL HAVING count(*) = 5", ("frisk",)),
}


@query("reference_pair_contrasts", sql(band_query(f"{TAU}, task, block, contrast", "tau, task, block"), "told", "crit", extra=PAIRS | draws_sql("tau, task", "fcells", PAIR_NAMES, (20,), RANGE_REPS) | bands_sql("tau, task, block"), recursive=True))
def reference_pair_contrasts(spark, d):
    """Differences of ES between every two frames over the numeraire's ES, task by task, a family of ten each."""
    f = var_es(filtered_sets(spark, d), FKEYS).where("es > 0")
    at = lambda ref: F.max(F.when(F.col("reference") == ref, F.col("es")))
    g = f.groupBy("tau", F.concat_ws("_", "book", "report").alias("task"), "t").agg(F.count("*").alias("n"), *[((at(a) - at(b)) / at("base")).alias(n) for (a, b), n in zip(FRAMES, PAIR_NAMES, strict=True)]).where("n = 5").drop("n")
    return told(I.bands(*I.bootstrap(g, ["tau", "task"], PAIR_NAMES, (20,), RANGE_REPS), ["tau", "task", "block"]))
