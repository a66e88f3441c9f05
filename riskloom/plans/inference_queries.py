"""Queries of block-bootstrap inference and calibration tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.operators import inference as I
from riskloom.operators.books import BOOKS, REFERENCES, REPORTS
from riskloom.operators.risk import var_es
from riskloom.plans.base import KEYS, forecasts, panel, scores
from riskloom.plans.risk_queries import FHS, FKEYS, TAU, filtered_sets, told
from riskloom.plans.sql import WINDOWS, r6 as q6, sql

QUERIES, SQL = {}, {}
BLOCKS, REPS = (20, 60), 5000
TASKS = [(book, report) for book in BOOKS for report in REPORTS]
MODELS = [f"HS{w}" for w in WINDOWS]
LONGEST = MODELS[-1]


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


# Twins of the draws: every drawn block as its dates, or as a difference of running sums over the doubled series.
def starts_sql(scope: str, source: str, blocks, reps: int) -> str:
    on = f"{scope}, " if scope else ""
    sizes = f"SELECT {on}count(DISTINCT t) AS n FROM {source} GROUP BY ALL" if scope else f"SELECT count(DISTINCT t) AS n FROM {source}"
    return f"""SELECT {on}block, n, rep, CAST('0x' || substr(md5('{I.SEED}:' || rep || ':' || pos), 1, 13) AS BIGINT) % n AS start, least(block, n - pos * block) AS length
    FROM (SELECT *, unnest(range(CAST(ceil(n / block) AS BIGINT))) AS pos FROM (SELECT *, unnest(range({reps})) AS rep FROM (SELECT *, unnest([{', '.join(f'CAST({b} AS BIGINT)' for b in blocks)}]) AS block FROM ({sizes}))))"""


def draws_sql(scope: str, source: str, columns, blocks=BLOCKS, reps: int = REPS, name: str = "") -> dict:
    """Steps {name}starts, {name}run and {name}draws (scope, block, rep, contrast, mean) from a wide source (scope, t, columns)."""
    on, parts = f"{scope}, " if scope else "", f"PARTITION BY {scope}" if scope else ""
    cols = ", ".join(f"sum({c}) OVER w AS {c}" for c in columns)
    sums = ", ".join(f"sum(b.{c} - coalesce(a.{c}, 0)) / max(s.n) AS {c}" for c in columns)
    match = " AND ".join(f"s.{c.strip()} = #.{c.strip()}" for c in scope.split(",")) if scope else "true"
    joined = "FROM {0}starts s JOIN {0}run b ON " + match.replace("#", "b") + " AND b.i = s.start + s.length LEFT JOIN {0}run a ON " + match.replace("#", "a") + " AND a.i = s.start"
    own = ", ".join(f"s.{c.strip()}" for c in scope.split(",")) + ", " if scope else ""
    each = " UNION ALL ".join(f"SELECT {on}block, rep, '{c}' AS contrast, {c} AS mean FROM {name}drawmeans" for c in columns)
    est = " UNION ALL ".join(f"SELECT {on}'{c}' AS contrast, avg({c}) AS estimate FROM {source} GROUP BY ALL" if scope else f"SELECT '{c}' AS contrast, avg({c}) AS estimate FROM {source}" for c in columns)
    return {
        f"{name}starts": (starts_sql(scope, source, blocks, reps), (source,)),
        f"{name}doubled": (f"SELECT *, row_number() OVER ({parts} ORDER BY half, t) AS i FROM (SELECT *, unnest([0, 1]) AS half FROM {source})", (source,)),
        f"{name}run": (f"SELECT {on}i, {cols} FROM {name}doubled WINDOW w AS ({parts} ORDER BY i)", (f"{name}doubled",)),
        f"{name}drawmeans": (f"SELECT {own}s.block, s.rep, {sums} {joined.format(name)} GROUP BY ALL", (f"{name}starts", f"{name}run")),
        f"{name}draws": (each, (f"{name}drawmeans",)),
        f"{name}est": (est, (source,)),
    }


def bands_sql(family: str, within: str = "", name: str = "") -> dict:
    """Steps {name}told and {name}crit from {name}draws and {name}est; family and within are column lists."""
    keys = ", ".join(x for x in (family, within, "contrast") if x)
    scope = ", ".join(c.strip() for c in f"{family},{within},contrast".split(",") if c.strip() and c.strip() != "block")
    return {
        f"{name}told": (f"SELECT {keys}, estimate, stddev_samp(mean) AS se, quantile_cont(mean, 0.025) AS point_low, quantile_cont(mean, 0.975) AS point_high FROM {name}draws JOIN {name}est USING ({scope}) GROUP BY ALL", (f"{name}draws", f"{name}est")),
        f"{name}crit": (f"SELECT {family}, quantile_cont(either, 0.95) AS critical, quantile_cont(down, 0.95) AS critical_low, quantile_cont(up, 0.95) AS critical_high FROM (SELECT {family}, rep, max(abs(z)) AS either, max(z) AS up, max(-z) AS down FROM (SELECT {family}, rep, (mean - estimate) / se AS z FROM {name}draws JOIN {name}told USING ({keys}) WHERE se > 0) GROUP BY ALL) GROUP BY {family}", (f"{name}draws", f"{name}told")),
    }


BAND_VALUES = {"estimate": "estimate", "se": "se", "point_low": "point_low", "point_high": "point_high", "critical": "critical", "critical_low": "critical_low", "critical_high": "critical_high", "simultaneous_low": "estimate - critical * se", "simultaneous_high": "estimate + critical * se", "one_sided_low": "estimate - critical_low * se", "one_sided_high": "estimate + critical_high * se"}
BAND = ", ".join(f"{q6(e)} AS {n}" for n, e in BAND_VALUES.items())


def band_query(keys: str, family: str, name: str = "") -> str:
    return f"SELECT {keys}, {BAND} FROM {name}told JOIN {name}crit USING ({family})"


def double_tau(keys: str) -> str:
    return keys.replace("tau", "CAST(tau AS DOUBLE) AS tau")


# Differences of daily scores, over dates that all models have.
def daily_scores(spark, d) -> DataFrame:
    return scores(spark, d).groupBy("tau", "t").pivot("model", MODELS).agg(F.avg("score")).dropna()


CONTRASTS = MODELS[:-1]
DAILY = {
    "days": ("SELECT tau, t, " + ", ".join(f"avg(CASE WHEN model = '{m}' THEN score END) AS {m}" for m in MODELS) + " FROM scores GROUP BY ALL", ("scores",)),
    "whole_days": ("SELECT * FROM days WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MODELS), ("days",)),
    "daily": ("SELECT tau, t, " + ", ".join(f"{m} - {LONGEST} AS {m}" for m in CONTRASTS) + " FROM whole_days", ("whole_days",)),
}
SCORE_DRAWS = DAILY | draws_sql("tau", "daily", CONTRASTS)
SCORE_BANDS = SCORE_DRAWS | bands_sql("tau, block")


def daily_contrasts(spark, d) -> DataFrame:
    """(tau, t, a column a shorter window): its mean score over tasks less that of the longest."""
    return daily_scores(spark, d).select("tau", "t", *[(F.col(m) - F.col(LONGEST)).alias(m) for m in CONTRASTS])


@query("block_bootstrap_means", sql(f"SELECT {TAU}, block, rep, contrast, {q6('mean')} AS mean FROM draws", "draws", extra=SCORE_DRAWS))
def block_bootstrap_means(spark, d):
    return told(I.block_means(daily_contrasts(spark, d), ["tau"], CONTRASTS, BLOCKS, REPS))


def score_band(spark, d) -> DataFrame:
    daily = daily_contrasts(spark, d)
    return I.bands(*I.bootstrap(daily, ["tau"], CONTRASTS, BLOCKS, REPS), ["tau", "block"])


@query("simultaneous_band", sql(band_query(f"{TAU}, block, contrast", "tau, block"), "told", "crit", extra=SCORE_BANDS))
def simultaneous_band(spark, d):
    return told(score_band(spark, d))


MARGINS = "estimate + critical_high * se < margin AS below, estimate - critical_low * se > -margin AND estimate + critical_high * se < margin AS inside, " + q6("greatest(estimate + critical_high * se, 0)") + " AS needed_one_sided, " + q6("greatest(estimate + critical_high * se, critical_low * se - estimate, 0)") + " AS needed_two_sided"


@query("margin_table", sql(f"SELECT {TAU}, block, contrast, {BAND}, margin, {MARGINS} FROM told JOIN crit USING (tau, block) CROSS JOIN (SELECT unnest([CAST(0.005 AS DOUBLE), 0.01, 0.02, 0.05]) AS margin)", "told", "crit", extra=SCORE_BANDS))
def margin_table(spark, d):
    return told(I.margins(score_band(spark, d), (0.005, 0.01, 0.02, 0.05)))


def drawn_sql(scope: str, source: str, columns, blocks, reps: int) -> dict:
    """Steps starts and medians: every drawn date itself."""
    on = f"{scope}, " if scope else ""
    numbered = f"SELECT *, dense_rank() OVER ({f'PARTITION BY {scope}' if scope else ''} ORDER BY t) - 1 AS i FROM {source}"
    using = ", ".join(x for x in (scope, "i") if x)
    return {
        "starts": (starts_sql(scope, source, blocks, reps), (source,)),
        "drawn": (f"SELECT * FROM (SELECT {on}block, rep, (start + unnest(range(length))) % n AS i FROM starts) JOIN ({numbered}) USING ({using})", ("starts", source)),
        "medians": (" UNION ALL ".join(f"SELECT {on}block, rep, '{c}' AS contrast, median({c}) AS median FROM drawn GROUP BY ALL" for c in columns), ("drawn",)),
    }


@query("median_bootstrap", sql(f"SELECT {TAU}, block, rep, contrast, {q6('median')} AS median FROM medians", "medians", extra=DAILY | drawn_sql("tau", "daily", CONTRASTS, BLOCKS[:1], REPS)))
def median_bootstrap(spark, d):
    return told(I.block_medians(daily_contrasts(spark, d), ["tau"], CONTRASTS, BLOCKS[:1], REPS))


# Yearly medians of the relative range of ES over windows, with intervals.
YEAR_REPS = 1000
SPANS = {
    "spans": ("SELECT CAST(year(p.d) AS INTEGER) AS year, f.tau, f.t, f.book, f.report, (max(es) - min(es)) / avg(abs(es)) AS relative FROM forecasts f JOIN panel p USING (t) GROUP BY ALL HAVING count(*) = 3 AND avg(abs(es)) > 0", ("forecasts", "panel")),
    "yearly": ("SELECT year, tau, t, " + ", ".join(f"max(CASE WHEN book = '{b}' AND report = '{r}' THEN relative END) AS {b}_{r}" for b, r in TASKS) + " FROM spans GROUP BY ALL", ("spans",)),
}
TASK_NAMES = [f"{b}_{r}" for b, r in TASKS]


def yearly_spans(spark, d) -> DataFrame:
    """(year, tau, t, a column a task): range of ES over the three windows, over its mean size."""
    s = E.dispersion(forecasts(spark, d), [*KEYS, "tau"], "es").where("n = 3 and mean_abs > 0").join(F.broadcast(panel(spark, d).select("t", F.year("d").alias("year"))), "t")
    return s.groupBy("year", "tau", "t").agg(*[F.max(F.when((F.col("book") == b) & (F.col("report") == r), F.col("relative"))).alias(f"{b}_{r}") for b, r in TASKS])


@query("annual_span_intervals", sql(f"SELECT year, {TAU}, block, contrast, {q6('quantile_cont(median, 0.025)')} AS median_low, {q6('quantile_cont(median, 0.975)')} AS median_high FROM medians GROUP BY year, medians.tau, block, contrast", "medians", extra=SPANS | drawn_sql("year, tau", "yearly", TASK_NAMES, BLOCKS[:1], YEAR_REPS)))
def annual_span_intervals(spark, d):
    m = I.block_medians(yearly_spans(spark, d), ["year", "tau"], TASK_NAMES, BLOCKS[:1], YEAR_REPS)
    return told(m.groupBy("year", "tau", "block", "contrast").agg(F.percentile("median", 0.025).alias("median_low"), F.percentile("median", 0.975).alias("median_high")))


@query("annual_span_persistence", sql(f"SELECT {TAU}, book, report, {q6('min(m)')} AS low, {q6('max(m)')} AS high, count(*) AS years FROM (SELECT year, tau, book, report, median(relative) AS m FROM spans WHERE year > (SELECT max(year) - 5 FROM spans) GROUP BY ALL) AS g GROUP BY g.tau, book, report", "spans", extra=SPANS))
def annual_span_persistence(spark, d):
    """Smallest and largest yearly median of each task over the last five years."""
    s = I.unpivoted(yearly_spans(spark, d), ["year", "tau", "t"], TASK_NAMES, "relative")
    s = s.join(F.broadcast(s.agg(F.max("year").alias("last"))), F.col("year") > F.col("last") - 5)
    m = s.groupBy("year", "tau", "contrast").agg(F.percentile("relative", 0.5).alias("m")).groupBy("tau", "contrast").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count("*").alias("years"))
    book, report = (F.regexp_extract("contrast", r"^(.*)_([^_]+)$", k) for k in (1, 2))
    return told(m.select("tau", book.alias("book"), report.alias("report"), "low", "high", "years"))


# Paired score contrasts: eight tasks of a tail, and both tails.
PAIRED = {
    "task_days": ("SELECT tau, t, " + ", ".join(f"avg(CASE WHEN model = '{CONTRASTS[0]}' AND book = '{b}' AND report = '{r}' THEN score END) - avg(CASE WHEN model = '{LONGEST}' AND book = '{b}' AND report = '{r}' THEN score END) AS {b}_{r}" for b, r in TASKS) + " FROM scores GROUP BY ALL", ("scores",)),
    "paired": ("SELECT * FROM task_days WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in TASK_NAMES), ("task_days",)),
}


@query("paired_task_contrasts", sql(band_query(f"{TAU}, block, contrast", "tau, block"), "told", "crit", extra=PAIRED | draws_sql("tau", "paired", TASK_NAMES) | bands_sql("tau, block")))
def paired_task_contrasts(spark, d):
    """The shortest window against the longest, task by task: a family of eight a tail."""
    s = scores(spark, d)
    at = lambda m, b, r: F.avg(F.when((F.col("model") == m) & (F.col("book") == b) & (F.col("report") == r), F.col("score")))
    daily = s.groupBy("tau", "t").agg(*[(at(CONTRASTS[0], b, r) - at(LONGEST, b, r)).alias(f"{b}_{r}") for b, r in TASKS]).dropna()
    return told(I.bands(*I.bootstrap(daily, ["tau"], TASK_NAMES, BLOCKS, REPS), ["tau", "block"]))


TAILS = {"tails": ("SELECT t, " + ", ".join(f"max(CASE WHEN tau = 0.{x} THEN {CONTRASTS[0]} END) AS tail{x}" for x in (95, 99)) + " FROM daily GROUP BY t HAVING count(*) = 2", ("daily",))}


@query("paired_tail_contrasts", sql(band_query("block, contrast", "block"), "told", "crit", extra=DAILY | TAILS | draws_sql("", "tails", ["tail95", "tail99"]) | bands_sql("block")))
def paired_tail_contrasts(spark, d):
    """The same, averaged over tasks: a family of both tails on shared dates."""
    names = ["tail95", "tail99"]
    daily = daily_contrasts(spark, d).groupBy("t").agg(*[F.max(F.when(F.col("tau") == f"0.{n[-2:]}", F.col(CONTRASTS[0]))).alias(n) for n in names]).dropna()
    return told(I.bands(*I.bootstrap(daily, [], names, BLOCKS, REPS), ["block"]))


# Signed logarithmic ratios of ES over reference frames.
RATIOS = [f"{b}_{r}_{ref}" for b, r in TASKS for ref in REFERENCES[1:]]
RATIO_SQL = {
    "ratio_cells": ("SELECT tau, t, " + ", ".join(f"ln(max(CASE WHEN book = '{b}' AND report = '{r}' AND reference = '{ref}' AND es > 0 THEN es END) / max(CASE WHEN book = '{b}' AND report = '{r}' AND reference = 'base' AND es > 0 THEN es END)) AS {b}_{r}_{ref}" for b, r in TASKS for ref in REFERENCES[1:]) + " FROM frisk GROUP BY ALL", ("frisk",)),
    "ratios": ("SELECT * FROM ratio_cells WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in RATIOS), ("ratio_cells",)),
}
CUT = "regexp_extract(contrast, '^(.*)_([^_]+)$', {})"
SPLIT = {"task_draws": (f"SELECT tau, block, rep, {CUT.format(1)} AS task, {CUT.format(2)} AS contrast, mean FROM draws", ("draws",)), "task_est": (f"SELECT tau, {CUT.format(1)} AS task, {CUT.format(2)} AS contrast, estimate FROM est", ("est",))}


@query("reference_log_es_ratios", sql(f"SELECT CAST(t.tau AS DOUBLE) AS tau, t.block, t.task, t.contrast, {q6('t.estimate')} AS estimate, {q6('exp(t.estimate)')} AS geometric_ratio, {q6('t.estimate - c.critical * t.se')} AS task_low, {q6('t.estimate + c.critical * t.se')} AS task_high, {q6('t.estimate - g.critical * t.se')} AS global_low, {q6('t.estimate + g.critical * t.se')} AS global_high FROM task_told t JOIN task_crit c USING (tau, block, task) JOIN all_crit g USING (tau, block)", "task_told", "task_crit", "all_crit", recursive=True, extra=FHS | RATIO_SQL | draws_sql("tau", "ratios", RATIOS) | SPLIT | bands_sql("tau, block, task", name="task_") | {
    "all_draws": ("SELECT * FROM task_draws", ("task_draws",)), "all_est": ("SELECT * FROM task_est", ("task_est",))} | bands_sql("tau, block", "task", name="all_")))
def reference_log_es_ratios(spark, d):
    """Mean log ratio of each frame's ES to the numeraire's: bands over the four frames of a task, and over all tasks."""
    f = var_es(filtered_sets(spark, d), FKEYS).where("es > 0")
    at = lambda b, r, ref: F.max(F.when((F.col("book") == b) & (F.col("report") == r) & (F.col("reference") == ref), F.col("es")))
    daily = f.groupBy("tau", "t").agg(*[F.log(at(b, r, ref) / at(b, r, "base")).alias(f"{b}_{r}_{ref}") for b, r in TASKS for ref in REFERENCES[1:]]).dropna()
    split = lambda x: x.withColumn("task", F.regexp_extract("contrast", r"^(.*)_([^_]+)$", 1)).withColumn("contrast", F.regexp_extract("contrast", r"^(.*)_([^_]+)$", 2))
    draws, est = (split(x) for x in I.bootstrap(daily, ["tau"], RATIOS, BLOCKS, REPS))
    keys = ["tau", "block", "task", "contrast"]
    own = I.bands(draws, est, ["tau", "block", "task"]).select(*keys, "estimate", F.exp("estimate").alias("geometric_ratio"), F.col("simultaneous_low").alias("task_low"), F.col("simultaneous_high").alias("task_high"))
    every = I.bands(draws, est, ["tau", "block"], ["task"]).select(*keys, F.col("simultaneous_low").alias("global_low"), F.col("simultaneous_high").alias("global_high"))
    return told(own.join(every, keys))


# Model confidence set over the three windows.
def set_step_sql(step: int, least: str) -> dict:
    left = " AND ".join(f"({c}, tau) NOT IN (SELECT contrast, tau FROM step{k})" for k in range(1, step) for c in "ab") or "true"
    return {
        f"worst{step}": (f"SELECT tau, arg_max(a, (z, a)) AS contrast, max(z) AS statistic FROM zs WHERE {left} GROUP BY tau", ("zs", *(f"step{k}" for k in range(1, step)))),
        f"step{step}": (f"SELECT tau, contrast, {step} AS step, statistic, p, greatest(p, {least}) AS set_p FROM (SELECT tau, contrast, statistic, (count(*) FILTER (WHERE y >= statistic) + 1) / (count(*) + 1) AS p FROM (SELECT tau, rep, max(y) AS y FROM ys WHERE {left} GROUP BY ALL) JOIN worst{step} USING (tau) GROUP BY ALL) s", ("ys", f"worst{step}", *(f"step{k}" for k in range(1, step)))),
    }


CONFIDENCE = DAILY | draws_sql("tau", "whole_days", MODELS, BLOCKS[:1]) | {
    "es": ("SELECT tau, rep, contrast, mean - estimate AS e, estimate AS m FROM draws JOIN est USING (tau, contrast)", ("draws", "est")),
    "epairs": ("SELECT tau, rep, a.contrast AS a, b.contrast AS b, a.e - b.e AS e, a.m - b.m AS gap FROM es a JOIN es b USING (tau, rep) WHERE a.contrast <> b.contrast", ("es",)),
    "zs": ("SELECT tau, a, b, sqrt(avg(e * e)) AS sd, max(gap) / sqrt(avg(e * e)) AS z FROM epairs GROUP BY ALL", ("epairs",)),
    "ys": ("SELECT tau, rep, a, b, e / sd AS y FROM epairs JOIN zs USING (tau, a, b)", ("epairs", "zs")),
} | set_step_sql(1, "0") | set_step_sql(2, "(SELECT set_p FROM step1 o WHERE o.tau = s.tau)")


@query("model_confidence_set", sql(f"SELECT {TAU}, contrast, step, {q6('statistic')} AS statistic, {q6('p')} AS p, {q6('set_p')} AS set_p FROM (SELECT * FROM step1 UNION ALL SELECT * FROM step2 UNION ALL SELECT tau, contrast, 3, 0.0, 1.0, 1.0 FROM est WHERE (tau, contrast) NOT IN (SELECT tau, contrast FROM step1) AND (tau, contrast) NOT IN (SELECT tau, contrast FROM step2)) AS every", "step2", "est", extra=CONFIDENCE))
def model_confidence_set(spark, d):
    daily = daily_scores(spark, d)
    draws = I.block_means(daily, ["tau"], MODELS, BLOCKS[:1], REPS).drop("block")
    return told(I.confidence_set(draws, I.estimates(daily, ["tau"], MODELS), ["tau"], len(MODELS)))


# Joint test of breach rate and ES identification.
def hac_sql(values, lags: int, source: str, keys: str) -> str:
    """The same running sums, for values centred as z_<value>."""
    near = ", ".join(f"sum(z_{v}) OVER (w ROWS BETWEEN {lags} PRECEDING AND CURRENT ROW) AS n_{v}, CASE WHEN count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= {lags} THEN sum(z_{v}) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 0 END AS t_{v}" for v in values)
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k:]]
    cov = ", ".join(f"sum(n_{a} * n_{b} + t_{a} * t_{b}) / {lags + 1} / count(*) / count(*) AS cov_{a}_{b}" for a, b in pairs)
    return f"SELECT {keys}, count(*) AS n, {', '.join(f'max(m_{v}) AS mean_{v}' for v in values)}, {cov} FROM (SELECT *, {near} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t)) GROUP BY {keys}"


def centred_sql(keys: str, source: str) -> str:
    return f"SELECT *, avg(hit) OVER k AS m_hit, hit - avg(hit) OVER k AS z_hit, avg(u) OVER k AS m_u, u - avg(u) OVER k AS z_u FROM (SELECT *, tail_residual / es AS u FROM {source}) WINDOW k AS (PARTITION BY {keys})"


TASK_KEYS = "model, book, report, tau"
WALD = "(d * d * cov_u_u - 2 * d * mean_u * cov_hit_u + mean_u * mean_u * cov_hit_hit) / (cov_hit_hit * cov_u_u - cov_hit_u * cov_hit_u)"


@query("calibration_tests", sql(f"SELECT model, book, report, {TAU}, n, {q6('w')} AS statistic, CASE WHEN breaches >= 30 THEN {q6('exp(-w / 2)')} END AS p FROM (SELECT *, CASE WHEN cov_hit_hit * cov_u_u - cov_hit_u * cov_hit_u > 1e-30 THEN {WALD} END AS w FROM (SELECT *, mean_hit - (1 - CAST(tau AS DOUBLE)) AS d, round(mean_hit * n) AS breaches FROM cov)) AS c", "cov", extra={
    "centred2": (centred_sql(TASK_KEYS, "scores"), ("scores",)), "cov": (hac_sql(("hit", "u"), 20, "centred2", TASK_KEYS), ("centred2",))}))
def calibration_tests(spark, d):
    """Wald statistic of both moments with long-run covariances, two degrees of freedom; no p-value below 30 breaches, none where the covariance is singular."""
    s = scores(spark, d).withColumn("u", F.col("tail_residual") / F.col("es"))
    c = E.hac_covariances(s, ["hit", "u"], 20, "model", "book", "report", "tau")
    a, b, ab = (F.col(f"cov_{x}") for x in ("hit_hit", "u_u", "hit_u"))
    x, y = F.col("mean_hit") - (1 - F.col("tau").cast("double")), F.col("mean_u")
    det = a * b - ab * ab
    w = F.when(det > 1e-30, (x * x * b - 2 * x * y * ab + y * y * a) / det)
    told_ = c.withColumn("statistic", w)
    return told(told_.select("model", "book", "report", "tau", "n", "statistic", F.when(F.round(F.col("mean_hit") * F.col("n")) >= 30, F.exp(-F.col("statistic") / 2)).alias("p")))
