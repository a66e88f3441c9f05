"""Queries of losses, forecasts, scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.columns import array_mean, expected_shortfall, inverse_cdf, r6
from riskloom.operators import evaluate as E
from riskloom.operators import filters as G
from riskloom.operators.reshape import matrix
from riskloom.operators.selection import with_quantiles
from riskloom.operators.risk import TAUS, historical_sets, pooled, priced, realised, var_es, weighted_var_es, window_of
from riskloom.plans.base import KEYS, dated, forecasts, panel, returns, scores
from riskloom.sources.io import stored
from riskloom.plans.sql import BASE, K, WINDOWS, loss_sql, r6 as q6, risk_step, sql
from riskloom.operators.books import BOOKS, REFERENCES, REPORTS, basis

QUERIES, SQL = {}, {}
TAU = "CAST(tau AS DOUBLE) AS tau"


def query(name: str, text: str):
    def add(f):
        QUERIES[name], SQL[name] = f, text
        return f

    return add


def told(df):
    """Doubles at six decimals, tau as a double, counts and flags as they are."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def qs(*names: str) -> str:
    return ", ".join(f"{q6(n)} AS {n}" for n in names)


def with_risk(scenarios, tau=TAUS[0]):
    """Sets with their own VaR and ES at one level, without a join."""
    q = inverse_cdf(F.col("x"), F.lit(tau))
    return scenarios.withColumn("var", q).withColumn("es", expected_shortfall(F.col("x"), F.col("var"), F.lit(tau)))


@query("hs_cash_losses", sql(f"SELECT t, book, report, CAST(len(x) AS BIGINT) AS n, {q6('x[1]')} AS low, {q6('x[len(x)]')} AS high, {q6('list_avg(x)')} AS mean FROM sets250", "sets250"))
def hs_cash_losses(spark, d):
    x = F.col("x")
    return told(historical_sets(returns(spark, d), BASE).select(*KEYS, F.size(x).cast("long").alias("n"), F.element_at(x, 1).alias("low"), F.element_at(x, -1).alias("high"), array_mean(x).alias("mean")))


@query("hs_var_es", sql(f"SELECT model, t, book, report, n, {TAU}, {qs('var', 'es')} FROM forecasts", "forecasts"))
def hs_var_es(spark, d):
    return told(forecasts(spark, d))


@query("hs_scores", sql(f"SELECT model, t, book, report, {TAU}, {qs('actual', 'tail_residual', 'score')}, hit FROM scores", "scores"))
def hs_scores(spark, d):
    return told(scores(spark, d).select("model", *KEYS, "tau", "actual", "tail_residual", "score", "hit"))


@query("weighted_var_es", sql(f"""SELECT t, book, report, CAST(tau AS DOUBLE) AS tau, {q6('var')} AS var, {q6('var + sum(w * greatest(loss - var, 0.0)) / (1 - CAST(tau AS DOUBLE))')} AS es FROM
  (SELECT *, min(CASE WHEN round(run, 12) >= CAST(tau AS DOUBLE) THEN loss END) OVER (PARTITION BY t, book, report, tau) AS var FROM
   (SELECT *, sum(w) OVER (PARTITION BY t, book, report ORDER BY loss, s ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, (s - t + 251) / 31125.0 AS w FROM losses250)) CROSS JOIN taus) GROUP BY t, book, report, tau, var""", "losses250", "taus"))
def weighted(spark, d):
    """Weights rise with the date of the increment, from 1 to 249 parts."""
    slid = priced(returns(spark, d)).select((F.col("s") + 2).alias("t"), "book", "report", window_of(F.struct("loss", "s"), BASE - 1, "book", "report").alias("x")).where("x is not null")
    weigh = lambda x: F.struct(x["loss"].alias("loss"), x["s"].alias("s"), ((x["s"] - F.col("t") + BASE + 1) / 31125.0).alias("w"))
    return told(weighted_var_es(slid.withColumn("x", F.transform(F.sort_array("x"), weigh)), KEYS))


@query("hs_cash_labels", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM label_risk", "label_risk", extra={
    "labels": ("SELECT a.t, l.book, l.report, list_sort(list(l.actual)) AS x FROM realised l JOIN (SELECT t FROM panel WHERE t > 501) a ON l.t BETWEEN a.t - 501 AND a.t - 2 GROUP BY ALL", ("realised", "panel")),
    "label_risk": (risk_step("labels", "t, book, report"), ("labels", "taus"))}))
def hs_cash_labels(spark, d):
    """VaR and ES of the last 500 completed outcomes themselves."""
    done = realised(returns(spark, d)).withColumnRenamed("t", "s")
    slid = done.select((F.col("s") + 2).alias("t"), "book", "report", window_of(F.col("actual"), 500, "book", "report").alias("x")).where("x is not null")
    return told(var_es(slid.withColumn("x", F.sort_array("x")), KEYS))


@query("pool_mixture_var_es", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM pool_risk", "pool_risk", extra={
    "pool": ("SELECT t, book, report, list_sort(flatten(list(x))) AS x FROM (" + " UNION ALL ".join(f"SELECT * FROM sets{w}" for w in WINDOWS) + ") GROUP BY ALL", tuple(f"sets{w}" for w in WINDOWS)),
    "pool_risk": (risk_step("pool", "t, book, report"), ("pool", "taus"))}))
def pool_mixture(spark, d):
    r = returns(spark, d)
    return told(var_es(pooled(*[historical_sets(r, w) for w in WINDOWS], keys=tuple(KEYS)), KEYS))


SUMMARY = f"count(DISTINCT t) AS n_dates, count(*) AS n_tasks, {q6('avg(score)')} AS mean_score, {q6('avg(hit)')} AS breach_rate, {q6('avg(var)')} AS mean_var, {q6('avg(es)')} AS mean_es, {q6('median(es)')} AS median_es"


@query("model_summary", sql(f"SELECT {TAU}, model, {SUMMARY} FROM scores GROUP BY scores.tau, model", "scores"))
def model_summary(spark, d):
    return told(E.summary(scores(spark, d), "tau", "model"))


@query("task_summary", sql(f"SELECT {TAU}, model, book, report, {SUMMARY} FROM scores GROUP BY scores.tau, model, book, report", "scores"))
def task_summary(spark, d):
    return told(E.summary(scores(spark, d), "tau", "model", "book", "report"))


@query("yearly_summary", sql(f"SELECT CAST(year(d) AS INTEGER) AS year, {TAU}, model, {SUMMARY} FROM dated GROUP BY year(d), dated.tau, model", "dated"))
def yearly_summary(spark, d):
    return told(E.summary(dated(spark, d).withColumn("year", F.year("d")), "year", "tau", "model"))


@query("model_rank", sql(f"SELECT {TAU}, model, {q6('m')} AS mean_score, rank() OVER (PARTITION BY tau ORDER BY m) AS rank FROM (SELECT tau, model, avg(score) AS m FROM scores GROUP BY 1, 2) AS ranked", "scores"))
def model_rank(spark, d):
    return told(E.competition_rank(scores(spark, d).groupBy("tau", "model").agg(F.avg("score").alias("mean_score")), "mean_score", "tau"))


@query("daily_score_matrix", sql("SELECT t, " + TAU + ", " + ", ".join(q6(f"avg(CASE WHEN model = 'HS{w}' THEN score END)") + f" AS hs{w}" for w in WINDOWS) + f" FROM scores GROUP BY t, scores.tau HAVING count(DISTINCT model) = {len(WINDOWS)}", "scores"))
def daily_score_matrix(spark, d):
    """From the first origin on that all windows reach."""
    rows = scores(spark, d).where(F.col("t") > max(WINDOWS))
    return told(matrix(rows, ["t", "tau"], "model", [f"HS{w}" for w in WINDOWS], "score").select("t", "tau", *[F.col(f"HS{w}").alias(f"hs{w}") for w in WINDOWS]))


@query("regex_models", sql(f"SELECT {TAU}, model || '@' || report AS model_key, count(*) AS n FROM scores WHERE regexp_full_match(model, '(IN_)?HS\\d+') AND NOT starts_with(model, 'IN_TCOP') AND book IN ('funded_assets', 'net_cashflows') GROUP BY 1, 2", "scores"))
def regex_models(spark, d):
    kept = scores(spark, d).where(F.col("model").rlike(r"^(IN_)?HS\d+$") & ~F.col("model").startswith("IN_TCOP") & F.col("book").isin("funded_assets", "net_cashflows"))
    return kept.groupBy(F.col("tau").cast("double").alias("tau"), F.concat("model", F.lit("@"), "report").alias("model_key")).agg(F.count("*").alias("n"))


DISPERSION = ", ".join(["n", q6("span") + " AS span", q6("mean_abs") + " AS mean_abs", q6("CASE WHEN mean_abs > 0 THEN span / mean_abs END") + " AS relative", q6("CASE WHEN low <> 0 THEN high / low END") + " AS max_over_min"])


@query("window_dispersion", sql(f"SELECT t, book, report, {TAU}, {DISPERSION} FROM (SELECT t, book, report, tau, count(*) AS n, max(es) - min(es) AS span, avg(abs(es)) AS mean_abs, max(es) AS high, min(es) AS low FROM forecasts GROUP BY 1, 2, 3, 4) AS g", "forecasts"))
def window_dispersion(spark, d):
    return told(E.dispersion(forecasts(spark, d), [*KEYS, "tau"], "es"))


# Every model's ES beside those of the same task; models in order of their names.
BESIDE = {"beside": ("SELECT t, book, report, tau, " + ", ".join(f"max(CASE WHEN model = 'HS{w}' THEN es END) AS HS{w}" for w in WINDOWS) + " FROM forecasts GROUP BY ALL", ("forecasts",))}
PAIRS = [(a, b) for a in sorted(f"HS{w}" for w in WINDOWS) for b in sorted(f"HS{w}" for w in WINDOWS) if a < b]


@query("signed_pair_contrasts", sql(" UNION ALL ".join(f"SELECT t, book, report, {TAU}, '{a}' AS a, '{b}' AS b, {q6(f'({a} - {b}) / abs(HS250)')} AS contrast FROM beside WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND HS250 <> 0" for a, b in PAIRS), "beside", extra=BESIDE))
def signed_pair_contrasts(spark, d):
    return told(E.pair_contrasts(forecasts(spark, d), [*KEYS, "tau"], "model", "es", "HS250"))


PIT = {"pit": ("SELECT *, (cdf_left + cdf_right) / 2 AS pit FROM (SELECT t, book, report, len(list_filter(x, lambda v: v < actual)) / CAST(len(x) AS DOUBLE) AS cdf_left, len(list_filter(x, lambda v: v <= actual)) / CAST(len(x) AS DOUBLE) AS cdf_right, CAST(actual < x[1] AS INTEGER) AS below_support, CAST(actual > x[len(x)] AS INTEGER) AS above_support FROM sets250 JOIN realised USING (t, book, report))", ("sets250", "realised"))}


def pit(spark, d):
    r = returns(spark, d)
    return E.pit(historical_sets(r, BASE), realised(r), KEYS)


@query("pit_mid_cdf", sql(f"SELECT t, book, report, {qs('pit', 'cdf_left', 'cdf_right')}, below_support, above_support FROM pit", "pit", extra=PIT))
def pit_mid_cdf(spark, d):
    return told(pit(spark, d))


DECILE = " + ".join(f"CASE WHEN pit >= CAST({k / 10} AS DOUBLE) THEN 1 ELSE 0 END" for k in range(1, 10))


@query("pit_histogram", sql(f"SELECT book, report, CAST({DECILE} AS INTEGER) AS decile, count(*) AS n FROM pit GROUP BY ALL", "pit", extra=PIT))
def pit_histogram(spark, d):
    return pit(spark, d).groupBy("book", "report", E.decile(F.col("pit")).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query("pit_moments", sql(f"SELECT book, report, count(*) AS n, {q6('avg(pit)')} AS mean, {q6('stddev_samp(pit)')} AS sd, count(*) FILTER (WHERE pit = 0) AS zeros, count(*) FILTER (WHERE pit = 1) AS ones, count(*) FILTER (WHERE pit > 0.95) AS high, CAST(sum(below_support) AS BIGINT) AS below, CAST(sum(above_support) AS BIGINT) AS above FROM pit GROUP BY ALL", "pit", extra=PIT))
def pit_moments(spark, d):
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    u = F.col("pit")
    return told(pit(spark, d).groupBy("book", "report").agg(F.count("*").alias("n"), F.avg(u).alias("mean"), F.stddev_samp(u).alias("sd"), when(u == 0).alias("zeros"), when(u == 1).alias("ones"), when(u > 0.95).alias("high"), F.sum("below_support").alias("below"), F.sum("above_support").alias("above")))


@query("pit_ks", sql(f"SELECT book, report, {q6('max(greatest(i / n - pit, pit - (i - 1) / n))')} AS ks FROM (SELECT book, report, pit, CAST(row_number() OVER (PARTITION BY book, report ORDER BY pit) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY book, report) AS DOUBLE) AS n FROM pit) GROUP BY ALL", "pit", extra=PIT))
def pit_ks(spark, d):
    return told(E.ks_distance(pit(spark, d), "pit", "book", "report"))


@query("tail_leverage", sql(f"SELECT t, book, report, {TAU}, {q6('x[len(x)]')} AS maximum_loss, {q6('CASE WHEN total > 0 THEN (x[len(x)] - var) / total ELSE 0 END')} AS share, CAST(len(x) AS BIGINT) AS n FROM (SELECT s.*, f.tau, f.var, list_sum(list_transform(x, lambda v: greatest(v - f.var, 0.0))) AS total FROM sets250 s JOIN risk250 f USING (t, book, report)) AS j", "sets250", "risk250"))
def tail_leverage(spark, d):
    return told(E.tail_leverage(historical_sets(returns(spark, d), BASE), KEYS, TAUS))


@query("topk_support", sql(f"SELECT t, book, report, {q6('x[len(x)]')} AS loss FROM sets250 ORDER BY round(x[len(x)], 6) DESC, t, book, report LIMIT 100", "sets250"))
def topk_support(spark, d):
    x = historical_sets(returns(spark, d), BASE).select(*KEYS, F.element_at("x", -1).alias("loss"))
    return told(x).orderBy(F.desc("loss"), *KEYS).limit(100)


@query("support_summary", sql(f"SELECT book, report, {q6('max(high)')} AS maximum, {q6('quantile_cont(high, 0.99)')} AS p99, {q6('median(high / es)')} AS median_over_es FROM (SELECT t, book, report, x[len(x)] AS high FROM sets250) JOIN (SELECT * FROM risk250 WHERE tau = 0.95 AND es > 0) USING (t, book, report) GROUP BY ALL", "sets250", "risk250"))
def support_summary(spark, d):
    x = historical_sets(returns(spark, d), BASE)
    j = with_risk(x).where("es > 0").select("book", "report", F.element_at("x", -1).alias("high"), (F.element_at("x", -1) / F.col("es")).alias("over"))
    rows = stored(j, "support")
    g = rows.groupBy("book", "report").agg(F.max("high").alias("maximum"))
    return told(with_quantiles(g, rows, ["book", "report"], {"p99": ("high", 0.99), "median_over_es": ("over", 0.5)}))


@query("reporting_effects", sql(f"SELECT book, count(*) AS n, {q6('avg(b)')} AS mean_base, {q6('avg(s)')} AS mean_s1, {q6('stddev_samp(b)')} AS sd_base, {q6('stddev_samp(s)')} AS sd_s1, {q6('avg(abs(s - b))')} AS mean_abs_difference, {q6('max(abs(s - b))')} AS max_abs_difference FROM (SELECT t, book, max(CASE WHEN report = 'base' THEN actual END) AS b, max(CASE WHEN report = 's1' THEN actual END) AS s FROM realised GROUP BY 1, 2) GROUP BY book", "realised"))
def reporting_effects(spark, d):
    wide = realised(returns(spark, d)).groupBy("t", "book").pivot("report", ["base", "s1"]).agg(F.first("actual"))
    gap = F.abs(F.col("s1") - F.col("base"))
    return told(wide.groupBy("book").agg(F.count("*").alias("n"), F.avg("base").alias("mean_base"), F.avg("s1").alias("mean_s1"), F.stddev_samp("base").alias("sd_base"), F.stddev_samp("s1").alias("sd_s1"), F.avg(gap).alias("mean_abs_difference"), F.max(gap).alias("max_abs_difference")))


@query("ties_audit", sql(f"SELECT book, report, count(*) AS n, count(*) FILTER (WHERE gap = 0) AS ties, count(*) FILTER (WHERE gap < 1e-6) AS near, {q6('median(gap)')} AS median_gap FROM (SELECT s.book, s.report, list_min(list_filter(x, lambda v: v > f.var)) - f.var AS gap FROM sets250 s JOIN risk250 f USING (t, book, report) WHERE f.tau = 0.95) GROUP BY ALL", "sets250", "risk250"))
def ties_audit(spark, d):
    gap = F.array_min(F.filter("x", lambda v: v > F.col("var"))) - F.col("var")
    j = with_risk(historical_sets(returns(spark, d), BASE)).select("book", "report", gap.alias("gap"))
    return told(j.groupBy("book", "report").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gap") == 0, 1).otherwise(0)).alias("ties"), F.sum(F.when(F.col("gap") < 1e-6, 1).otherwise(0)).alias("near"), F.percentile("gap", 0.5).alias("median_gap")))


@query("precision_changes", sql(f"SELECT book, report, {TAU}, count(*) AS n, {q6('max(c)')} AS max_change, {q6('median(c)')} AS median_change FROM (SELECT l.book, l.report, l.tau, abs(h.es - l.es) / abs(h.es) AS c FROM risk500 l JOIN risk1250 h USING (t, book, report, tau) WHERE h.es <> 0) AS j GROUP BY book, report, j.tau", "risk500", "risk1250"))
def precision_changes(spark, d):
    f = forecasts(spark, d, (500, 1250))
    low, high = (f.where(F.col("model") == m).select(*KEYS, "tau", F.col("es").alias(n)) for m, n in (("HS500", "low"), ("HS1250", "high")))
    c = F.abs(F.col("high") - F.col("low")) / F.abs(F.col("high"))
    return told(low.join(high, [*KEYS, "tau"]).where("high <> 0").groupBy("book", "report", "tau").agg(F.count("*").alias("n"), F.max(c).alias("max_change"), F.percentile(c, 0.5).alias("median_change")))


@query("sign_changes", sql("SELECT a.book, a.report, CAST(a.tau AS DOUBLE) AS tau, count(*) AS n, count(*) FILTER (WHERE sign(a.es - b.es) <> sign(a.es - c.es)) AS changes, count(*) FILTER (WHERE abs(b.es - c.es) > abs(a.es - b.es)) AS exceeds FROM risk250 a JOIN risk500 b USING (t, book, report, tau) JOIN risk1250 c USING (t, book, report, tau) GROUP BY a.book, a.report, a.tau", "risk250", "risk500", "risk1250"))
def sign_changes(spark, d):
    wide = forecasts(spark, d).groupBy(*KEYS, "tau").pivot("model", [f"HS{w}" for w in WINDOWS]).agg(F.first("es")).dropna()
    a, b, c = (F.col(f"HS{w}") for w in WINDOWS)
    when = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return told(wide.groupBy("book", "report", "tau").agg(F.count("*").alias("n"), when(F.signum(a - b) != F.signum(a - c)).alias("changes"), when(F.abs(b - c) > F.abs(a - b)).alias("exceeds")))


@query("rolling_breach_250", sql(f"SELECT t, book, report, CASE WHEN n >= 250 THEN {q6('m')} END AS breach_rate FROM (SELECT t, book, report, count(*) OVER w AS n, avg(hit) OVER w AS m FROM scores WHERE model = 'HS250' AND tau = 0.95 WINDOW w AS (PARTITION BY book, report ORDER BY t ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))", "scores"))
def rolling_breach_250(spark, d):
    w = Window.partitionBy("book", "report").orderBy("t").rowsBetween(-249, 0)
    s = scores(spark, d, (250,)).where("tau = 0.95")
    return s.select(*KEYS, F.when(F.count("*").over(w) >= 250, r6(F.avg("hit").over(w))).alias("breach_rate"))


@query("known_lag_hit", sql(f"SELECT t, book, report, {TAU}, hit, lag(hit, 2) OVER (PARTITION BY book, report, tau ORDER BY t) AS known_hit FROM scores WHERE model = 'HS250'", "scores"))
def known_lag_hit(spark, d):
    s = E.known_lag(scores(spark, d, (250,)), "hit", 2, "book", "report", "tau")
    return told(s.select(*KEYS, "tau", "hit", "known_hit"))


@query("calibration_moments", sql(f"SELECT model, book, report, {TAU}, count(*) AS n, CAST(sum(hit) AS BIGINT) AS breaches, {q6('count(*) * (1 - CAST(scores.tau AS DOUBLE))')} AS expected, {q6('avg(hit)')} AS breach_rate, {q6('avg(tail_residual / es)')} AS es_identification, sum(hit) < 30 AS sparse FROM scores GROUP BY model, book, report, scores.tau", "scores"))
def calibration_moments(spark, d):
    g = scores(spark, d).groupBy("model", "book", "report", "tau").agg(F.count("*").alias("n"), F.sum("hit").alias("breaches"), F.avg("hit").alias("breach_rate"), F.avg(F.col("tail_residual") / F.col("es")).alias("es_identification"))
    return told(g.withColumn("expected", F.col("n") * (1 - F.col("tau").cast("double"))).withColumn("sparse", F.col("breaches") < 30))


def hac_terms(lags: int) -> str:
    return " + ".join(f"{2 * (1 - k / (lags + 1))!r} * z * coalesce(lag(z, {k}) OVER w, 0)" for k in range(1, lags + 1))


@query("hac_rate", sql(" UNION ALL ".join(f"SELECT {lags} AS lags, book, report, {TAU}, count(*) AS n, {q6('max(m)')} AS mean, {q6('sqrt(greatest(sum(term) / count(*) / count(*), 0))')} AS se FROM (SELECT *, z * z + {hac_terms(lags)} AS term FROM centred WINDOW w AS (PARTITION BY book, report, tau ORDER BY t)) AS g GROUP BY book, report, g.tau" for lags in (20, 60)), "centred", extra={
    "centred": ("SELECT t, book, report, tau, avg(hit) OVER w AS m, hit - avg(hit) OVER w AS z FROM scores WHERE model = 'HS250' WINDOW w AS (PARTITION BY book, report, tau)", ("scores",))}))
def hac_rate(spark, d):
    s = scores(spark, d, (BASE,))
    every = [E.hac_variance(s, "hit", lags, "book", "report", "tau").withColumn("lags", F.lit(lags)) for lags in (20, 60)]
    return told(every[0].unionByName(every[1]).select("lags", "book", "report", "tau", "n", "mean", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("se")))


@query("equal_combination", sql(f"SELECT t, book, report, {TAU}, {q6('avg(var)')} AS var, {q6('avg(es)')} AS es FROM forecasts GROUP BY t, book, report, forecasts.tau HAVING count(*) = 3", "forecasts"))
def equal_combination(spark, d):
    g = forecasts(spark, d).groupBy(*KEYS, "tau").agg(F.avg("var").alias("var"), F.avg("es").alias("es"), F.count("*").alias("n"))
    return told(g.where("n = 3").drop("n"))


PAST = {
    "past": ("SELECT c.y, s.book, s.report, s.tau, s.model, avg(score) AS m FROM scores s JOIN (SELECT year(d) + 1 AS y, max(t) AS cutoff FROM panel GROUP BY 1) c ON s.t + 2 <= c.cutoff AND s.t > c.cutoff - 902 GROUP BY 1, 2, 3, 4, 5", ("scores", "panel")),
    "best": ("SELECT y, book, report, tau, model, m FROM (SELECT *, row_number() OVER (PARTITION BY y, book, report, tau ORDER BY round(m, 9), model) AS rn FROM past) WHERE rn = 1", ("past",)),
}


def past_scores(spark, d):
    cut = panel(spark, d).groupBy((F.year("d") + 1).alias("y")).agg(F.max("t").alias("cutoff"))
    s = scores(spark, d)
    return s.join(F.broadcast(cut), (F.col("t") + 2 <= F.col("cutoff")) & (F.col("t") > F.col("cutoff") - 902))


@query("past_best", sql(f"SELECT CAST(b.y AS BIGINT) AS year, b.book, b.report, CAST(b.tau AS DOUBLE) AS tau, b.model, {q6('b.m')} AS past_score FROM best b", "best", extra=PAST))
def past_best(spark, d):
    """The model with the best mean score over the last 900 completed origins before each year."""
    m = past_scores(spark, d).groupBy("y", "book", "report", "tau", "model").agg(F.avg("score").alias("m"))
    g = m.groupBy("y", "book", "report", "tau").agg(F.min(F.struct(F.round("m", 9).alias("r"), "model", "m")).alias("x"))
    return told(g.select(F.col("y").cast("long").alias("year"), "book", "report", "tau", "x.model", F.col("x.m").alias("past_score")))


@query("reference_past_best", sql(f"SELECT CAST(y AS BIGINT) AS year, model, {q6('m')} AS past_score FROM (SELECT y, model, m, row_number() OVER (PARTITION BY y ORDER BY round(m, 9), model) AS rn FROM (SELECT y, model, avg(m) AS m FROM past WHERE tau = 0.95 GROUP BY 1, 2)) WHERE rn = 1", "past", extra=PAST))
def reference_past_best(spark, d):
    """One choice a year, by the mean over tasks at 0.95, used for both tails."""
    m = past_scores(spark, d).where("tau = 0.95").groupBy("y", "book", "report", "model").agg(F.avg("score").alias("m")).groupBy("y", "model").agg(F.avg("m").alias("m"))
    g = m.groupBy("y").agg(F.min(F.struct(F.round("m", 9).alias("r"), "model", "m")).alias("x"))
    return told(g.select(F.col("y").cast("long").alias("year"), "x.model", F.col("x.m").alias("past_score")))


# Filters with given parameters.
P = G.Garch()
X100 = " UNION ALL ".join(f"SELECT t, '{ref}' AS reference, '{node}' AS node, 100 * ({' + '.join(f'CAST({x} AS DOUBLE) * r{k}' for k, x in zip(K, c, strict=True))}) AS x FROM returns" for ref in REFERENCES for node, c in basis(ref))
FILTER = {
    "x100": (X100, ("returns",)),
    "garch": (f"SELECT t, reference, node, x, CAST({P.h0} AS DOUBLE) AS h FROM x100 WHERE t = 1 UNION ALL SELECT n.t, n.reference, n.node, n.x, greatest({P.omega} + {P.alpha} * (g.x - {P.mu}) * (g.x - {P.mu}) + {P.beta} * g.h, 1e-10) FROM garch g JOIN x100 n ON n.t = g.t + 1 AND n.reference = g.reference AND n.node = g.node", ("x100",)),
    "resid": (f"SELECT *, (x - {P.mu}) / sqrt(h) AS z, (x - {P.mu}) / sqrt({P.omega} + {P.alpha} * (x - {P.mu}) * (x - {P.mu}) + {P.beta} * h) AS zpost FROM garch", ("garch",)),
}


@query("garch_path_fixed", sql(f"SELECT t, reference, node, {qs('h', 'z', 'zpost')} FROM resid", "resid", extra=FILTER, recursive=True))
def garch_path_fixed(spark, d):
    return told(G.filtered(returns(spark, d), P).select("t", "reference", "node", "h", "z", "zpost"))


EWMA = {
    "products": (" UNION ALL ".join(f"SELECT t, {i} AS i, {j} AS j, r{i} AS a, r{j} AS b FROM returns" for i in K for j in K if i <= j), ("returns",)),
    "ewma": ("SELECT t, i, j, 0.94 * (SELECT covar_samp(q.a, q.b) FROM products q WHERE q.t <= 20 AND q.i = p.i AND q.j = p.j) + 0.06 * a * b AS cov FROM products p WHERE t = 1 UNION ALL SELECT p.t, p.i, p.j, 0.94 * e.cov + 0.06 * p.a * p.b FROM ewma e JOIN products p ON p.t = e.t + 1 AND p.i = e.i AND p.j = e.j", ("products",)),
}


@query("ewma_cov_fixed", sql(f"SELECT t, i, j, {q6('cov')} AS cov FROM ewma", "ewma", extra=EWMA, recursive=True))
def ewma_cov_fixed(spark, d):
    return told(G.ewma_covariance(returns(spark, d)))


# Gaussian scenarios with the exponentially weighted covariance.
DRAWS = 4096
L = {(1, 1): "sqrt(c11)"} | {(k, 1): f"c1{k} / l11" for k in (2, 3, 4)}
for j_ in (2, 3, 4):
    L[j_, j_] = f"sqrt(c{j_}{j_}" + "".join(f" - l{j_}{m} * l{j_}{m}" for m in range(1, j_)) + ")"
    L |= {(k, j_): f"(c{j_}{k}" + "".join(f" - l{k}{m} * l{j_}{m}" for m in range(1, j_)) + f") / l{j_}{j_}" for k in range(j_ + 1, 5)}
ROOT = "SELECT t + 1 AS t, " + ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN cov END) AS c{i}{j}" for i in K for j in K if i <= j) + " FROM ewma WHERE t + 1 > 20 GROUP BY 1"
for j_ in K:
    ROOT = f"SELECT *, {L[j_, j_]} AS l{j_}{j_} FROM ({ROOT})"
    ROOT = f"SELECT *, {', '.join(f'{L[k, j_]} AS l{k}{j_}' for k in range(j_ + 1, 5))} FROM ({ROOT})" if j_ < 4 else ROOT
UNIFORM = "(CAST(CAST('0x' || substr(md5('1:' || i || ':{0}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
POLAR = ", ".join(f"sqrt(-2 * ln({UNIFORM.format(j)})) * {f}(2 * pi() * ({UNIFORM.format(j + 1)})) AS z{j + k}" for j in (0, 2, 4, 6) for k, f in enumerate(("cos", "sin")))
STEP = ", ".join(" + ".join(f"l{k}{m} * z{m - 1 + o}" for m in range(1, k + 1)) + f" AS {n}{k}" for n, o in (("a", 0), ("b", 4)) for k in K)
ALL_TASKS = [(book, report) for book in BOOKS for report in REPORTS]


def gauss_sql(draws: int) -> dict:
    lists = ", ".join(f"list_sort(list({loss_sql(book, REPORTS[report])})) AS x{i}" for i, (book, report) in enumerate(ALL_TASKS))
    n = "" if draws == DRAWS else str(draws)
    return EWMA | {
        "roots": (ROOT, ("ewma",)),
        f"normal{n}": (f"SELECT {POLAR} FROM (SELECT unnest(range({draws})) AS i)", ()),
        f"glists{n}": (f"SELECT t, {lists} FROM (SELECT t, {STEP} FROM roots CROSS JOIN normal{n}) GROUP BY t", ("roots", f"normal{n}")),
        f"gsets{n}": (" UNION ALL ".join(f"SELECT t, '{book}' AS book, '{report}' AS report, x{i} AS x FROM glists{n}" for i, (book, report) in enumerate(ALL_TASKS)), (f"glists{n}",)),
        f"grisk{n}": (risk_step(f"gsets{n}", "t, book, report"), (f"gsets{n}", "taus")),
    }


@query("ewma_gauss", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM grisk", "grisk", extra=gauss_sql(DRAWS), recursive=True))
def ewma_gauss(spark, d):
    return told(var_es(G.gaussian_sets(returns(spark, d), DRAWS), KEYS))


SEED2 = lambda text: text.replace("md5('1:'", "md5('2:'")
LENGTHS = [f"sqrt({' + '.join(f'z{m} * z{m}' for m in range(o, o + 4))})" for o in (0, 4)]
INSIDE = ["r1 / l11", "(r2 - l21 * y1) / l22", "(r3 - l31 * y1 - l32 * y2) / l33", "(r4 - l41 * y1 - l42 * y2 - l43 * y3) / l44"]
WHITE = "SELECT o.*, r.r1, r.r2, r.r3, r.r4 FROM roots o JOIN returns r ON r.t = o.t - 1"
for k_, e_ in enumerate(INSIDE, 1):
    WHITE = f"SELECT *, {e_} AS y{k_} FROM ({WHITE})"
RSTEP = ", ".join("(" + " + ".join(f"o.l{k}{m} * d.z{m - 1 + o}" for m in range(1, k + 1)) + f") / d.length{n} * ({p}.radius / o.scale) AS {x}{k}" for x, o, n, p in (("a", 0, 1, "p"), ("b", 4, 2, "q")) for k in K)
RADIAL = gauss_sql(DRAWS) | {
    "rdraws": (SEED2(f"SELECT *, {LENGTHS[0]} AS length1, {LENGTHS[1]} AS length2 FROM (SELECT {POLAR}, CAST(floor(({UNIFORM.format(8)}) * {BASE}) AS BIGINT) AS i1, CAST(floor(({UNIFORM.format(9)}) * {BASE}) AS BIGINT) AS i2 FROM (SELECT unnest(range({DRAWS})) AS i))"), ()),
    "radii": (f"SELECT *, sqrt(y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4) AS radius FROM ({WHITE})", ("roots", "returns")),
    "rorigins": (f"SELECT * FROM (SELECT *, count(*) OVER w AS have, sqrt(avg(radius * radius) OVER w / 4) AS scale FROM radii WINDOW w AS (ORDER BY t ROWS BETWEEN {BASE - 1} PRECEDING AND CURRENT ROW)) WHERE have = {BASE}", ("radii",)),
    "glists": (f"SELECT t, {', '.join(f'list_sort(list({loss_sql(book, REPORTS[report])})) AS x{i}' for i, (book, report) in enumerate(ALL_TASKS))} FROM (SELECT o.t, {RSTEP} FROM rorigins o CROSS JOIN rdraws d JOIN radii p ON p.t = o.t - {BASE - 1} + d.i1 JOIN radii q ON q.t = o.t - {BASE - 1} + d.i2) GROUP BY t", ("rorigins", "rdraws", "radii")),
}


@query("radial", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM grisk", "grisk", extra=RADIAL, recursive=True))
def radial(spark, d):
    return told(var_es(G.radial_sets(returns(spark, d), BASE, DRAWS), KEYS))


@query("precision_draws", sql(f"SELECT book, report, {TAU}, count(*) AS n, {q6('max(c)')} AS max_change, {q6('median(c)')} AS median_change, count(*) FILTER (WHERE c > 0.05) AS above_5_percent FROM (SELECT l.book, l.report, l.tau, abs(h.es - l.es) / abs(h.es) AS c FROM grisk1024 l JOIN grisk h USING (t, book, report, tau) WHERE h.es <> 0) AS j GROUP BY book, report, j.tau", "grisk", "grisk1024", extra=gauss_sql(DRAWS) | gauss_sql(1024), recursive=True))
def precision_draws(spark, d):
    """Relative change of ES from the first quarter of the draws to all of them, both from one pricing of the paths."""
    es = var_es(G.gaussian_prefixes(returns(spark, d), [DRAWS // 4, DRAWS]), [*KEYS, "draws"])
    each = [F.max(F.when(F.col("draws") == n, F.col("es"))).alias(name) for n, name in ((DRAWS // 4, "low"), (DRAWS, "high"))]
    c = F.abs(F.col("high") - F.col("low")) / F.abs(F.col("high"))
    j = es.groupBy(*KEYS, "tau").agg(*each).where("high <> 0").select("book", "report", "tau", c.alias("c"))
    rows, keys = stored(j, "changes"), ["book", "report", "tau"]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("c").alias("max_change"), F.sum((F.col("c") > 0.05).cast("int")).alias("above_5_percent"))
    return told(with_quantiles(g, rows, keys, {"median_change": ("c", 0.5)}))


def nodes_sql(form: str) -> str:
    return ", ".join(form.replace("#", n) for n in REFERENCES)


def paths_sql(residual: str, standardise: bool, w: int = BASE, h: int = 1) -> dict:
    """Steps from residuals to sets; the path is walked one step a subquery."""
    ahead = ", ".join(nodes_sql(f"lead(z_#, {k}) OVER (PARTITION BY reference ORDER BY t) AS z{k}_#") for k in range(h + 1))
    scale = (lambda k: nodes_sql(f"(p.z{k}_# - c.m_#) / c.sd_# AS z{k}_#")) if standardise else (lambda k: nodes_sql(f"p.z{k}_#"))
    moments = nodes_sql("avg(z_#) OVER o AS m_#, stddev_pop(z_#) OVER o AS sd_#")
    walk = "SELECT c.t, c.reference, " + ", ".join(scale(k) for k in range(h + 1)) + ", " + nodes_sql("c.h_# AS v_#, CAST(NULL AS DOUBLE) AS a_#, CAST(0 AS DOUBLE) AS b_#") + f" FROM zahead p JOIN zorigins c ON p.reference = c.reference AND p.t BETWEEN c.t - {w} AND c.t - {h + 1}"
    for k in range(h + 1):
        rest = "".join(f", {nodes_sql(f'z{m}_#')}" for m in range(k + 1, h + 1))
        r = f"({P.mu} + sqrt(v_#) * z{k}_#) / 100"
        told_ = nodes_sql(f"{r} AS a_#, b_#" if k == 0 else f"a_#, b_# + {r} AS b_#")
        walk = f"SELECT t, reference{rest}, {told_}, " + nodes_sql(f"{P.omega} + {P.alpha} * v_# * z{k}_# * z{k}_# + {P.beta} * v_# AS v_#") + f" FROM ({walk})"
    tasks_ = [(book, report) for book in BOOKS for report in REPORTS]
    lists = ", ".join(f"list_sort(list({loss_sql(book, REPORTS[report])})) AS x{i}" for i, (book, report) in enumerate(tasks_))
    return FILTER | {
        "zs": (f"SELECT t, reference, node, h, {residual} AS zz FROM resid", ("resid",)),
        "zwide": ("SELECT t, reference, " + nodes_sql("max(CASE WHEN node = '#' THEN zz END) AS z_#, max(CASE WHEN node = '#' THEN h END) AS h_#") + " FROM zs GROUP BY 1, 2", ("zs",)),
        "zahead": (f"SELECT t, reference, {ahead} FROM zwide", ("zwide",)),
        "zorigins": (f"SELECT * FROM (SELECT *, {moments} FROM zwide WINDOW o AS (PARTITION BY reference ORDER BY t ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)) WHERE t > {w}", ("zwide",)),
        "fpaths": ("SELECT t, reference, " + ", ".join(f"coalesce({o}_s{k}, 0) - coalesce({o}_base, 0) AS {o}{k}" for o in "ab" for k in K) + f" FROM ({walk})", ("zahead", "zorigins")),
        "flists": (f"SELECT t, reference, {lists} FROM fpaths GROUP BY 1, 2", ("fpaths",)),
        "fsets": (" UNION ALL ".join(f"SELECT t, reference, '{book}' AS book, '{report}' AS report, x{i} AS x FROM flists" for i, (book, report) in enumerate(tasks_)), ("flists",)),
        "frisk": (risk_step("fsets", "t, book, report, reference"), ("fsets", "taus")),
        "fpooled": ("SELECT t, book, report, list_sort(flatten(list(x))) AS x FROM fsets GROUP BY ALL", ("fsets",)),
        "fpool": (risk_step("fpooled", "t, book, report"), ("fpooled", "taus")),
        "w1": ("SELECT a.t, a.book, a.report, a.reference AS a, b.reference AS b, list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))) / len(a.x) AS w1 FROM fsets a JOIN fsets b USING (t, book, report) WHERE a.reference < b.reference", ("fsets",)),
    }


FHS, INFHS = paths_sql("z", False), paths_sql("zpost", True, 1250)
FKEYS = [*KEYS, "reference"]


def filtered_sets(spark, d, residual: str = "z", standardise: bool = False, window: int = BASE, h: int = 1):
    return G.filtered_sets(returns(spark, d), P, window, residual, standardise, h)


FRISK = f"SELECT t, book, report, reference, n, {TAU}, {qs('var', 'es')} FROM frisk"

@query("fhs_var_es", sql(FRISK, "frisk", extra=FHS, recursive=True))
def fhs_var_es(spark, d):
    return told(var_es(filtered_sets(spark, d), FKEYS))


def long_window(window: int, h: int):
    def run(spark, d):
        return told(var_es(filtered_sets(spark, d, window=window, h=h), FKEYS))

    return run


for window_, h_ in ((500, 1), (1250, 1), (250, 5), (250, 20)):
    query(f"fhs_{window_}_h{h_}", sql(FRISK, "frisk", extra=paths_sql("z", False, window_, h_), recursive=True))(long_window(window_, h_))


@query("internal_fhs_var_es", sql(FRISK, "frisk", extra=INFHS, recursive=True))
def internal_fhs_var_es(spark, d):
    return told(var_es(filtered_sets(spark, d, "zpost", True, 1250), FKEYS))


@query("reference_pool_var_es", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM fpool", "fpool", extra=FHS, recursive=True))
def reference_pool_var_es(spark, d):
    return told(var_es(pooled(filtered_sets(spark, d), keys=tuple(KEYS)), KEYS))


@query("reference_range", sql(f"SELECT t, book, report, {TAU}, {DISPERSION} FROM (SELECT t, book, report, tau, count(*) AS n, max(es) - min(es) AS span, avg(abs(es)) AS mean_abs, max(es) AS high, min(es) AS low FROM frisk GROUP BY 1, 2, 3, 4) AS g", "frisk", extra=FHS, recursive=True))
def reference_range(spark, d):
    return told(E.dispersion(var_es(filtered_sets(spark, d), FKEYS), [*KEYS, "tau"], "es"))


@query("wasserstein_pairs", sql(f"SELECT t, book, report, a, b, {q6('w1')} AS w1 FROM w1", "w1", extra=FHS, recursive=True))
def wasserstein_pairs(spark, d):
    return told(E.wasserstein(filtered_sets(spark, d), KEYS, "reference"))


FACT = {"cells": ("SELECT t, book, reference, report, tau, ln(es) AS x FROM frisk QUALIFY min(es) OVER (PARTITION BY t, book) > 0", ("frisk",))}
MARGINS = {"m0": "", "mr": ", reference", "mn": ", report", "mq": ", tau", "mrn": ", reference, report", "mrq": ", reference, tau", "mnq": ", report, tau"}
EFFECTS = {"reference": "mr - m0", "report": "mn - m0", "tau": "mq - m0", "reference x report": "mrn - mr - mn + m0", "reference x tau": "mrq - mr - mq + m0", "report x tau": "mnq - mn - mq + m0", "reference x report x tau": "x - mrn - mrq - mnq + mr + mn + mq - m0"}


@query("factorial_decomposition", sql("SELECT book, factor, " + q6("ss") + " AS ss, " + q6("total") + " AS total, " + q6("CASE WHEN total > 0 THEN ss / total END") + " AS share FROM (" + " UNION ALL ".join(f"SELECT book, '{n}' AS factor, sum(({e}) * ({e})) AS ss, sum((x - m0) * (x - m0)) AS total FROM margins GROUP BY book" for n, e in EFFECTS.items()) + ")", "margins", extra=FHS | FACT | {"margins": ("SELECT *, " + ", ".join(f"avg(x) OVER (PARTITION BY t, book{c}) AS {n}" for n, c in MARGINS.items()) + " FROM cells", ("cells",))}, recursive=True))
def factorial_decomposition(spark, d):
    f = var_es(filtered_sets(spark, d), FKEYS).withColumn("low", F.min("es").over(Window.partitionBy("t", "book"))).where("low > 0")
    return told(E.factorial(f, ["t", "book"], ["reference", "report", "tau"], F.log("es"), "book"))
