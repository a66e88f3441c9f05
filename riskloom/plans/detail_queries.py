"""Queries of bounds, yearly spans, quantiles at given levels, pairings and set checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.columns import array_mean
from riskloom.operators import evaluate as E
from riskloom.operators.joins import components_of, one_to_one
from riskloom.operators.panel import history
from riskloom.operators.risk import realised, var_es
from riskloom.plans.base import KEYS, forecasts, panel, read, returns, scores
from riskloom.plans.risk_queries import FHS, FKEYS, filtered_sets, told
from riskloom.plans.sql import r6 as q6, sql

QUERIES, SQL = {}, {}


def query(name: str, text: str):
    def add(f):
        QUERIES[name], SQL[name] = f, text
        return f

    return add


@query("wasserstein_bound", sql(f"SELECT t, book, report, CAST(tau AS DOUBLE) AS tau, {q6('span')} AS span, {q6('w1')} AS w1, {q6('w1 / (1 - CAST(tau AS DOUBLE))')} AS bound, span <= w1 / (1 - CAST(tau AS DOUBLE)) + 1e-9 AS holds FROM (SELECT t, book, report, tau, max(es) - min(es) AS span FROM frisk GROUP BY 1, 2, 3, 4) JOIN (SELECT t, book, report, max(w1) AS w1 FROM w1 GROUP BY 1, 2, 3) USING (t, book, report)", "frisk", "w1", extra=FHS, recursive=True))
def wasserstein_bound(spark, d):
    """The range of ES over frames never exceeds the largest distance of two frames' laws over 1 - tau."""
    losses = filtered_sets(spark, d)
    far = E.wasserstein(losses, KEYS, "reference").groupBy(*KEYS).agg(F.max("w1").alias("w1"))
    span = var_es(losses, FKEYS).groupBy(*KEYS, "tau").agg((F.max("es") - F.min("es")).alias("span"))
    j = span.join(far, KEYS).withColumn("bound", F.col("w1") / (1 - F.col("tau").cast("double")))
    return told(j.withColumn("holds", F.col("span") <= F.col("bound") + 1e-9))


@query("annual_span_medians", sql(f"SELECT CAST(year(p.d) AS INTEGER) AS year, book, report, CAST(g.tau AS DOUBLE) AS tau, {q6('median(CASE WHEN m > 0 THEN span / m END)')} AS median_relative, {q6('median(span)')} AS median_span FROM (SELECT t, book, report, tau, max(es) - min(es) AS span, avg(abs(es)) AS m FROM forecasts GROUP BY 1, 2, 3, 4) AS g JOIN panel p USING (t) GROUP BY year(p.d), book, report, g.tau", "forecasts", "panel"))
def annual_span_medians(spark, d):
    s = E.dispersion(forecasts(spark, d), [*KEYS, "tau"], "es").join(F.broadcast(panel(spark, d).select("t", F.year("d").alias("year"))), "t")
    return told(s.groupBy("year", "book", "report", "tau").agg(F.percentile("relative", 0.5).alias("median_relative"), F.percentile("span", 0.5).alias("median_span")))


LEVELS = (0.01, 0.1, 0.35, 0.5, 0.8, 0.99)


@query("quantiles_at_levels", sql(f"SELECT t, u, {q6('x[least(CAST(floor(u * len(x)) AS INTEGER), len(x) - 1) + 1]')} AS discrete, {q6('quantile')} AS linear FROM (SELECT t, u, list_sort(list(r1)) AS x, list_sort(list(r1))[CAST(floor(u * (count(*) - 1)) AS INTEGER) + 1] + (list_sort(list(r1))[least(CAST(floor(u * (count(*) - 1)) AS INTEGER) + 2, count(*))] - list_sort(list(r1))[CAST(floor(u * (count(*) - 1)) AS INTEGER) + 1]) * (u * (count(*) - 1) - floor(u * (count(*) - 1))) AS quantile FROM (SELECT o.t, r.r1 FROM returns r JOIN (SELECT unnest(range(61, (SELECT max(t) FROM returns) + 60)) AS t) o ON r.t BETWEEN o.t - 60 AND o.t - 2) CROSS JOIN (SELECT unnest([{', '.join(f'CAST({u} AS DOUBLE)' for u in LEVELS)}]) AS u) GROUP BY t, u)", "returns"))
def quantiles_at_levels(spark, d):
    """Empirical quantiles of each origin's window at given levels: the discrete rule, and linear interpolation."""
    rows = history(returns(spark, d).select(F.col("t").alias("s"), "r1"), 60)
    last = returns(spark, d).agg(F.max("t").alias("last"))
    g = rows.join(F.broadcast(last)).where("t < last + 60").groupBy("t").agg(F.sort_array(F.collect_list("r1")).alias("x"))
    e = g.withColumn("u", F.explode(F.array(*[F.lit(u) for u in LEVELS])))
    n = F.size("x")
    at = F.floor(F.col("u") * (n - 1)).cast("int")
    low, high = F.element_at("x", at + 1), F.element_at("x", F.least(at + 2, n))
    discrete = F.element_at("x", F.least(F.floor(F.col("u") * n).cast("int"), n - 1) + 1)
    return told(e.select("t", "u", discrete.alias("discrete"), (low + (high - low) * (F.col("u") * (n - 1) - at)).alias("linear")))


@query("ordered_model_pairs", sql(f"SELECT CAST(a.tau AS DOUBLE) AS tau, a.model AS a, b.model AS b, {q6('a.m - b.m')} AS difference FROM means a JOIN means b ON a.tau = b.tau AND a.model <> b.model", "means", extra={"means": ("SELECT tau, model, avg(score) AS m FROM scores GROUP BY 1, 2", ("scores",))}))
def ordered_model_pairs(spark, d):
    m = scores(spark, d).groupBy("tau", "model").agg(F.avg("score").alias("m"))
    a, b = m.select("tau", F.col("model").alias("a"), F.col("m").alias("x")), m.select("tau", F.col("model").alias("b"), F.col("m").alias("y"))
    return told(a.join(b, "tau").where("a <> b").select("tau", "a", "b", (F.col("x") - F.col("y")).alias("difference")))


@query("index_alignment", "SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS only_lines, count(*) FILTER (WHERE k IS NULL) AS only_orders, count(*) FILTER (WHERE o_orderkey = k) AS aligned FROM orders FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k")
def index_alignment(spark, d):
    o, k = read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    when = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    j = o.join(k, F.col("o_orderkey") == F.col("k"), "full_outer")
    return j.agg(when(F.col("o_orderkey").isNull())("only_lines"), when(F.col("k").isNull())("only_orders"), when(F.col("o_orderkey") == F.col("k"))("aligned"))


@query("set_difference", "(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("stable_seeds", "SELECT n_name, sha256(n_name) AS digest, CAST('0x' || substr(sha256(n_name), 7, 2) || substr(sha256(n_name), 5, 2) || substr(sha256(n_name), 3, 2) || substr(sha256(n_name), 1, 2) AS BIGINT) AS seed FROM nation")
def stable_seeds(spark, d):
    """A seed from the first four bytes of a digest, little end first."""
    h = F.sha2("n_name", 256)
    swapped = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return read(spark, d, "nation").select("n_name", h.alias("digest"), F.conv(swapped, 16, 10).cast("long").alias("seed"))


@query("first_and_best", sql("SELECT t, book, report, CAST(tau AS DOUBLE) AS tau, min_by(model, es) AS lowest, max_by(model, es) AS highest FROM forecasts GROUP BY t, book, report, forecasts.tau HAVING count(DISTINCT es) = 3", "forecasts"))
def first_and_best(spark, d):
    g = forecasts(spark, d).groupBy(*KEYS, "tau").agg(F.min_by("model", "es").alias("lowest"), F.max_by("model", "es").alias("highest"), F.count_distinct("es").alias("n"))
    return told(g.where("n = 3").drop("n"))


@query("running_share", f"SELECT o_custkey, o_orderkey, {q6('sum(o_totalprice) OVER w / sum(o_totalprice) OVER (PARTITION BY o_custkey)')} AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_share(spark, d):
    w = Window.partitionBy("o_custkey")
    run = F.sum("o_totalprice").over(w.orderBy("o_totalprice", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return told(read(spark, d, "orders").select("o_custkey", "o_orderkey", (run / F.sum("o_totalprice").over(w)).alias("share")))


SELECTED = "SELECT * FROM forecasts WHERE (model, report) IN (('HS250', 'base'), ('HS1250', 'base'), ('HS250', 's1'), ('HS1250', 's1')) AND t > 1250"


@query("component_tasks", sql(f"SELECT f.t, book, report, CAST(f.tau AS DOUBLE) AS tau, {q6('max(a.actual)')} AS actual, string_agg(model, ',' ORDER BY model) AS models, {q6('avg(var)')} AS mean_var, {q6('avg(es)')} AS mean_es FROM ({SELECTED}) f JOIN realised a USING (t, book, report) GROUP BY f.t, book, report, f.tau", "forecasts", "realised"))
def component_tasks(spark, d):
    """Tasks with all selected components, each (model, report) a row of a selector table; a gap, a repeated component or a disputed outcome fails the job."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("report")) for m in ("HS250", "HS1250") for r in ("base", "s1")]))
    selectors = spark.range(1).select(pairs.alias("x")).select("x.*")
    f = forecasts(spark, d).where("t > 1250").join(realised(returns(spark, d)), KEYS)
    c = components_of(f, selectors, ["model", "report"], [*KEYS, "tau"])
    return told(c.select(*KEYS, "tau", "actual", F.array_join("models", ",").alias("models"), array_mean(F.col("var")).alias("mean_var"), array_mean(F.col("es")).alias("mean_es")))


@query("validated_precision", sql(f"SELECT l.t, l.book, l.report, CAST(l.tau AS DOUBLE) AS tau, {q6('l.es')} AS low, {q6('h.es')} AS high FROM risk500 l JOIN risk1250 h USING (t, book, report, tau)", "risk500", "risk1250"))
def validated_precision(spark, d):
    """Two windows side by side, one row of each to one of the other or the job fails."""
    f = forecasts(spark, d, (500, 1250))
    low, high = (f.where(F.col("model") == m).select(*KEYS, "tau", F.col("es").alias(n)) for m, n in (("HS500", "low"), ("HS1250", "high")))
    return told(one_to_one(low, high, [*KEYS, "tau"]))


@query("set_equality", "SELECT 'customer' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) UNION ALL SELECT 'nation', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def set_equality(spark, d):
    """Keys that only one side has, counted both ways."""
    a, b = read(spark, d, "customer").select("c_nationkey"), read(spark, d, "nation").select("n_nationkey")
    count = lambda x, side: x.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.subtract(b), "customer").unionByName(count(b.subtract(a), "nation"))
