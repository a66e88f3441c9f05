"""Queries of cleaning, reshaping, clocks and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.columns import r6
from riskloom.operators import panel as P
from riskloom.operators import reshape as R
from riskloom.operators.books import REFERENCES, basis
from riskloom.operators.joins import latest_completed, refused, year_cutoff
from riskloom.operators.risk import NOTIONAL, outcomes
from riskloom.plans.base import panel, read, returns
from riskloom.plans.sql import K, each_task, r6 as q6, returns_step, sql, unit_prices

QUERIES, SQL = {}, {}


def query(name: str, text: str):
    def add(f):
        QUERIES[name], SQL[name] = f, text
        return f

    return add


def rounded(df, *keep: str):
    """Six decimals in all columns but those to keep; dates as text."""
    return df.select(*[day(c) if c == "d" else c for c in keep], *[r6(F.col(c)).alias(c) for c in df.columns if c not in keep])


def day(c: str):
    return F.col(c).cast("string").alias(c)


def days(df, *cols: str):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


P4 = ", ".join(f"p{k}" for k in K)
R4 = ", ".join(f"{q6(f'r{k}')} AS r{k}" for k in K)


@query("panel_status_filter", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderpriority AS series, {q6('CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)')} AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND CAST(o_orderdate AS DATE) <= DATE '2000-12-31' GROUP BY 1, 2")
def panel_status_filter(spark, d):
    o = read(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))
    kept = P.clean(o, "o_totalprice", "o_orderstatus", "F", "2000-12-31")
    return kept.groupBy(day("d"), F.col("o_orderpriority").alias("series")).agg(r6(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")).alias("value"), F.count("*").alias("n"))


@query("panel_pivot", sql(f"SELECT CAST(d AS VARCHAR) AS d, {P4} FROM wide", "wide"))
def panel_pivot(spark, d):
    return days(P.pivot_panel(P.unit_prices(read(spark, d, "lineitem"))), "d")


@query("panel_complete_case", sql(f"SELECT t, CAST(d AS VARCHAR) AS d, {P4} FROM panel", "panel"))
def panel_complete_case(spark, d):
    return days(panel(spark, d), "d")


@query("panel_weekly", sql(f"SELECT t, CAST(d AS VARCHAR) AS d, {P4} FROM panel", "panel", extra={"px": (unit_prices("week"), ())}))
def panel_weekly(spark, d):
    return days(panel(spark, d, "week"), "d")


@query("panel_dup_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def panel_dup_check(spark, d):
    return R.duplicate_keys(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("panel_distinct", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def panel_distinct(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query("reciprocal_quotes", sql("SELECT t, CAST(1 AS DOUBLE) AS base, " + ", ".join(f"1 / p{k} AS s{k}" for k in K) + " FROM panel", "panel"))
def reciprocal_quotes(spark, d):
    return panel(spark, d).select("t", F.lit(1.0).alias("base"), *[(1 / F.col(f"p{k}")).alias(f"s{k}") for k in K])


@query("log_returns", sql(f"SELECT t, CAST(d AS VARCHAR) AS d, {R4} FROM returns", "returns"))
def log_returns(spark, d):
    return rounded(returns(spark, d), "t", "d")


BASIS = [(ref, node, c) for ref in REFERENCES for node, c in basis(ref)]


@query("basis_returns", sql(" UNION ALL ".join(f"SELECT t, '{ref}' AS reference, '{node}' AS node, {q6(' + '.join(f'CAST({x} AS DOUBLE) * r{k}' for k, x in zip(K, c, strict=True)))} AS r FROM returns" for ref, node, c in BASIS), "returns"))
def basis_returns(spark, d):
    return R.basis_long(returns(spark, d)).select("t", "reference", "node", r6(F.col("r")).alias("r"))


@query("rolling_return_sum", sql("SELECT * EXCLUDE (n) FROM (SELECT t, count(*) OVER w AS n, " + ", ".join(f"{q6(f'sum(r{k}) OVER w')} AS h{k}" for k in K) + " FROM returns WINDOW w AS (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE n = 5", "returns"))
def rolling_return_sum(spark, d):
    return rounded(P.rolling_sum(returns(spark, d), 5), "t")


@query("history_pairs", sql("SELECT o.t, count(*) AS n, min(p.s) AS first_s, max(p.s) AS last_s, " + q6("sum(a1 * b1)") + " AS cross1 FROM pairs p JOIN (SELECT unnest(range(61, (SELECT max(s) FROM pairs) + 61)) AS t) o ON p.s BETWEEN o.t - 60 AND o.t - 2 GROUP BY o.t", "pairs"))
def history_pairs(spark, d):
    rows = P.history(P.increments(returns(spark, d)), 60)
    return rows.groupBy("t").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), r6(F.sum(F.col("a1") * F.col("b1"))).alias("cross1"))


def outcome_sql(h: int) -> str:
    loss = {"p": each_task("s", "steps", "loss"), "steps": returns_step(h)}
    return sql(f"SELECT p.s AS t, CAST(o.d AS VARCHAR) AS origin_d, CAST(a.d AS VARCHAR) AS start_d, CAST(z.d AS VARCHAR) AS target_d, book, report, {q6('loss')} AS actual_loss, {q6(f'{NOTIONAL} / CASE report WHEN {chr(39)}s1{chr(39)} THEN o.p1 ELSE 1 END')} AS reference_notional, CAST(a.d - o.d AS INTEGER) AS lead_days, CAST(z.d - a.d AS INTEGER) AS holding_days FROM p JOIN panel o ON o.t = p.s JOIN panel a ON a.t = p.s + 1 JOIN panel z ON z.t = p.s + 1 + {h}", "p", "panel", extra={"p": (loss["p"], ("steps",)), "steps": (loss["steps"], ("returns",))})


def outcome_tasks(h: int):
    def run(spark, d):
        x = outcomes(panel(spark, d), h)
        return x.select("t", F.col("d").cast("string").alias("origin_d"), day("start_d"), day("target_d"), "book", "report", r6(F.col("actual_loss")).alias("actual_loss"), r6(F.col("reference_notional")).alias("reference_notional"), F.datediff("start_d", "d").alias("lead_days"), F.datediff("target_d", "start_d").alias("holding_days"))

    return run


for h_ in (1, 5, 20):
    query(f"outcome_tasks_h{h_}", outcome_sql(h_))(outcome_tasks(h_))


@query("asof_latest_completed", sql("SELECT o.t, max(l.s) AS latest, max(l.s) + 2 AS known_at FROM panel o JOIN pairs l ON l.s + 2 <= o.t AND l.s < o.t GROUP BY o.t", "panel", "pairs"))
def asof_latest_completed(spark, d):
    p = panel(spark, d)
    labels = P.increments(returns(spark, d)).select("s", (F.col("s") + 2).alias("known_at"))
    return latest_completed(p.select("t"), labels, "t", "known_at").where("s is not null").select("t", F.col("s").alias("latest"), "known_at")


@query("asof_event", "SELECT e.event_id, o.o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders) o JOIN (SELECT e.event_id, e.user_id, max(CAST(o2.o_orderdate AS DATE)) AS d FROM events e JOIN orders o2 ON o2.o_custkey = e.user_id AND CAST(o2.o_orderdate AS DATE) <= CAST(e.ts AS DATE) GROUP BY 1, 2) e ON o.o_custkey = e.user_id AND CAST(o.o_orderdate AS DATE) = e.d AND o.rn = 1")
def asof_event(spark, d):
    events = read(spark, d, "events").select("event_id", F.col("user_id").alias("who"), F.to_date("ts").alias("at"))
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("known_at"), "o_orderkey")
    last = orders.groupBy("who", "known_at").agg(F.max("o_orderkey").alias("o_orderkey"))
    return latest_completed(events, last, "at", "known_at", ["who"]).where("o_orderkey is not null").select("event_id", "o_orderkey")


@query("asof_unkeyed", """WITH known AS (SELECT CAST(l_shipdate AS DATE) AS at, max(struct_pack(o := l_orderkey, n := l_linenumber)) AS x FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, k.x.o AS shipped_order, CAST(k.x.n AS BIGINT) AS shipped_line, CAST(k.at AS VARCHAR) AS shipped_on FROM orders o ASOF LEFT JOIN known k ON CAST(o.o_orderdate AS DATE) >= k.at""")
def asof_unkeyed(spark, d):
    """Every order with the latest shipment of any order on its day or before."""
    orders = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered_on"))
    shipped = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("shipped_on"), F.col("l_orderkey").alias("shipped_order"), F.col("l_linenumber").cast("long").alias("shipped_line"))
    return days(latest_completed(orders, shipped, "ordered_on", "shipped_on").drop("ordered_on"), "shipped_on")


@query("asof_year_cutoff", sql("SELECT p.t, CAST(p.d AS VARCHAR) AS d, c.cutoff, CAST(c.cutoff_d AS VARCHAR) AS cutoff_d FROM panel p JOIN (SELECT year(d) + 1 AS y, max(t) AS cutoff, max(d) AS cutoff_d FROM panel GROUP BY 1) c ON year(p.d) = c.y", "panel"))
def asof_year_cutoff(spark, d):
    return days(year_cutoff(panel(spark, d).select("t", "d")), "d", "cutoff_d")


@query("calendar_sample_monthly", sql("SELECT t, CAST(d AS VARCHAR) AS d FROM (SELECT t, d, row_number() OVER w AS rn, count(*) OVER (PARTITION BY year(d), month(d)) AS n FROM panel WINDOW w AS (PARTITION BY year(d), month(d) ORDER BY t)) WHERE rn = n // 2 + 1", "panel"))
def calendar_sample_monthly(spark, d):
    return days(R.monthly_middle(panel(spark, d).select("t", "d")), "d")


@query("calendar_sample_stride", sql("SELECT t, CAST(d AS VARCHAR) AS d FROM (SELECT t, d, row_number() OVER (PARTITION BY year(d) ORDER BY t) AS rn, count(*) OVER (PARTITION BY year(d)) AS n FROM panel) WHERE (rn - 1) % greatest(n // 24, 1) = 0", "panel"))
def calendar_sample_stride(spark, d):
    return days(R.yearly_stride(panel(spark, d).select("t", "d"), 24), "d")


@query("eligible_origins", sql("SELECT t, CAST(d AS VARCHAR) AS d FROM panel WHERE t > 250 AND t + 2 <= (SELECT max(t) FROM panel) AND year(d) BETWEEN 1998 AND 2000", "panel"))
def eligible_origins(spark, d):
    return days(R.eligible(panel(spark, d).select("t", "d"), 250, 1, 1998, 2000), "d")


@query("reference_spread", sql("SELECT t, " + q6("greatest(r1, r2, r3, r4, 0.0) - least(r1, r2, r3, r4, 0.0)") + " AS span, " + q6("(abs(r1) + abs(r2) + abs(r3) + abs(r4)) / 5") + " AS mean_abs FROM returns", "returns"))
def reference_spread(spark, d):
    cols = [F.col(f"r{k}") for k in K] + [F.lit(0.0)]
    return returns(spark, d).select("t", r6(F.greatest(*cols) - F.least(*cols)).alias("span"), r6(sum((F.abs(c) for c in cols[1:]), F.abs(cols[0])) / 5).alias("mean_abs"))


@query("guarded_divide", sql("SELECT t, CASE WHEN r2 <> 0 THEN " + q6("r1 / r2") + " END AS ratio FROM returns", "returns"))
def guarded_divide(spark, d):
    return returns(spark, d).select("t", r6(F.when(F.col("r2") != 0, F.col("r1") / F.col("r2"))).alias("ratio"))


@query("wide_to_long", sql(" UNION ALL ".join(f"SELECT t, 's{k}' AS series, p{k} AS px FROM panel" for k in K), "panel"))
def wide_to_long(spark, d):
    return panel(spark, d).selectExpr("t", "stack(4, 's1', p1, 's2', p2, 's3', p3, 's4', p4) as (series, px)")


@query("multilevel_pivot", "SELECT n_name, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}' AND year(o_orderdate) % 2 = {y}) AS {s.lower()}_{n}" for s in "FOP" for y, n in ((0, "even"), (1, "odd"))) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def multilevel_pivot(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    level = F.concat(F.lower("o_orderstatus"), F.when(F.year("o_orderdate") % 2 == 0, "_even").otherwise("_odd"))
    names = [f"{s}_{y}" for s in "fop" for y in ("even", "odd")]
    wide = j.withColumn("level_", level).groupBy("n_name").pivot("level_", names).count()
    return wide.select("n_name", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


@query("cross_task_grid", "SELECT b.r_name AS book, n.n_name AS report, CAST(t.tau AS DOUBLE) AS tau FROM region b CROSS JOIN nation n CROSS JOIN (SELECT unnest([CAST(0.95 AS DECIMAL(3,2)), CAST(0.99 AS DECIMAL(3,2))]) AS tau) t")
def cross_task_grid(spark, d):
    taus = spark.range(1).select(F.explode(F.array(F.lit("0.95").cast("decimal(3,2)"), F.lit("0.99").cast("decimal(3,2)"))).alias("tau"))
    grid = read(spark, d, "region").select(F.col("r_name").alias("book")).join(F.broadcast(read(spark, d, "nation").select(F.col("n_name").alias("report"))), how="cross")
    return grid.join(F.broadcast(taus), how="cross").withColumn("tau", F.col("tau").cast("double"))


@query("incomplete_days", sql("SELECT DISTINCT CAST(px.d AS VARCHAR) AS d FROM px ANTI JOIN panel ON px.d = panel.d", "px", "panel"))
def incomplete_days(spark, d):
    px = P.unit_prices(read(spark, d, "lineitem"))
    whole = px.groupBy("d").agg(F.count("*").alias("n")).where("n = 4")
    return days(px.select("d").distinct().join(whole, "d", "left_anti"), "d")


@query("prices_in_both_lines", "SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2")
def prices_in_both_lines(spark, d):
    x = read(spark, d, "lineitem")
    return x.where("l_linenumber = 1").select("l_partkey").intersect(x.where("l_linenumber = 2").select("l_partkey"))


@query("trailing_median_60", sql("SELECT t, CASE WHEN n >= 30 THEN " + q6("m") + " END AS median, CASE WHEN n >= 30 THEN " + q6("p10") + " END AS p10, CASE WHEN n >= 30 THEN " + q6("p90") + " END AS p90 FROM (SELECT t, count(*) OVER w AS n, quantile_cont(r1, 0.5) OVER w AS m, quantile_cont(r1, 0.1) OVER w AS p10, quantile_cont(r1, 0.9) OVER w AS p90 FROM returns WINDOW w AS (ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))", "returns"))
def trailing_median_60(spark, d):
    w = Window.orderBy("t").rowsBetween(-59, 0)
    enough = F.count("*").over(w) >= 30
    return returns(spark, d).select("t", *[F.when(enough, r6(F.percentile("r1", F.lit(p)).over(w))).alias(n) for n, p in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))])


@query("pseudo_observations", sql("SELECT t, " + ", ".join(f"{q6(f'(rank() OVER (ORDER BY r{k}) + (count(*) OVER (PARTITION BY r{k}) - 1) / 2.0) / ((SELECT count(*) FROM returns) + 1.0)')} AS u{k}" for k in K) + " FROM returns", "returns"))
def pseudo_observations(spark, d):
    return R.pseudo_observations(returns(spark, d), [f"r{k}" for k in K]).select("t", *[r6(F.col(f"u_r{k}")).alias(f"u{k}") for k in K])


SAMPLES = {
    "every_6": "SELECT t, d FROM panel WHERE (t - 1) % 6 = 0",
    "yearly_ends": "SELECT t, d FROM (SELECT t, d, row_number() OVER (PARTITION BY year(d) ORDER BY t) AS rn, count(*) OVER (PARTITION BY year(d)) AS n FROM panel) WHERE rn IN (1, n // 2 + 1, n)",
    "evenly_32": "SELECT t, d FROM panel WHERE t IN (SELECT CAST(floor(i * (m - 1) / 31) AS BIGINT) + 1 FROM (SELECT max(t) AS m FROM panel), (SELECT unnest(range(32)) AS i))",
    "month_ends_listed": "SELECT t, d FROM panel WHERE d IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE day(l_shipdate) = 28)",
}


@query("calendar_samples", sql(" UNION ALL ".join(f"SELECT '{n}' AS sample, t, CAST(d AS VARCHAR) AS d FROM ({q})" for n, q in SAMPLES.items()), "panel"))
def calendar_samples(spark, d):
    """Every sixth row, first, middle and last of a year, 32 evenly spaced rows, and days from a list."""
    c = panel(spark, d).select("t", "d")
    days_ = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d")).where(F.dayofmonth("d") == 28).distinct()
    made = {"every_6": R.every_nth(c, 6), "yearly_ends": R.yearly_ends(c), "evenly_32": R.evenly_spaced(c, 32), "month_ends_listed": R.listed(c, days_)}
    out = [days(x.select(F.lit(n).alias("sample"), "t", "d"), "d") for n, x in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("checked_divide", sql("SELECT t, " + q6("r1 / p1") + " AS ratio FROM returns JOIN panel USING (t)", "returns", "panel"))
def checked_divide(spark, d):
    """A ratio that fails the job where its denominator is zero or missing."""
    j = returns(spark, d).drop("d").join(panel(spark, d), "t")
    return refused(j, F.coalesce(F.col("p1") == 0, F.lit(True)), "zero denominator").select("t", r6(F.col("r1") / F.col("p1")).alias("ratio"))
