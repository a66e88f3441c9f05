"""Queries of yearly choices, runs by year, reconciliations and parameter tables, and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.columns import task_losses
from riskloom.operators import combine as C
from riskloom.operators import evaluate as E
from riskloom.operators import filters as G
from riskloom.operators import reshape as R
from riskloom.operators.audit import reconciled
from riskloom.operators.books import BOOKS, REFERENCES, REPORTS
from riskloom.operators.panel import columns, history, increments
from riskloom.operators.parameters import persistence, spread, upper_triangle
from riskloom.operators.points import BITS, directions, shift
from riskloom.operators.reshape import basis_long
from riskloom.operators.risk import TAUS, historical_sets, realised, scored, var_es
from riskloom.operators.selection import exact_quantiles
from riskloom.plans.base import KEYS, forecasts, panel, returns, scores
from riskloom.plans.risk_queries import BASE, DRAWS, FHS, FILTER, FKEYS, RADIAL, STEP, TAU, WINDOWS, P, filtered_sets, gauss_sql, qs, told
from riskloom.plans.sql import loss_sql, r6 as q6, risk_step, score_step, sql
from riskloom.sources import io
from riskloom.sources.yearly import Shards, fingerprints

QUERIES, SQL = {}, {}
MODELS = [f"HS{w}" for w in WINDOWS]
TASK = ["book", "report", "tau"]
#: Completed origins a choice looks back on; fewer where all windows must have a forecast, the longest of which leaves some 890.
DATES, WEIGHED = 900, 500


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def past_sql(source: str, dates: int = DATES) -> dict:
    """The last completed origins before each year, where there are as many."""
    return {
        "cuts": ("SELECT CAST(year(d) + 1 AS BIGINT) AS year, max(t) AS cutoff FROM panel GROUP BY 1", ("panel",)),
        "before": (f"SELECT c.year, s.* FROM {source} s JOIN cuts c ON s.t + 2 <= c.cutoff AND s.t > c.cutoff - {dates + 2}", (source, "cuts")),
        "enough": (f"SELECT * FROM before WHERE year IN (SELECT year FROM before GROUP BY year HAVING count(DISTINCT t) = {dates})", ("before",)),
    }


# One frame a year, from its scores at 0.95 over all tasks, for both tails of the next.
ORDER = "list_position([" + ", ".join(f"'{r}'" for r in REFERENCES) + "], reference)"
CHOICE = FHS | {"fscores": (score_step("frisk"), ("frisk", "realised"))} | past_sql("fscores") | {
    "choice": (f"SELECT year, reference, m FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(m, 9), {ORDER}) AS rn FROM (SELECT year, reference, avg(s) AS m FROM (SELECT year, reference, t, avg(score) AS s FROM enough WHERE tau = 0.95 GROUP BY ALL) GROUP BY ALL)) WHERE rn = 1", ("enough",)),
}


def frame_scores(spark, d):
    return io.stored(scored(var_es(filtered_sets(spark, d), FKEYS), realised(returns(spark, d))), "frame-scores")


def frame_choice(spark, d, rows):
    past = C.completed_before(rows.where("tau = 0.95"), panel(spark, d).select("t", "d"), DATES)
    return C.yearly_choice(past, "reference", REFERENCES)


@query("reference_choice", sql(f"SELECT year, reference, {q6('m')} AS past_score FROM choice", "choice", extra=CHOICE, recursive=True))
def reference_choice(spark, d):
    return told(frame_choice(spark, d, frame_scores(spark, d)))


@query("reference_choice_forward", sql(f"SELECT c.year, t, book, report, {TAU}, reference, {qs('var', 'es', 'score')}, hit FROM fscores JOIN panel p USING (t) JOIN choice c ON c.year = year(p.d) AND c.reference = fscores.reference".replace("reference, ", "fscores.reference, ", 1), "choice", "fscores", "panel", extra=CHOICE, recursive=True))
def reference_choice_forward(spark, d):
    """Forecasts of each year by the frame chosen before it."""
    rows = frame_scores(spark, d)
    years = panel(spark, d).select("t", F.year("d").cast("long").alias("year"))
    chosen = frame_choice(spark, d, rows).select("year", "reference")
    return told(rows.join(F.broadcast(years), "t").join(F.broadcast(chosen), ["year", "reference"]).select("year", *KEYS, "tau", "reference", "var", "es", "score", "hit"))  # a row a date, a row a year


# Weights by past scores.
W = range(len(MODELS))
FZ = "(greatest(actual - {v}, 0.0) / ((1 - CAST(tau AS DOUBLE)) * {e}) + {v} / {e} + ln({e}) - 1)"
V, S = ("(" + " + ".join(f"w{k} * {x}{k}" for k in W) + ")" for x in "ve")
RAW = [f"CASE WHEN strength IS NULL THEN CAST(a{k} <= 1e-12 AS DOUBLE) ELSE exp(-strength * CASE WHEN scale < 1e-12 THEN 0 ELSE a{k} / scale END) END" for k in W]
WEIGHTS = {
    "beside": ("SELECT t, book, report, tau, any_value(actual) AS actual, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN var END) AS v{k}, max(CASE WHEN model = '{m}' THEN es END) AS e{k}" for k, m in enumerate(MODELS)) + " FROM scores GROUP BY ALL", ("scores",)),
    "members": ("SELECT * FROM beside WHERE " + " AND ".join(f"v{k} IS NOT NULL" for k in W), ("beside",)),
} | past_sql("members", WEIGHED) | {
    "sums": ("SELECT year, book, report, tau, " + ", ".join(f"sum({FZ.format(v=f'v{k}', e=f'e{k}')}) AS s{k}" for k in W) + " FROM enough GROUP BY ALL", ("enough",)),
    "above": ("SELECT year, book, report, tau, " + ", ".join(f"s{k} - least({', '.join(f's{j}' for j in W)}) AS a{k}" for k in W) + f", greatest({', '.join(f's{j}' for j in W)}) - least({', '.join(f's{j}' for j in W)}) AS scale FROM sums", ("sums",)),
    "grid": ("SELECT unnest(range(102)) AS place, unnest([" + ", ".join(f"CAST({s!r} AS DOUBLE)" for s in C.STRENGTHS) + ", NULL]) AS strength", ()),
    "tried": ("SELECT year, book, report, tau, place, strength, " + ", ".join(f"x{k} / ({' + '.join(f'x{j}' for j in W)}) AS w{k}" for k in W) + " FROM (SELECT *, " + ", ".join(f"{r} AS x{k}" for k, r in enumerate(RAW)) + " FROM above CROSS JOIN grid)", ("above", "grid")),
    "objectives": (f"SELECT year, book, report, tau, place, any_value(strength) AS strength, {', '.join(f'any_value(w{k}) AS w{k}' for k in W)}, avg({FZ.format(v=V, e=S)}) AS objective FROM enough JOIN tried USING (year, book, report, tau) GROUP BY year, book, report, tau, place", ("enough", "tried")),
    "chosen": ("SELECT * FROM objectives QUALIFY row_number() OVER (PARTITION BY year, book, report, tau ORDER BY round(objective, 12), place) = 1", ("objectives",)),
}


def members(spark, d):
    return io.stored(C.side_by_side(scores(spark, d), ["t", *TASK], MODELS, "actual"), "members")


def chosen_weights(spark, d, rows):
    return C.score_weights(C.completed_before(rows, panel(spark, d).select("t", "d"), WEIGHED), TASK)


@query("score_weight_choice", sql(f"SELECT year, book, report, {TAU}, strength IS NULL AS one_winner, {q6('objective')} AS objective, {', '.join(q6(f'w{k}') + f' AS w{k}' for k in W)} FROM chosen", "chosen", extra=WEIGHTS))
def score_weight_choice(spark, d):
    c = chosen_weights(spark, d, members(spark, d))
    return told(c.select("year", *TASK, F.col("strength").isNull().alias("one_winner"), "objective", *[F.col("weights")[k].alias(f"w{k}") for k in W]))


@query("score_weight_forecasts", sql(f"SELECT c.year, m.t, m.book, m.report, CAST(m.tau AS DOUBLE) AS tau, {q6(V)} AS var, {q6(S)} AS es FROM members m JOIN panel p USING (t) JOIN chosen c ON c.year = year(p.d) AND c.book = m.book AND c.report = m.report AND c.tau = m.tau", "members", "panel", "chosen", extra=WEIGHTS))
def score_weight_forecasts(spark, d):
    """Each year's forecasts combined by the weights of the years before it."""
    rows = members(spark, d)
    years = panel(spark, d).select("t", F.year("d").cast("long").alias("year"))
    return told(C.weighted_forecasts(rows.join(F.broadcast(years), "t"), chosen_weights(spark, d, rows), TASK))


# Two routes to the same forecasts.
DIRECT = {"direct": ("SELECT t, book, report, tau, min(q) AS var, min(q) + sum(greatest(loss - q, 0.0)) / count(*) / (1 - CAST(tau AS DOUBLE)) AS es FROM (SELECT *, min(CASE WHEN place >= ceil(tau * n) THEN loss END) OVER (PARTITION BY t, book, report, tau) AS q FROM (SELECT *, row_number() OVER (PARTITION BY t, book, report ORDER BY loss) AS place, count(*) OVER (PARTITION BY t, book, report) AS n FROM losses250) CROSS JOIN taus) GROUP BY t, book, report, tau", ("losses250", "taus"))}
GAPS = " UNION ALL ".join(f"SELECT tau, '{v}' AS name, a.t IS NOT NULL AND b.t IS NOT NULL AS twice, a.t IS NOT NULL AND b.t IS NULL AS l, b.t IS NOT NULL AND a.t IS NULL AS r, abs(a.{v} - b.{v}) AS gap, abs(a.{v} - b.{v}) / nullif(greatest(abs(a.{v}), abs(b.{v})), 0) AS ratio FROM risk250 a FULL JOIN direct b USING (t, book, report, tau)" for v in ("var", "es"))


@query("reconstruction_audit", sql(f'SELECT {TAU}, name AS "column", count(*) FILTER (WHERE twice) AS matched, count(*) FILTER (WHERE l) AS only_left, count(*) FILTER (WHERE r) AS only_right, {q6("max(gap)")} AS max_abs, {q6("max(coalesce(ratio, 0))")} AS max_rel, count(*) FILTER (WHERE l OR r OR (gap > 1e-12 AND ratio > 1e-9)) = 0 AS within FROM ({GAPS}) AS gaps GROUP BY gaps.tau, name', "risk250", "direct", extra=DIRECT))
def reconstruction_audit(spark, d):
    """Forecasts from sliding arrays against those from a rolling-history join with ranks of its own."""
    r = returns(spark, d)
    arrays = var_es(historical_sets(r, BASE), KEYS)
    rows = history(increments(r).select("s", F.explode(task_losses(columns("a"), columns("b"))).alias("x")).select("s", "x.*"), BASE)
    ranks = [F.expr(f"percentile_disc({tau}) WITHIN GROUP (ORDER BY loss)").alias(f"q{tau}") for tau in TAUS]
    sets = rows.groupBy(*KEYS).agg(*ranks, F.sort_array(F.collect_list("loss")).alias("x")).where(F.size("x") == BASE - 1)  # whole windows
    each = F.array(*[F.struct(F.lit(tau).alias("tau"), F.col(f"`q{tau}`").alias("var")) for tau in TAUS])
    excess = F.aggregate(F.transform("x", lambda loss: F.greatest(loss - F.col("e.var"), F.lit(0.0))), F.lit(0.0), lambda s, e: s + e)
    direct = sets.select(*KEYS, "x", F.explode(each).alias("e")).select(*KEYS, "e.tau", "e.var", (F.col("e.var") + excess / F.size("x") / (1 - F.col("e.tau").cast("double"))).alias("es"))
    told_ = reconciled(arrays, direct, [*KEYS, "tau"], ["var", "es"], ["tau"])
    return told(told_.drop("repeated", "nulls_differ"))


# Scores by year, made again only where the inputs of a year have changed.
@query("resumed_years", sql("SELECT CAST(year(d) AS BIGINT) AS year, count(*) AS rows, " + q6("avg(score)") + " AS mean_score, year(d) = (SELECT max(year(d)) FROM dated) AS made_later, CAST(c.cutoff AS BIGINT) AS cutoff FROM dated JOIN cuts c ON c.year = year(d) WHERE model = 'HS250' GROUP BY year(d), c.cutoff", "dated", "cuts", extra=past_sql("scores")))
def resumed_years(spark, d):
    """A run that stops before the last year, one that takes it up, and one that finds nothing to do."""
    rows = io.stored(scores(spark, d, (BASE,)), "scores")
    p = panel(spark, d).select("t", F.year("d").cast("long").alias("year"))
    cut = p.groupBy((F.col("year") + 1).alias("year")).agg(F.max("t").cast("long").alias("cutoff"))
    dated = io.stored(rows.join(F.broadcast(p), "t").join(F.broadcast(cut), "year"), "dated")
    marks = fingerprints(dated, "year")
    shards = Shards(spark, io.scratch(spark, "score-years"))
    run = lambda years: shards.run(years, lambda y: dated.where(F.col("year") == y).drop("year"), marks.__getitem__)
    first, second, third = run(sorted(marks)[:-1]), run(marks), run(marks)
    if third or set(first) & set(second):
        raise ValueError("a shard was made twice")
    g = shards.read().groupBy(F.col("year").cast("long").alias("year"), "cutoff").agg(F.count("*").alias("rows"), F.avg("score").alias("mean_score"))
    return told(g.withColumn("made_later", F.col("year").isin(second)))


# Per-tail decomposition of log ES.
@query("tail_decomposition", sql(" UNION ALL ".join(f"SELECT book, {TAU}, '{n}' AS factor, {q6(f'sum(({e}) * ({e}))')} AS ss, {q6('sum((x - m0) * (x - m0))')} AS total, {q6(f'sum(({e}) * ({e})) / sum((x - m0) * (x - m0))')} AS share FROM margins2 GROUP BY book, margins2.tau" for n, e in {"reference": "mr - m0", "report": "mn - m0", "reference x report": "x - mr - mn + m0"}.items()), "margins2", extra=FHS | {
    "cells2": ("SELECT t, book, reference, report, tau, ln(es) AS x FROM frisk QUALIFY min(es) OVER (PARTITION BY t, book, tau) > 0", ("frisk",)),
    "margins2": ("SELECT *, avg(x) OVER (PARTITION BY t, book, tau) AS m0, avg(x) OVER (PARTITION BY t, book, tau, reference) AS mr, avg(x) OVER (PARTITION BY t, book, tau, report) AS mn FROM cells2", ("cells2",))}, recursive=True))
def tail_decomposition(spark, d):
    """Frames and reporting units within each tail by itself."""
    from pyspark.sql import Window

    f = var_es(filtered_sets(spark, d), FKEYS).withColumn("low", F.min("es").over(Window.partitionBy("t", "book", "tau"))).where("low > 0")
    return told(E.factorial(f, ["t", "book", "tau"], ["reference", "report"], F.log("es"), "book", "tau"))


# Exact quantiles of large groups, without a group in one task.
LEVELS = (0.025, 0.5, 0.9, 0.975, 0.99)


@query("line_price_quantiles", " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, CAST({x} AS DOUBLE) AS level, count(*) AS n, {q6(f'quantile_cont(CAST(l_extendedprice AS DOUBLE), {x})')} AS quantile FROM lineitem GROUP BY l_returnflag, l_linestatus" for x in LEVELS))
def line_price_quantiles(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return told(exact_quantiles(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", LEVELS))


@query("score_quantiles", sql(" UNION ALL ".join(f"SELECT {TAU}, model, CAST({x} AS DOUBLE) AS level, count(*) AS n, {q6(f'quantile_cont(es, {x})')} AS quantile FROM scores GROUP BY scores.tau, model" for x in LEVELS), "scores"))
def score_quantiles(spark, d):
    """Medians and tails of ES, those of model_summary among them."""
    return told(exact_quantiles(io.stored(scores(spark, d), "scores"), ["tau", "model"], "es", LEVELS))


# Yearly parameters, kept as nested JSON and read back.
NODES = f"[{', '.join(chr(39) + r + chr(39) for r in REFERENCES)}]"
YEARLY = FILTER | {
    "xs": ("SELECT CAST(year(r.d) AS BIGINT) AS year, x.t, x.reference, x.node, x.x FROM x100 x JOIN returns r USING (t)", ("x100", "returns")),
    "fits": (f"SELECT year, reference, node, avg(x) AS mu, var_pop(x) * (1 - CAST({P.alpha} AS DOUBLE) - CAST({P.beta} AS DOUBLE)) AS omega, CAST({P.alpha} AS DOUBLE) AS alpha, CAST({P.beta} AS DOUBLE) AS beta FROM xs GROUP BY ALL", ("xs",)),
}


def yearly_fits(spark, d):
    """(cutoff, reference, node, mu, omega, alpha, beta): each year's variance-targeted parameters, by way of nested JSON."""
    years = returns(spark, d).select("t", F.year("d").cast("long").alias("year"))
    x = basis_long(returns(spark, d)).join(years, "t").withColumn("x", 100 * F.col("r"))
    omega = F.var_pop("x") * (1 - P.alpha - P.beta)
    fit = x.groupBy("year", "reference", "node").agg(F.avg("x").alias("mu"), omega.alias("omega"))
    packed = fit.groupBy("year", "reference").agg(F.sort_array(F.collect_list(F.struct("node", F.struct("mu", "omega", F.lit(P.alpha).alias("alpha"), F.lit(P.beta).alias("beta")).alias("garch")))).alias("g"))
    fits = packed.groupBy("year").agg(F.collect_list(F.struct("reference", F.col("g.node").alias("nodes"), F.col("g.garch").alias("garch"))).alias("fits"))
    at = io.scratch(spark, "fits")
    fits.select(F.col("year").alias("cutoff"), "fits", "year").write.partitionBy("year").json(at)
    return io.read_parameters(spark, f"{at}/year=*")


@query("parameter_persistence", sql(f"SELECT year AS cutoff, reference, node, {qs('mu', 'omega', 'alpha', 'beta')}, {q6('alpha + beta')} AS persistence, {q6('omega / (1 - (alpha + beta))')} AS long_run_variance FROM fits", "fits", extra=YEARLY))
def parameter_persistence(spark, d):
    return told(persistence(yearly_fits(spark, d)))


SPREAD = ", ".join(f"{q6(f'{f}({v})')} AS {v}_{n}" for v in ("omega", "long_run_variance") for n, f in (("min", "min"), ("median", "median"), ("max", "max")))


@query("parameter_spread", sql(f"SELECT reference, {SPREAD} FROM (SELECT *, omega / (1 - (alpha + beta)) AS long_run_variance FROM fits) GROUP BY reference", "fits", extra=YEARLY))
def parameter_spread(spark, d):
    return told(spread(persistence(yearly_fits(spark, d)), ["reference"], ["omega", "long_run_variance"]))


@query("parameter_correlations", sql(f"SELECT a.year, a.reference, a.node AS node_i, b.node AS node_j, {q6('0.98 * corr(a.x, b.x)')} AS correlation FROM xs a JOIN xs b USING (year, t, reference) WHERE list_position({NODES}, a.node) < list_position({NODES}, b.node) GROUP BY ALL", "xs", extra=YEARLY))
def parameter_correlations(spark, d):
    """Yearly correlations of a frame's nodes, shrunk by a fiftieth to the identity, kept as nested matrices and told above the diagonal."""
    years = returns(spark, d).select("t", F.year("d").cast("long").alias("year"))
    wide = basis_long(returns(spark, d)).join(years, "t").groupBy("year", "reference", "t").agg(*[F.max(F.when(F.col("node") == n, F.col("r"))).alias(n) for n in REFERENCES])
    at = io.scratch(spark, "correlations")
    cell = lambda a, b: F.coalesce(0.98 * F.corr(a, b), F.lit(0.0)) + (0.02 if a == b else 0.0)
    whole = wide.groupBy("year", "reference").agg(F.array(*[F.array(*[cell(a, b) for b in REFERENCES]) for a in REFERENCES]).alias("m"))
    mine = F.filter(F.sequence(F.lit(0), F.lit(len(REFERENCES) - 1)), lambda k: F.array(*map(F.lit, REFERENCES))[k] != F.col("reference"))
    whole.select("year", "reference", F.transform(mine, lambda k: F.array(*map(F.lit, REFERENCES))[k]).alias("nodes"), F.transform(mine, lambda i: F.transform(mine, lambda j: F.col("m")[i][j])).alias("matrix")).write.json(at)
    back = spark.read.schema("year long, reference string, nodes array<string>, matrix array<array<double>>").json(at)
    return told(upper_triangle(back, ["year", "reference"], "nodes", "matrix", "correlation"))


# Gaussian scenarios from nested tables of Sobol points, at the middle origin of each month.
COUNTS = (1024, 4096, 16384)


def sobol_sql(d: int, points: int, seed: int) -> str:
    """Coordinate d of point i of the same sequence."""
    x = str(shift(seed, d))
    for k, v in enumerate(directions(d)[: (points - 1).bit_length()]):
        x = f"xor({x}, ((gray >> {k}) & 1) * CAST({v} AS BIGINT))"
    return f"((CAST({x} AS DOUBLE) + 0.5) / {2**BITS}.0)"


PAIRS = ", ".join(f"sqrt(-2 * ln(u{j})) * {f}(2 * pi() * u{j + 1}) AS z{j + k}" for j in (0, 2, 4, 6) for k, f in enumerate(("cos", "sin")))
POINTS = gauss_sql(4096) | {
    "middles": ("SELECT t FROM (SELECT t, row_number() OVER w AS rn, count(*) OVER (PARTITION BY year(d), month(d)) AS n FROM panel WINDOW w AS (PARTITION BY year(d), month(d) ORDER BY t)) WHERE rn = n // 2 + 1", ("panel",)),
    "uniforms": ("SELECT i, " + ", ".join(f"{sobol_sql(d, COUNTS[-1], 1)} AS u{d}" for d in range(8)) + f" FROM (SELECT i, xor(i, i >> 1) AS gray FROM (SELECT unnest(range({COUNTS[-1]})) AS i))", ()),
    "normals": (f"SELECT i, {PAIRS} FROM uniforms", ("uniforms",)),
    "spaths": (f"SELECT t, i, {STEP} FROM roots JOIN middles USING (t) CROSS JOIN normals", ("roots", "middles", "normals")),
    "ssets": (" UNION ALL ".join(f"SELECT t, {n} AS draws, '{book}' AS book, '{report}' AS report, list_sort(list({loss_sql(book, REPORTS[report])})) AS x FROM spaths WHERE i < {n} GROUP BY t" for n in COUNTS for book in BOOKS for report in REPORTS), ("spaths",)),
    "srisk": (risk_step("ssets", "t, draws, book, report"), ("ssets", "taus")),
}


def sobol_risk(spark, d):
    origins = R.monthly_middle(panel(spark, d).select("t", "d"))
    return var_es(G.sobol_sets(returns(spark, d), origins, COUNTS), ["t", "draws", "book", "report"])


@query("sobol_gauss", sql(f"SELECT t, draws, book, report, {TAU}, {qs('var', 'es')} FROM srisk", "srisk", extra=POINTS, recursive=True))
def sobol_gauss(spark, d):
    return told(sobol_risk(spark, d).drop("n").withColumn("draws", F.col("draws").cast("int")))


CHANGE = " UNION ALL ".join(f"SELECT {lo} AS low, {hi} AS high, tau, book, report, abs(a - b) / abs(b) AS change, sa, sb FROM (SELECT tau, t, book, report, max(CASE WHEN draws = {lo} THEN es END) AS a, max(CASE WHEN draws = {hi} THEN es END) AS b, max(CASE WHEN draws = {lo} THEN es - base END) AS sa, max(CASE WHEN draws = {hi} THEN es - base END) AS sb FROM against GROUP BY ALL)" for lo, hi in zip(COUNTS, COUNTS[1:], strict=False))


@query("sobol_precision", sql(f"SELECT low, high, {TAU}, book, report, count(*) AS n, {q6('max(change)')} AS max_change, {q6('median(change)')} AS median_change, {q6('max(abs(sb - sa))')} AS max_contrast_change, count(*) FILTER (WHERE sa * sb < 0) AS sign_changes, count(*) FILTER (WHERE abs(sb - sa) > abs(sb)) AS exceeds FROM ({CHANGE}) AS c GROUP BY low, high, c.tau, book, report", "against", extra=POINTS | {
    "against": ("SELECT s.*, b.es AS base FROM srisk s JOIN srisk b ON s.t = b.t AND s.draws = b.draws AND s.book = b.book AND s.tau = b.tau AND b.report = 'base'", ("srisk",))}, recursive=True))
def sobol_precision(spark, d):
    """From each number of points to the next: relative change of ES, and of its contrast to the numeraire's report."""
    rows = io.stored(sobol_risk(spark, d), "sobol-risk")
    at = lambda n, report=None: F.max(F.when((F.col("draws") == n) & (F.col("report") == report if report else F.lit(True)), F.col("es")))
    base = rows.where("report = 'base'").groupBy("tau", "t", "book").agg(*[at(n).alias(f"b{n}") for n in COUNTS])
    wide = rows.groupBy("tau", "t", "book", "report").agg(*[at(n).alias(f"e{n}") for n in COUNTS]).join(base, ["tau", "t", "book"])
    steps = [F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), (F.abs(F.col(f"e{lo}") - F.col(f"e{hi}")) / F.abs(f"e{hi}")).alias("change"), (F.col(f"e{lo}") - F.col(f"b{lo}")).alias("sa"), (F.col(f"e{hi}") - F.col(f"b{hi}")).alias("sb")) for lo, hi in zip(COUNTS, COUNTS[1:], strict=False)]
    c = wide.select("tau", "book", "report", F.explode(F.array(*steps)).alias("c")).select("tau", "book", "report", "c.*")
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    moved = F.abs(F.col("sb") - F.col("sa"))
    return told(c.groupBy("low", "high", "tau", "book", "report").agg(F.count("*").alias("n"), F.max("change").alias("max_change"), F.percentile("change", 0.5).alias("median_change"), F.max(moved).alias("max_contrast_change"), count(F.col("sa") * F.col("sb") < 0).alias("sign_changes"), count(moved > F.abs("sb")).alias("exceeds")))


# Elliptical scenarios from Sobol points of ten coordinates, at the same origins.
RADIUS = [f"sqrt({' + '.join(f'z{m} * z{m}' for m in range(o, o + 4))})" for o in (0, 4)]
EVEN = RADIAL | {
    "middles": POINTS["middles"],
    "uniforms": ("SELECT i, " + ", ".join(f"{sobol_sql(d, DRAWS, 2)} AS u{d}" for d in range(10)) + f" FROM (SELECT i, xor(i, i >> 1) AS gray FROM (SELECT unnest(range({DRAWS})) AS i))", ()),
    "rdraws": (f"SELECT *, {RADIUS[0]} AS length1, {RADIUS[1]} AS length2 FROM (SELECT {PAIRS}, CAST(floor(u8 * {BASE}) AS BIGINT) AS i1, CAST(floor(u9 * {BASE}) AS BIGINT) AS i2 FROM uniforms)", ("uniforms",)),
    "glists": (RADIAL["glists"][0].replace("FROM rorigins o CROSS JOIN", "FROM (SELECT * FROM rorigins JOIN middles USING (t)) o CROSS JOIN"), (*RADIAL["glists"][1], "middles")),
}


@query("sobol_radial", sql(f"SELECT t, book, report, n, {TAU}, {qs('var', 'es')} FROM grisk", "grisk", extra=EVEN, recursive=True))
def sobol_radial(spark, d):
    origins = R.monthly_middle(panel(spark, d).select("t", "d"))
    return told(var_es(G.radial_sets(returns(spark, d), BASE, DRAWS, origins=origins, sobol=True), KEYS))
