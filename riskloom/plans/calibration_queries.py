"""Queries of conditional calibration tests and their twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.functions.columns import CONSTANT, PIVOT
from riskloom.operators.calibration import INSTRUMENTS, LEAST_BREACHES, calibration_table
from riskloom.plans.base import scores
from riskloom.plans.inference_queries import TASK_KEYS, hac_sql
from riskloom.plans.risk_queries import TAU, qs, told
from riskloom.plans.sql import r6 as q6, sql
from riskloom.sources.io import stored

QUERIES, SQL = {}, {}


def erfc_sql(z: str) -> str:
    series, fraction = "CAST(1 AS DOUBLE)", z
    for k in range(60, 0, -1):
        series, fraction = f"(1 + 2 * {z} * {z} / {2 * k + 1} * {series})", f"({z} + {k / 2} / {fraction})"
    tail = f"exp(-{z} * {z}) / {math.sqrt(math.pi)!r}"
    return f"CASE WHEN {z} < 2 THEN 1 - 2 * {tail} * {z} * {series} ELSE {tail} / {fraction} END"


def tail_sql(k: int) -> str:
    """The chi-square tail of w, with z = sqrt(w / 2) at hand."""
    terms = [erfc_sql("z") if k % 2 else "exp(-w / 2)"]
    for m in range(1, (k - 1) // 2 + 1):
        power = m - 0.5 if k % 2 else float(m)
        terms.append(f"exp(-w / 2) * pow(w / 2, {power}) / {math.gamma(power + 1)!r}")
    return " + ".join(terms)


def wald_sql(name: str, values, source: str, n: str) -> str:
    """(keys, n, statistic, rank, p) by the same elimination, a subquery a pivot."""
    k = len(values)
    size = lambda i: f"CASE WHEN cov_{values[i]}_{values[i]} > {CONSTANT!r} * mean_{values[i]} * mean_{values[i]} THEN sqrt(cov_{values[i]}_{values[i]}) END"
    entry = lambda i, j: f"coalesce(cov_{values[min(i, j)]}_{values[max(i, j)]} / ({size(i)} * {size(j)}), 0) AS m{i}_{j}"
    q = f"SELECT {TASK_KEYS}, n, " + ", ".join([entry(i, j) for i in range(k) for j in range(k)] + [f"coalesce(mean_{values[i]} / {size(i)}, 0) AS m{i}_{k}" for i in range(k)]) + f" FROM {source}"
    for p in range(k - 1):
        kept = [f"m{i}_{j}" for i in range(p + 1) for j in range(k + 1)]
        new = [f"CASE WHEN m{p}_{p} > {PIVOT!r} THEN m{i}_{j} - m{i}_{p} / m{p}_{p} * m{p}_{j} ELSE m{i}_{j} END AS m{i}_{j}" for i in range(p + 1, k) for j in range(k + 1)]
        q = f"SELECT {TASK_KEYS}, n, {', '.join(kept + new)} FROM ({q})"
    rank = " + ".join(f"CAST(m{i}_{i} > {PIVOT!r} AS BIGINT)" for i in range(k))
    form = " + ".join(f"m{i}_{k} * m{i}_{k} / m{i}_{i}" for i in range(k))
    q = f"SELECT {TASK_KEYS}, n, {rank} AS rank, CASE WHEN {rank} = {k} THEN {form} END AS w FROM ({q})"
    return f"SELECT {TASK_KEYS}, n AS {n}, w AS {name}_statistic, rank AS {name}_rank, {tail_sql(k)} AS {name}_p FROM (SELECT *, sqrt(w / 2) AS z FROM ({q}))"


PRODUCTS = [f"{n}_{i}" for n in "hu" for i in INSTRUMENTS]
KNOWN = {"one": "CAST(1 AS DOUBLE)", "lag": "(known - (1 - CAST(tau AS DOUBLE)))", "size": "ln(es)"}


def centred(values, source: str) -> str:
    return f"SELECT {TASK_KEYS}, t, " + ", ".join(f"avg({v}) OVER k AS m_{v}, {v} - avg({v}) OVER k AS z_{v}" for v in values) + f" FROM {source} WINDOW k AS (PARTITION BY {TASK_KEYS})"


def steps(lags: int) -> dict:
    return {
        "moments": (f"SELECT {TASK_KEYS}, t, CAST(hit AS DOUBLE) AS hit, h, u, " + ", ".join(f"{n} * {KNOWN[i]} AS {n}_{i}" for n in "hu" for i in INSTRUMENTS) + f" FROM (SELECT *, hit - (1 - CAST(tau AS DOUBLE)) AS h, tail_residual / es AS u, lag(hit, 2) OVER (PARTITION BY {TASK_KEYS} ORDER BY t) AS known FROM scores)", ("scores",)),
        "known_moments": ("SELECT * FROM moments WHERE h_lag IS NOT NULL", ("moments",)),
        "plain_z": (centred(("h", "u"), "moments"), ("moments",)),
        "given_z": (centred(PRODUCTS, "known_moments"), ("known_moments",)),
        f"plain{lags}": (hac_sql(("h", "u"), lags, "plain_z", TASK_KEYS), ("plain_z",)),
        f"given{lags}": (hac_sql(PRODUCTS, lags, "given_z", TASK_KEYS), ("given_z",)),
        f"joint{lags}": (wald_sql("joint", ("h", "u"), f"plain{lags}", "n"), (f"plain{lags}",)),
        f"conditional{lags}": (wald_sql("conditional", PRODUCTS[:3], f"given{lags}", "conditional_n"), (f"given{lags}",)),
        f"both{lags}": (wald_sql("conditional_joint", PRODUCTS, f"given{lags}", "conditional_n"), (f"given{lags}",)),
        "breaches": (f"SELECT {TASK_KEYS}, CAST(sum(hit) AS BIGINT) AS breaches, avg(hit) AS breach_rate FROM moments GROUP BY ALL", ("moments",)),
    }


def table_sql(lags: int) -> str:
    tests = [c for name in ("joint", "conditional", "conditional_joint") for c in (f"{q6(f'{name}_statistic')} AS {name}_statistic", f"{name}_rank", f"CASE WHEN breaches >= {LEAST_BREACHES} THEN {q6(f'{name}_p')} END AS {name}_p")]
    band = lambda m, v: [f"{q6(f'{m} {s} 1.96 * sqrt(greatest({v}, 0))')}" for s in "-+"]
    rate, use = band("breach_rate", "cov_h_h"), band("mean_u", "cov_u_u")
    return f"""SELECT {lags} AS lags, {TASK_KEYS.replace('tau', TAU)}, p.n, breaches, {q6('p.n * (1 - CAST(p.tau AS DOUBLE))')} AS expected, {qs('breach_rate')}, {rate[0]} AS rate_low, {rate[1]} AS rate_high, {q6('mean_u')} AS es_mean, {use[0]} AS es_low, {use[1]} AS es_high, c.conditional_n, {', '.join(tests)}, breaches < {LEAST_BREACHES} AS sparse
    FROM plain{lags} p JOIN joint{lags} j USING ({TASK_KEYS}) JOIN breaches b USING ({TASK_KEYS}) LEFT JOIN conditional{lags} c USING ({TASK_KEYS}) LEFT JOIN both{lags} f USING ({TASK_KEYS})"""


def conditional(lags: int):
    def run(spark, d):
        rows = stored(scores(spark, d), "scores")  # three aggregations read it
        return told(calibration_table(rows, ["model", "book", "report", "tau"], lags).withColumn("lags", F.lit(lags)))

    return run


for lags_ in (20, 60):
    name_ = f"conditional_calibration_{lags_}"
    QUERIES[name_] = conditional(lags_)
    SQL[name_] = sql(table_sql(lags_).replace("CAST(tau AS DOUBLE) AS tau", "CAST(p.tau AS DOUBLE) AS tau"), f"plain{lags_}", f"joint{lags_}", "breaches", f"conditional{lags_}", f"both{lags_}", extra=steps(lags_))
