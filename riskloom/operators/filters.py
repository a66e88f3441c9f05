"""Recursive volatility filters and the scenario sets they give.

A filter's step composes with the next into one of its kind, so it is an
affine scan over pieces of a series. Scenario sets are one group a span of
origins: their windows overlap, so a span's history travels once, and column
expressions over such arrays took five times as long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import tasks
from riskloom.operators.books import REFERENCES
from riskloom.operators.ordered import affine_scan
from riskloom.operators.points import sobol_array
from riskloom.operators.reshape import basis_long


@dataclass(frozen=True)
class Garch:
    """Parameters on the percent scale; h0 the first variance."""

    mu: float = 0.0
    omega: float = 400.0
    alpha: float = 0.06
    beta: float = 0.90
    h0: float = 10_000.0


def filtered(returns: DataFrame, p: Garch) -> DataFrame:
    """(t, reference, node, x, h, z, zpost): percent increments of every node in every frame, their variance, and the residuals by the variance before and after the innovation.

    h is the variance for the row's increment, from increments before it; not below 1e-10, nor 1e-8 at first.
    """
    rows = basis_long(returns).withColumn("x", 100 * F.col("r"))
    e = F.col("x") - p.mu
    scanned = affine_scan(rows, ["reference", "node"], "t", p.omega + p.alpha * e * e, float(p.beta), F.lit(max(p.h0, 1e-8)), 1e-10, ["x"])
    after = F.sqrt(p.omega + p.alpha * e * e + p.beta * F.col("h"))
    return scanned.withColumnRenamed("entry", "h").select("t", "reference", "node", "x", "h", (e / F.sqrt("h")).alias("z"), (e / after).alias("zpost"))


def ewma_covariance(returns: DataFrame, decay: float = 0.94, start: int = 20) -> DataFrame:
    """(t, i, j, cov): exponentially weighted covariances through row t, started from the sample covariance of rows 1 to ``start``; 0 where that is one row."""
    pairs = [(i, j) for i in range(1, 5) for j in range(i, 5)]
    long = returns.select("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}").alias("x"), F.col(f"r{j}").alias("y")) for i, j in pairs])).alias("p")).select("t", "p.*")
    first = long.where(F.col("t") <= start).groupBy("i", "j").agg(F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("first"))
    scanned = affine_scan(long, ["i", "j"], "t", (1 - decay) * F.col("x") * F.col("y"), decay, first)
    return scanned.select("t", "i", "j", F.col("state").alias("cov"))


def by_node(filtered_rows: DataFrame, *values: str) -> DataFrame:
    """One row a (t, reference) with a column <value>_<node> a node; null at the reference itself."""
    aggs = [F.max(F.when(F.col("node") == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in REFERENCES]
    return filtered_rows.groupBy("t", "reference").agg(*aggs)


#: Origins that share a task's group.
SPAN = 128
SETS = "t long, {}book string, report string, x array<double>"


def task_sets(a: np.ndarray, b: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    """task_losses_of, ascending."""
    return [(book, report, np.sort(x)) for book, report, x in task_losses_of(a, b)]


def task_losses_of(a: np.ndarray, b: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    """(book, report, losses) of every task over paths whose increments in the numeraire's frame are a, then b; a row a path."""
    out, begin, end = [], np.exp(a), np.exp(a + b)
    for book, report, base, w, n in tasks():
        start, left = base + begin @ np.array(w), base + end @ np.array(w)
        rise, fall = (begin[:, n - 1], end[:, n - 1]) if n else (1.0, 1.0)
        out.append((book, report, start / rise - left / fall))
    return out


def set_table(t: list[int], sets: list[tuple[str, str, np.ndarray]], **fixed: str) -> pa.Table:
    rows = {"t": pa.array(t, pa.int64())} | {k: pa.array([v] * len(t), pa.string()) for k, v in fixed.items()}
    return pa.table(rows | {"book": pa.array([x[0] for x in sets], pa.string()), "report": pa.array([x[1] for x in sets], pa.string()), "x": pa.array([x[2] for x in sets], pa.list_(pa.float64()))})


def filtered_sets(returns: DataFrame, p: Garch, window: int, residual: str = "z", standardise: bool = False, h: int = 1) -> DataFrame:
    """(t, reference, book, report, x): losses, ascending, of h-step paths from the window - h residual blocks known at each origin and its variance.

    standardise: residuals of the window less their mean, over their population
    standard deviation. Rows (t, reference) go to the span of SPAN origins they
    lie in and to those whose windows reach back to them, so a group is a span's
    origins with their shared history, however long the calendar.
    """
    f = by_node(filtered(returns, p).withColumn("z", F.col(residual)), "h", "z")
    spans = F.sequence(F.floor(F.col("t") / SPAN), F.floor((F.col("t") + window) / SPAN))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        reference, span = (k.as_py() for k in key)
        g = group.sort_by("t")
        t = g["t"].to_numpy()
        z, v = (np.column_stack([g[f"{c}_{n}"].to_numpy(zero_copy_only=False) for n in REFERENCES]).astype(float) for c in "zh")
        at = np.flatnonzero((t // SPAN == span) & (np.arange(len(t)) >= window))
        days, sets = [], []
        for i in at:
            past = z[i - window : i]
            past = (past - past.mean(axis=0)) / past.std(axis=0) if standardise else past
            state, first, hold = v[i], 0.0, 0.0
            for k in range(h + 1):
                e = np.sqrt(state) * past[k : k + window - h]
                r = (p.mu + e) / 100
                first, hold = (r, hold) if k == 0 else (first, hold + r)
                state = p.omega + p.alpha * e * e + p.beta * state
            a, b = (x[:, 1:] - x[:, :1] for x in (np.nan_to_num(first), np.nan_to_num(hold)))
            mine = task_sets(a, b)
            days += [int(t[i])] * len(mine)
            sets += mine
        return set_table(days, sets, reference=reference)

    dealt = f.withColumn("span", F.explode(spans))
    return dealt.groupBy("reference", "span").applyInArrow(run, SETS.format("reference string, "))


def uniform_draws(draws: int, places: range, seed: int) -> np.ndarray:
    """(draws, places) numbers between 0 and 1 from MD5 digests of seed:draw:place; the first rows of a larger table are the smaller table."""
    return (np.array([[int(md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:13], 16) for j in places] for i in range(draws)], float) + 0.5) / 2**52


def normal_draws(draws: int, seed: int) -> np.ndarray:
    """(draws, 8) standard normal numbers from digests."""
    return polar(uniform_draws(draws, range(8), seed))


def polar(u: np.ndarray) -> np.ndarray:
    """(draws, 8) standard normal numbers, two at a time by polar angles of uniform ones."""
    draws = len(u)
    r, angle = np.sqrt(-2 * np.log(u[:, ::2])), 2 * np.pi * u[:, 1::2]
    return np.stack([r * np.cos(angle), r * np.sin(angle)], axis=2).reshape(draws, 8)


def covariance_states(returns: DataFrame, decay: float, start: int) -> DataFrame:
    """(t, c11..c44): the exponentially weighted covariance known at each origin, that of row t - 1, after the first ``start`` rows."""
    pairs = [(i, j) for i in range(1, 5) for j in range(i, 5)]
    known = [F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("cov"))).alias(f"c{i}{j}") for i, j in pairs]
    return ewma_covariance(returns, decay, start).groupBy((F.col("t") + 1).alias("t")).agg(*known).where(F.col("t") > start)


def roots_of(group: pa.Table) -> np.ndarray:
    """(rows, 4, 4): the Cholesky factors of all rows' covariances c11..c44 at once."""
    entries = [[group[f"c{min(i, j)}{max(i, j)}"].to_numpy() for j in range(1, 5)] for i in range(1, 5)]
    return np.linalg.cholesky(np.array(entries, float).transpose(2, 0, 1))


def gaussian_sets(returns: DataFrame, draws: int = 4096, seed: int = 1, decay: float = 0.94, start: int = 20) -> DataFrame:
    """(t, book, report, x): losses, ascending, of two-step Gaussian paths with the exponentially weighted covariance known at each origin after the first ``start``; both steps have it."""
    return gaussian_prefixes(returns, [draws], seed, decay, start).drop("draws")


def gaussian_prefixes(returns: DataFrame, counts: Sequence[int], seed: int = 1, decay: float = 0.94, start: int = 20) -> DataFrame:
    """(t, draws, book, report, x): gaussian_sets for each number of draws in ``counts``; the smaller are the first draws of the largest, priced once."""
    return path_sets(covariance_states(returns, decay, start), lambda: normal_draws(max(counts), seed), counts)


def sobol_sets(returns: DataFrame, origins: DataFrame, counts: Sequence[int], seed: int = 1, decay: float = 0.94, start: int = 20) -> DataFrame:
    """(t, draws, book, report, x): the same at the origins (t) from the first ``counts`` of one table of Sobol points."""
    states = covariance_states(returns, decay, start).join(F.broadcast(origins.select("t")), "t", "left_semi")  # origins: a row a date
    return path_sets(states, lambda: polar(sobol_array(8, max(counts), seed)), counts)


def path_sets(states: DataFrame, normals: Callable[[], np.ndarray], counts: Sequence[int]) -> DataFrame:
    """(t, draws, book, report, x) of two-step paths with each origin's covariance, from the first rows of one table of normal numbers; paths are priced once for all counts."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        z, parts = normals(), []
        for t, root in zip(group["t"].to_pylist(), roots_of(group), strict=True):
            priced = task_losses_of(z[:, :4] @ root.T, z[:, 4:] @ root.T)
            for n in counts:
                mine = [(book, report, np.sort(x[:n])) for book, report, x in priced]
                parts.append(set_table([t] * len(mine), mine).append_column("draws", pa.array([n] * len(mine), pa.int64())))
        made = pa.concat_tables(parts) if parts else set_table([], []).append_column("draws", pa.array([], pa.int64()))
        return made.select(["t", "draws", "book", "report", "x"])

    return states.withColumn("span", F.floor(F.col("t") / SPAN)).groupBy("span").applyInArrow(run, SETS.format("draws long, "))


def radial_sets(returns: DataFrame, window: int = 250, draws: int = 4096, seed: int = 2, decay: float = 0.94, start: int = 20, origins: DataFrame | None = None, sobol: bool = False) -> DataFrame:
    """(t, book, report, x): losses, ascending, of two-step elliptical paths: directions even on the sphere, radii drawn from the window's own.

    A row's radius is the length of its increments in units of the covariance
    that they lead to; the window's radii are scaled to a mean square of 4, that
    of a Gaussian law in four dimensions. origins: the dates (t) to make, all if not given.
    sobol: draws are points of ten coordinates, eight for directions and two for radii.
    """
    last = returns.select((F.col("t") + 1).alias("t"), "r1", "r2", "r3", "r4")
    rows = covariance_states(returns, decay, start).join(last, "t")
    asked = F.lit(True) if origins is None else F.col("asked").isNotNull()
    rows = rows if origins is None else rows.join(F.broadcast(origins.select("t", F.lit(1).alias("asked"))), "t", "left")  # origins: a row a date
    rows = rows.withColumn("asked", asked)
    spans = F.sequence(F.floor(F.col("t") / SPAN), F.floor((F.col("t") + window - 1) / SPAN))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        every = sobol_array(10, draws, seed) if sobol else uniform_draws(draws, range(10), seed)
        z, u = polar(every[:, :8]), every[:, 8:]
        way = [x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (z[:, :4], z[:, 4:])]
        at, days, sets = (u * window).astype(int), [], []
        g = group.sort_by("t")
        t, asked, roots = g["t"].to_numpy(), g["asked"].to_numpy(), roots_of(g)
        steps = np.column_stack([g[f"r{k}"].to_numpy() for k in range(1, 5)])
        radius = np.sqrt((np.linalg.solve(roots, steps[:, :, None]) ** 2).sum(axis=(1, 2)))
        for i in np.flatnonzero((t // SPAN == key[0].as_py()) & asked & (np.arange(len(t)) >= window - 1)):
            own = radius[i - window + 1 : i + 1]
            own = own / np.sqrt((own * own).mean() / 4)
            mine = task_sets(*((way[k] * own[at[:, k], None]) @ roots[i].T for k in (0, 1)))
            days += [int(t[i])] * len(mine)
            sets += mine
        return set_table(days, sets)

    return rows.withColumn("span", F.explode(spans)).groupBy("span").applyInArrow(run, SETS.format(""))
