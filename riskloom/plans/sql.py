"""DuckDB twins of the shared steps, as named common table expressions."""

from __future__ import annotations

from riskloom.operators.books import BOOKS, REPORTS

K = (1, 2, 3, 4)


def r6(x: str) -> str:
    return f"(round({x}, 6) + CAST(0 AS DOUBLE))"


def loss_sql(book: str, report: int, a: str = "a", b: str = "b") -> str:
    base, weights = BOOKS[book]
    start = f"CAST({base} AS DOUBLE)" + "".join(f" + CAST({w} AS DOUBLE) * exp({a}{k})" for k, w in zip(K, weights, strict=True))
    hold = "CAST(0 AS DOUBLE)" + "".join(f" + CAST({w} AS DOUBLE) * (exp({a}{k}) - exp({a}{k} + {b}{k}))" for k, w in zip(K, weights, strict=True))
    n1, n2 = (f"{a}{report}", f"{b}{report}") if report else ("CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")
    return f"(({start}) * exp(-({n1})) - (({start}) - ({hold})) * exp(-({n1}) - ({n2})))"


def each_task(select: str, source: str, value: str = "loss") -> str:
    """UNION ALL over books and reporting units."""
    return " UNION ALL ".join(f"SELECT {select}, '{book}' AS book, '{report}' AS report, {loss_sql(book, n)} AS {value} FROM {source}" for book in BOOKS for report, n in REPORTS.items())


def returns_step(h: int) -> str:
    sums = ", ".join(f"sum(r{k}) OVER w AS b{k}" for k in K)
    return f"SELECT * EXCLUDE (n) FROM (SELECT t AS s, count(*) OVER w AS n, {', '.join(f'r{k} AS a{k}' for k in K)}, {sums} FROM returns WINDOW w AS (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) WHERE n = {h}"


def set_step(source: str, window: int, h: int = 1) -> str:
    """Losses of the window - h increments known at each origin, ascending."""
    frame = f"(PARTITION BY book, report ORDER BY s ROWS BETWEEN {window - h - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT t, book, report, list_sort(x) AS x FROM (SELECT s + {h + 1} AS t, book, report, list(loss) OVER {frame} AS x, count(*) OVER {frame} AS n FROM {source}) WHERE n = {window - h}"


def risk_step(source: str, keys: str) -> str:
    """VaR and ES of sets x."""
    return f"""SELECT {keys}, CAST(n AS BIGINT) AS n, tau, q AS var, q + list_sum(list_transform(tail, lambda v: v - q)) / n / (1 - CAST(tau AS DOUBLE)) AS es
    FROM (SELECT {keys}, tau, len(x) AS n, x[i] AS q, x[i:] AS tail
          FROM (SELECT {keys}, x, tau, greatest(CAST(ceil(tau * len(x)) AS INTEGER), 1) AS i FROM {source} CROSS JOIN taus))"""


def score_step(source: str, extra: str = "", realised: str = "realised") -> str:
    return f"""SELECT * FROM (SELECT f.*, a.actual{extra}, CAST(a.actual > f.var AS INTEGER) AS hit,
      f.es - f.var - greatest(a.actual - f.var, 0.0) / (1 - CAST(tau AS DOUBLE)) AS tail_residual,
      CASE WHEN f.es > 0 AND f.es >= f.var - 1e-10 THEN greatest(a.actual - f.var, 0.0) / ((1 - CAST(tau AS DOUBLE)) * f.es) + f.var / f.es + ln(CASE WHEN f.es > 0 THEN f.es ELSE 1 END) - 1 END AS score
      FROM {source} f JOIN {realised} a USING (t, book, report)) WHERE score IS NOT NULL"""


def unit_prices(bucket: str) -> str:
    return f"""SELECT CAST(date_trunc('{bucket}', l_shipdate) AS DATE) AS d, l_linenumber AS k,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS px
    FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4 AND l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2"""


#: Windows of historical simulation; BASE is that of the diagnostics.
WINDOWS = (250, 500, 1250)
BASE = 250

#: Steps that refer to themselves; all others are worked out once.
RECURSIVE = ("garch", "ewma")

STEPS: dict[str, tuple[str, tuple[str, ...]]] = {
    "taus": ("SELECT unnest([CAST(0.95 AS DECIMAL(3,2)), CAST(0.99 AS DECIMAL(3,2))]) AS tau", ()),
    "px": (unit_prices("day"), ()),
    "wide": ("SELECT d, " + ", ".join(f"max(CASE WHEN k = {k} THEN px END) AS p{k}" for k in K) + " FROM px GROUP BY d", ("px",)),
    "panel": ("SELECT row_number() OVER (ORDER BY d) AS t, * FROM wide WHERE " + " AND ".join(f"p{k} IS NOT NULL" for k in K), ("wide",)),
    "returns": ("SELECT * FROM (SELECT t, d, " + ", ".join(f"ln(lead(p{k}) OVER (ORDER BY t) / p{k}) AS r{k}" for k in K) + " FROM panel) WHERE r1 IS NOT NULL", ("panel",)),
    "pairs": (returns_step(1), ("returns",)),
    "pairs5": (returns_step(5), ("returns",)),
    "priced": (each_task("s", "pairs"), ("pairs",)),
    "realised": ("SELECT s AS t, book, report, loss AS actual FROM priced", ("priced",)),
    f"losses{BASE}": (f"SELECT o.t, p.s, p.book, p.report, p.loss FROM priced p JOIN (SELECT t FROM panel WHERE t > {BASE}) o ON p.s BETWEEN o.t - {BASE} AND o.t - 2", ("priced", "panel")),
    **{f"sets{w}": (set_step("priced", w), ("priced",)) for w in WINDOWS},
    **{f"risk{w}": (risk_step(f"sets{w}", "t, book, report"), (f"sets{w}", "taus")) for w in WINDOWS},
    "forecasts": (" UNION ALL ".join(f"SELECT 'HS{w}' AS model, * FROM risk{w}" for w in WINDOWS), tuple(f"risk{w}" for w in WINDOWS)),
    "scores": (score_step("forecasts"), ("forecasts", "realised")),
    "dated": ("SELECT s.*, p.d FROM scores s JOIN panel p USING (t)", ("scores", "panel")),
}


def sql(select: str, *needs: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None, recursive: bool = False) -> str:
    """select with the steps it needs, and theirs, in front."""
    steps, order = STEPS | (extra or {}), []

    def add(name: str) -> None:
        if name not in order:
            for before in steps[name][1]:
                add(before)
            order.append(name)

    for name in needs:
        add(name)
    body = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({steps[n][0]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"
