"""Every named query with SQL against DuckDB, on tables where each of them has rows."""

import functools
import importlib
import pkgutil

import duckdb
import pytest

import __spark_entry__
from riskloom import plans
from riskloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
FOLDER = "/root/testdata/sf0.01"
#: Queries that look for faults the tables do not have.
MAY_BE_EMPTY = {"panel_dup_check"}
#: Steps that many queries share; each is made once a test run, by the library's own code.
SHARED = ("panel", "returns", "forecasts", "scores", "filtered_sets")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps(spark, tmp_path_factory):
    """Puts a stored copy in the place of each shared step, in every module that uses it."""
    modules = [importlib.import_module(f"riskloom.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
    kept = [(m, n, getattr(m, n)) for m in modules for n in SHARED if hasattr(m, n)]

    def stored(step):
        @functools.lru_cache(None)
        def path(folder, rest, named):
            at = str(tmp_path_factory.mktemp("step") / "rows")
            step(spark, folder, *rest, **dict(named)).write.parquet(at)
            return at

        return lambda s, folder, *rest, **named: s.read.parquet(path(folder, rest, tuple(sorted(named.items()))))

    made = {}
    for m, n, f in kept:
        setattr(m, n, made.setdefault(f, stored(f)))
    yield
    for m, n, f in kept:
        setattr(m, n, f)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    con.execute(f"create or replace temp table want as {catalog.SQL[name]}")
    columns = [r[0] for r in con.execute("describe want").fetchall()]
    found = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(found.columns)
    con.register("got", found.select(columns).toArrow())
    rows = [con.execute(f"select count(*) from {x}").fetchone()[0] for x in ("want", "got")]
    assert rows[0] == rows[1] and (rows[0] or name in MAY_BE_EMPTY)
    for one, other in (("want", "got"), ("got", "want")):
        assert not con.execute(f"select * from {one} except all select * from {other} limit 3").fetchall()


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and {"var", "es", "score", "hit"} <= set(rows.columns)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
