"""Queries of readers and writers, over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.columns import r6
from riskloom.operators.panel import SERIES
from riskloom.operators.reshape import basis_long
from riskloom.operators.risk import historical_sets, var_es
from riskloom.plans.base import KEYS, panel, returns
from riskloom.plans.risk_queries import FILTER, qs, told
from riskloom.plans.sql import K, each_task, r6 as q6, returns_step, risk_step, set_step, sql
from riskloom.sources import io

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("csv_round_trip", sql("SELECT t, CAST(d AS VARCHAR) AS d, " + ", ".join(f"p{k}" for k in K) + " FROM panel", "panel"))
def csv_round_trip(spark, d):
    """The panel written as CSV and read back, digit for digit."""
    at = io.scratch(spark, "panel-csv")
    io.write_csv(panel(spark, d), at)
    return io.read_csv(spark, at, "t long, d date, " + ", ".join(f"p{k} double" for k in SERIES)).withColumn("d", F.col("d").cast("string"))


@query("yearly_shards", sql("SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n, " + q6("sum(r1)") + " AS total FROM returns GROUP BY 1", "returns"))
def yearly_shards(spark, d):
    """Compressed shards by year, scanned together by a path pattern."""
    at = io.scratch(spark, "returns-by-year")
    io.write_csv(returns(spark, d).withColumn("year", F.year("d")), at, by=["year"], compressed=True)
    back = spark.read.schema("t long, d date, r1 double, r2 double, r3 double, r4 double, year int").option("basePath", at).option("header", True).csv(f"{at}/year=*")
    return back.groupBy("year").agg(F.count("*").alias("n"), r6(F.sum("r1")).alias("total"))


@query("source_union", "SELECT 'orders' AS source_name, o_custkey AS customer, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS kind FROM orders UNION ALL SELECT 'events', user_id, value, event_type FROM events")
def source_union(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"))
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("customer"), F.col("value").alias("amount"), F.col("event_type").alias("kind"))
    return io.union_sources([("orders", o), ("events", e)]).select("source_name", "customer", "amount", "kind")


@query("json_properties", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_properties(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("lineage")
def lineage(spark, d):
    """Row counts and order-free digests of the panel and its increments."""
    return io.union_sources([("panel", io.lineage(panel(spark, d))), ("returns", io.lineage(returns(spark, d)))])


@query("report_rows", sql("SELECT '| ' || book || ' | ' || report || ' | ' || printf('%.4f', m) || ' |' AS row FROM (SELECT book, report, avg(loss) AS m FROM priced GROUP BY 1, 2)", "priced"))
def report_rows(spark, d):
    from riskloom.operators.risk import realised

    m = realised(returns(spark, d)).groupBy("book", "report").agg(F.avg("actual").alias("m"))
    return io.pipe_rows(m)


def at_horizon(h: int):
    def run(spark, d):
        return told(var_es(historical_sets(returns(spark, d), 250, h), KEYS))

    return run


for h_ in (5, 20):
    query(f"hs_horizon_{h_}", sql("SELECT t, book, report, n, CAST(tau AS DOUBLE) AS tau, " + qs("var", "es") + " FROM risk_h", "risk_h", extra={
        "pairs_h": (returns_step(h_), ("returns",)),
        "priced_h": (each_task("s", "pairs_h"), ("pairs_h",)),
        "sets_h": (set_step("priced_h", 250, h_), ("priced_h",)),
        "risk_h": (risk_step("sets_h", "t, book, report"), ("sets_h", "taus"))}))(at_horizon(h_))


@query("merged_shards", sql("SELECT t, " + ", ".join(f"{q6(f'r{k}')} AS r{k}" for k in K) + " FROM returns", "returns"))
def merged_shards(spark, d):
    """Two shards of the increments as one table, keys checked."""
    at, r = io.scratch(spark, "shards"), returns(spark, d).drop("d")
    for k in (0, 1):
        r.where(f"t % 2 = {k}").write.parquet(f"{at}/{k}")
    return told(io.merge_shards(spark, [f"{at}/0", f"{at}/1"], ["t"]))


MOMENTS = {"mu": "avg(r)", "omega": "var_pop(r)"}


@query("nested_parameters", sql("SELECT CAST(cutoff AS VARCHAR) AS cutoff, reference, node, " + ", ".join(f"{q6(e)} AS {n}" for n, e in MOMENTS.items()) + " FROM (SELECT max(d) OVER (PARTITION BY year(d)) AS cutoff, reference, node, x.x / 100 AS r FROM x100 x JOIN returns USING (t)) GROUP BY ALL", "x100", "returns", extra=FILTER))
def nested_parameters(spark, d):
    """Yearly means and variances of every node, written as nested JSON, a file a year, and read back."""
    cut = returns(spark, d).select("t", F.max("d").over(Window.partitionBy(F.year("d"))).cast("string").alias("cutoff"))
    x = basis_long(returns(spark, d)).join(cut, "t").groupBy("cutoff", "reference", "node").agg(F.avg("r").alias("mu"), F.var_pop("r").alias("omega"))
    fit = x.groupBy("cutoff", "reference").agg(F.collect_list("node").alias("nodes"), F.collect_list(F.struct("mu", "omega")).alias("garch"))
    at = io.scratch(spark, "parameters")
    fit.groupBy("cutoff").agg(F.collect_list(F.struct("reference", "nodes", "garch")).alias("fits")).withColumn("year", F.substring("cutoff", 1, 4)).repartition("year").write.partitionBy("year").json(at)
    return told(io.read_parameters(spark, f"{at}/year=*"))


@query("pipe_table_round_trip", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def pipe_table_round_trip(spark, d):
    """Report rows written as a Markdown table and parsed again."""
    n, at = spark.read.parquet(f"{d}/nation.parquet").select("n_name", F.col("n_regionkey").cast("string")), io.scratch(spark, "report")
    io.pipe_rows(n).write.text(at)
    return io.read_pipe_table(spark, at).select(F.col("cells")[0].alias("name"), F.col("cells")[1].alias("region"))


@query("manifest_rows", "SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem)")
def manifest_rows(spark, d):
    """Row counts as a written manifest tells them."""
    at = io.scratch(spark, "manifest")
    io.write_manifest(spark, at, {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "lineitem")}, status="completed")
    made = spark.read.text(at).select(F.from_json("value", "tables map<string, struct<rows: long, digest: long>>").alias("m"))
    return made.select(F.explode("m.tables").alias("name", "x")).select("name", F.col("x.rows").alias("rows"))


@query("gunzip_verified", sql("SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n FROM returns GROUP BY 1", "returns"))
def gunzip_verified(spark, d):
    """Yearly gzip shards, read after they are held against the digests kept when they were written, and counted by line."""
    at = io.scratch(spark, "gzip")
    io.write_csv(returns(spark, d).withColumn("year", F.year("d")), at, by=["year"], compressed=True)
    kept = io.scratch(spark, "gzip-digests")
    io.file_digests(spark, f"{at}/year=*/*.gz").write.json(kept)  # what the writer vouches for
    lines = io.gunzipped(spark, f"{at}/year=*/*.gz", spark.read.schema("path string, sha256 string").json(kept)).where("value not like 't,%'")  # a header each
    return lines.groupBy(F.regexp_extract("path", r"year=(\d+)", 1).cast("int").alias("year")).agg(F.count("*").alias("n"))
