"""Readers and writers: typed CSV, yearly shards, nested JSON parameters, manifests and report tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; where none is named, below a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="riskloom-")
    MADE.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


#: Folders that scratch has named in this process.
MADE: list[str] = []


def discard(spark: SparkSession) -> int:
    """Deletes what this process has written to scratch folders, and says how many there were. For when no table that reads them is needed any more."""
    gone = 0
    while MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows may use it often without making it again."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] = ()) -> DataFrame:
    """A headed CSV by an explicit schema; malformed rows fail the job. Doubles read back exactly."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, by: Sequence[str] = (), compressed: bool = False) -> None:
    """Headed CSV with the shortest digits that read back exactly, partitioned by columns; an existing folder is an error."""
    writer = df.write.mode("errorifexists").option("header", True)
    writer = writer.option("compression", "gzip") if compressed else writer
    (writer.partitionBy(*by) if by else writer).csv(path)


def union_sources(frames: Iterable[tuple[str, DataFrame]], name: str = "source_name") -> DataFrame:
    """All frames below each other by column name, missing columns null, with the name each came under."""
    out = None
    for label, df in frames:
        df = df.withColumn(name, F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merge_shards(spark: SparkSession, paths: Sequence[str], keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Parquet shards as one table; repeated keys, or another number of rows than given, are errors. Rows have no order; sort where one is shown."""
    df = spark.read.parquet(*paths)
    if twice := df.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError(f"repeated key {twice[0]}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file that the path pattern names, as it is stored."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def gunzipped(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """(path, value): the lines of every gzip file that the path pattern names, read as a stream each, after all files have been held against digests (path, sha256).

    A file without its digest, one that differs, and a digest without its file are errors, before any line is read.
    """
    found = file_digests(spark, path).withColumnRenamed("sha256", "found")
    told = found.join(digests, "path", "full")
    if wrong := told.where(~F.col("found").eqNullSafe(F.col("sha256"))).take(3):
        raise ValueError(f"digest differs: {', '.join(r.path for r in wrong)}")
    return spark.read.text([r.path for r in found.select("path").collect()]).select(F.col("_metadata.file_path").alias("path"), "value")  # a name a file


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(cutoff, reference, node, parameters...) of yearly fits kept as nested JSON: fits[] with nodes[] and garch[] side by side."""
    raw = spark.read.option("multiLine", True).json(path)
    fit = raw.select("cutoff", F.explode("fits").alias("fit"))
    pair = fit.select("cutoff", F.col("fit.reference").alias("reference"), F.explode(F.arrays_zip(F.col("fit.nodes").alias("node"), F.col("fit.garch").alias("garch"))).alias("p"))
    return pair.select("cutoff", "reference", F.col("p.node").alias("node"), "p.garch.*")


def lineage(df: DataFrame, *keys: str) -> DataFrame:
    """One row: number of rows, and a digest that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in (keys or df.columns)])), 256)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")), F.lit(0).cast("long")).alias("digest"))


def write_manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame], **facts) -> dict:
    """JSON with facts and the lineage of each table; NaN is refused, an existing file an error."""
    made = facts | {"tables": {name: lineage(df).first().asDict() for name, df in tables.items()}}
    spark.createDataFrame([(json.dumps(made, allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return made


def read_pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells) of a Markdown pipe table, its rule left out."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    bare = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    return lines.select("line", F.transform(F.split(bare, r"\|"), lambda x: F.trim(x)).alias("cells"))


def pipe_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    """(row): each row as a line of a Markdown table, doubles at fixed digits."""
    cells = [F.format_string(f"%.{digits}f", c) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |")).alias("row"))
