"""Runs by year that take up where the last one ended."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.io import lineage


class Shards:
    """A folder of one table by year. A shard is published as a whole, by a rename, together with the note of what it was made from.

    run() makes the years that are missing or whose inputs have changed, and leaves
    the others alone; a run that is lost half way leaves no half shard. One run writes at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, year: int) -> str:
        return f"{self.root}/year={year}"

    def note(self, year: int) -> str | None:
        """What the shard was made from; nothing where there is no shard."""
        at = f"{self.at(year)}/_made_from"
        if not self.files.exists(self.path(at)):
            return None
        return json.loads(self.spark.read.text(at).first().value)["made_from"]

    def publish(self, year: int, rows: DataFrame, made_from: str) -> None:
        draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
        rows.write.parquet(f"{draft}/rows")
        self.spark.createDataFrame([(json.dumps({"made_from": made_from, "year": year}),)], "value string").coalesce(1).write.text(f"{draft}/_made_from")
        target = self.path(self.at(year))
        if self.files.exists(target):
            self.files.delete(target, True)
        if not self.files.rename(self.path(draft), target):
            raise OSError(f"shard {year} could not be published")

    def run(self, years: Iterable[int], make: Callable[[int], DataFrame], made_from: Callable[[int], str]) -> list[int]:
        """The years that were made."""
        made = []
        for year in sorted(years):
            now = made_from(year)
            if self.note(year) != now:
                self.publish(year, make(year), now)
                made.append(year)
        return made

    def read(self) -> DataFrame:
        """All shards with their year. Drafts and notes are left out by their names."""
        return self.spark.read.option("basePath", self.root).parquet(f"{self.root}/year=*/rows")


def fingerprint(df: DataFrame) -> str:
    """Rows and an order-free digest of a table, as one text."""
    told = lineage(df).first()
    return f"{told.rows}:{told.digest}"


def fingerprints(df: DataFrame, by: str) -> dict:
    """{value of by: rows and digest of its rows}, from one pass."""
    from pyspark.sql import functions as F

    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    g = df.groupBy(by).agg(F.count("*").alias("rows"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("digest"))
    return {r[by]: f"{r.rows}:{r.digest}" for r in g.collect()}
