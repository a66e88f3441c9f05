"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which a cluster shares; without one, a temporary folder in local mode only, where driver and executors are one process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the input does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def place_among(cuts: str, value: Column, most: int) -> Column:
    """How many of the ascending array ``cuts``, of fewer than ``most`` entries, are smaller than the value; halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.try_element_at(F.col(cuts), at + step) < value), at + step).otherwise(at))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_texts(df: DataFrame, row: Callable[[str], tuple], schema: str, types: list[pa.DataType], setup: Callable[[], object] | None = None) -> DataFrame:
    """Adds to each (doc_id, text) row what ``row`` makes of the text; Arrow batches, one small tuple a row.

    With ``setup`` the function is called as ``row(state, text)``, the state being made once a task.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))  # one at a time: a batch of long texts stays in Arrow's memory alone
            out = [row(state, t) if setup else row(t) for t in texts]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return df.mapInArrow(run, f"doc_id long, {schema}")
