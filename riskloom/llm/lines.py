"""Cross-site boilerplate lines, by the number of distinct sites that carry a line.

Every line becomes a hash beside the document and site that have it; no text
travels with it. One aggregation by hash merges HyperLogLog sketches of the
sites, map-side first, so a line that a third of all documents share arrives as
one sketch a task. Lines whose estimate lies near the threshold get an exact
distinct count, again from partial aggregates. The lines found are then taken out of
every document but the first that has them. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh


def line_hash(line: Column) -> Column:
    """64-bit hash of a line without the white space around it; null where nothing is left."""
    bare = F.btrim(line, F.lit(" \t\r\v\f"))
    return F.when(bare != "", F.xxhash64(bare))


def document_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc_id, site, line): the hash of every line that is not blank, once a document and site."""
    lines = F.array_distinct(F.transform(F.split(F.col(f"`{text_col}`"), "\n"), line_hash))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"), F.explode(lines).alias("line"))
    return rows.where("line is not null")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """(line, keeper) of the lines that at least min_sites sites carry; keeper is the smallest doc_id that has the line.

    Only lines whose estimate lies near the threshold or above it are written down.
    """
    margin = 1 + min_sites * error(lg_k)
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("doc_id").alias("keeper"))
    sketched = cut_lineage(sketched.where(F.col("sites") >= min_sites - margin))
    near = F.abs(F.col("sites") - min_sites) <= margin
    unsure = sketched.where(near).select("line")
    sites = lines.select("line", "site").distinct()  # a hot line shrinks to its sites before it meets others
    exact = sites.join(unsure, "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    sure = sketched.where(~near & (F.col("sites") >= min_sites)).select("line", "keeper")
    return sure.unionByName(sketched.join(exact, "line").select("line", "keeper"))


def error(lg_k: int) -> float:
    """Four standard errors of a sketch of 2**lg_k registers."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 3, lg_k: int = 12, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs with the lines that min_sites or more distinct sites carry taken out of all documents but the one with the smallest id.

    Lines end at \\n and are compared without the white space around them; blank
    lines stay. A document that loses all lines has an empty text; null stays
    null. A null site is a site of its own, like an empty one. Rows with one id are one
    document. Rows with a null id count, but keep their lines. Other columns stay
    as they are; an empty table returns none. Lines are told apart by a 64-bit hash.

    The lines found are broadcast while they are at most broadcast_rows (16
    bytes each) and joined by a shuffle beyond, which adaptive execution splits where a line is hot. So are
    the documents' own lists of what they lose, by the same bound on their lines and
    documents; beyond it texts are shuffled to meet them.
    """
    lines = cut_lineage(document_lines(docs, id_col, text_col, site_col))
    spread = cut_lineage(spread_lines(lines, min_sites, lg_k))
    small = spread.count() <= broadcast_rows
    found = lines.join(F.broadcast(spread) if small else spread, "line").where("doc_id <> keeper")
    key, gone = fresh(docs, "gone_id", "gone_lines")
    gone_lines = cut_lineage(found.groupBy("doc_id").agg(F.collect_set("line").alias(gone)).withColumnRenamed("doc_id", key))
    size = gone_lines.agg(F.coalesce(F.sum(1 + F.size(gone)), F.lit(0)).alias("n")).first().n
    joined = docs.join(F.broadcast(gone_lines) if size <= broadcast_rows else gone_lines, docs[f"`{id_col}`"] == gone_lines[key], "left")
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(gone), line_hash(x)), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
