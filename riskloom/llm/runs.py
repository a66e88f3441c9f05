"""Periodic runs of words: stretches that repeat one passage four times or more.

The suffixes of a document's words are sorted, and neighbours in that order are
united by decreasing length of their common prefix (Kruskal's order), so a
class at level l holds the positions that share l words. Classes are ordered sets,
and the smaller joins the larger. Two positions that become neighbours within a
class, at a distance p of no more than l, mark a stretch of period p: it reaches
p + l words on, exactly, and starts there unless the word before continues it. Both
ends of a run's first period become neighbours at some level, because a position
between them in their class would give the run a smaller period.

Levels end where no run of the asked length can start, so a document without
repeated passages costs one look at its word pairs. A document is one row of one task;
time is n log n word comparisons in NumPy plus the unions, memory some 150 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: A part of an ordered set is cut in two at this size.
PART = 1024


class Positions:
    """An ordered set of whole numbers in parts, so that adding one moves few others."""

    def __init__(self, first: int) -> None:
        self.parts, self.heads, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Adds x and gives its neighbours."""
        k = max(bisect_right(self.heads, x) - 1, 0)
        part = self.parts[k]
        at = bisect_left(part, x)
        left = part[at - 1] if at else (self.parts[k - 1][-1] if k else None)
        right = part[at] if at < len(part) else (self.heads[k + 1] if k + 1 < len(self.parts) else None)
        insort(part, x)
        self.heads[k] = part[0]
        self.size += 1
        if len(part) > PART:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]
            self.heads[k : k + 1] = [part[0], part[half]]
        return left, right

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part


def suffix_neighbours(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, position, common prefix) of neighbours in the order of suffixes that share ``least`` words or more; words are whole numbers from 1."""
    n = len(words)
    ranks, step = [words.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - step, 0)] = rank[step:] if step < n else rank[:0]
        keys = rank * (n + 1) + ahead
        order = np.argsort(keys, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (np.diff(keys[order]) != 0).astype(np.int64)]))
        step *= 2
        if int(new[order[-1]]) == n:
            break
        ranks.append(new)
    if step <= least:  # all suffixes differ within fewer words
        return tuple(np.empty(0, np.int64) for _ in range(3))
    one, two, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = one + common, two + common
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        common[same] += 1 << k
    common = np.minimum(common, n - np.maximum(one, two))
    keep = common >= least
    return one[keep], two[keep], common[keep]


def find_runs(words: list[str], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period: the smallest period, at least min_length words and min_exponent periods, extended as far as the period holds."""
    n = len(words)
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    if n < min_length:
        return []
    place: dict[str, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place) + 1) for w in words), np.int64, n)
    least = min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))
    one, two, common = suffix_neighbours(ids, least)
    codes = ids.tolist() if len(one) else []
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    order = np.argsort(-common, kind="stable")
    for a, b, level in zip(one[order].tolist(), two[order].tolist(), common[order].tolist(), strict=True):
        a, b = top(a), top(b)
        large, small = sets.get(a) or Positions(a), sets.get(b) or Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        root[b] = a
        sets[a] = large
        sets.pop(b, None)
        for x in small:
            left, right = large.add(x)
            for i, j in ((left, x), (x, right)):
                if i is None or j is None or (p := j - i) > level or p + level < max(min_length, min_exponent * p):
                    continue
                if (i == 0 or codes[i - 1] != codes[j - 1]) and (j + level == n or codes[i + level] != codes[j + level]):  # neighbours of one class before have more in common
                    found[i, p + level] = min(p, found.get((i, p + level), p))
    return sorted((start, length, p) for (start, length), p in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: runs as array<struct<start, length, period>> in words, and the text's words without a run's repeats, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. Null and empty texts have no
    run and an empty collapsed text. Repeated rows and null ids each return their
    row; other columns are not read; an empty table returns none. No text is too long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1):
                words = [w.decode("utf-8", "surrogatepass") for w in (text.as_py() or "").encode("utf-8", "surrogatepass").split()]
                found = find_runs(words, min_length, min_exponent)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(" ".join(np.array(words, object)[kept_words(len(words), found)]) if found else " ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def echoed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, with a passage of its words repeated to its end; the others as they are.

    With h the checksum and g = h div 10, word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    rows = id_and_text(docs, id_col, text_col)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = rows.withColumn("w", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    parts = chosen.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return parts.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run, ties to the smallest start, then period; digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.length")
    return told.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.floor(1000 * length / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
