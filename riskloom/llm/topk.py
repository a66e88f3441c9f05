"""Exact top-k inner-product search with a KD-tree per shard.

Shards are the cells of a KD-tree over the whole table: median splits of a
bounded sample say where the space is cut, and every row falls into one cell, so
a shard's tight bounding box is small. A cell with far more rows than planned (equal
vectors cannot be split) is cut further by ranges of ids. Each shard's task builds its
KD-tree once, of median splits whose nodes keep tight boxes, and the trees stay as
rows of a table. What the driver holds is a box and a count a shard, for a bounded
number of shards.

A query goes first to the shard whose box allows the largest inner product, and
takes the k-th score found along: the shards that come next by their bounds, and at last
all others, see it only if their box reaches that score. Within a shard it walks the
tree best-first by the same bound and stops where that falls below its k-th score.
Shards stream their queries, so a task holds one shard, whatever the number of queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, place_among

LEAF = 64
NONE = -(1 << 63)
MOST = (1 << 63) - 1


class KDTree:
    """Median splits along the widest side of each node's tight box; members of a node lie together, leaves by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n, low, high, spans, kids, least = len(ids), [], [], [], [], []
        order, work = np.arange(n), [(0, n, -1)]
        while work:
            a, b, parent = work.pop()
            part = vectors[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            at = len(spans)
            low.append(lo)
            high.append(hi)
            spans.append((a, b))
            kids.append([])
            least.append(int(ids[order[a:b]].min()))
            if parent >= 0:
                kids[parent].append(at)
            side = int(np.argmax(hi - lo)) if part.shape[1] else 0
            if b - a > LEAF and (hi != lo).any():
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], middle)]
                work += [(a + middle, b, at), (a, a + middle, at)]
            else:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.ids, self.vectors, self.spans, self.kids, self.least = ids[order], vectors[order], spans, kids, least
        self.low, self.high = np.array(low), np.array(high)

    def kept(self) -> bytes:
        """The tree as bytes of plain arrays, its vectors in the narrowest type that holds them."""
        most = max(abs(int(self.low.min(initial=0))), abs(int(self.high.max(initial=0))))
        kind = next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)
        return pickle.dumps(self.__dict__ | {"vectors": self.vectors.astype(kind)}, 5)

    @classmethod
    def of(cls, kept: bytes) -> KDTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(kept)
        return tree

    def as_numbers(self, kind: type) -> KDTree:
        self.vectors, self.low, self.high = (x.astype(kind) for x in (self.vectors, self.low, self.high))
        return self

    def search(self, query_id: int, query: np.ndarray, k: int, bound: tuple[int, int] = (NONE, NONE)) -> list[tuple[int, int]]:
        """The best (score, -id), at most k, of those not below the bound, a score and an id with its sign turned."""
        most = reach(query[None], self.low, self.high)[0]
        best, heap = [], [(-most[0], 0)]
        while heap:
            top, at = heapq.heappop(heap)
            worst = best[0] if len(best) == k else bound
            if -top < worst[0]:
                break
            if (-top, -self.least[at]) < worst:
                continue  # an equal score at best, and larger ids only
            if self.kids[at]:
                for kid in self.kids[at]:
                    if most[kid] >= worst[0]:
                        heapq.heappush(heap, (-most[kid], kid))
                continue
            a, b = self.spans[at]
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= worst[0]):
                found = (int(scores[i]), -int(self.ids[a + i]))
                if found[1] == -query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    up = np.maximum(queries, 0)
    return up @ high.T + (queries - up) @ low.T


def exact_kind(*values: np.ndarray) -> type:
    """Doubles, which are faster, where every inner product of such numbers is exact in them; else 64-bit numbers."""
    most = max((float(np.abs(v.astype(np.float64)).max()) for v in values if v.size), default=0.0)
    return np.float64 if values[0].shape[-1] * most**2 < 2**52 else np.int64


def cut_space(sample: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """(side, value, left, right) of each node of a tree that cuts space into at most that many cells, at medians of the sample along the widest side; below the value is left. A kid -1 - c is cell c. No node where nothing can be cut."""
    nodes: list[list[int]] = []
    count, work = 0, [(sample, cells, -1, 0)]
    while work:
        part, want, parent, kid = work.pop()
        wide = part.max(axis=0) - part.min(axis=0) if len(part) and part.shape[1] else np.zeros(1)
        if want > 1 and len(part) > 1 and wide.max() > 0:
            side = int(wide.argmax())
            x = part[:, side]
            value = int(np.partition(x, len(x) // 2)[len(x) // 2])
            value = value if (x < value).any() else int(x[x > value].min())
            me = len(nodes)
            nodes.append([side, value, 0, 0])
            work += [(part[x >= value], want - want // 2, me, 3), (part[x < value], want // 2, me, 2)]
        else:
            me, count = -1 - count, count + 1
        if parent >= 0:
            nodes[parent][kid] = me
    return [tuple(x) for x in nodes]


def cells_of(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray) -> np.ndarray:
    """The cell of each vector."""
    if not nodes:
        return np.zeros(len(vectors), np.int64)
    side, value, left, right = np.array(nodes, np.int64).T
    at, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    while len(rows):
        here = at[rows]
        at[rows] = np.where(vectors[rows, side[here]] < value[here], left[here], right[here])
        rows = rows[at[rows] >= 0]
    return -1 - at


def matrix(column: pa.Array, a: int, b: int, dim: int) -> np.ndarray:
    return column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dim)


def runs_of(dims: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(dims)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(dims)], strict=True)


def placed(rows: DataFrame, shard_rows: int, max_shards: int, sample_rows: int, seed: int) -> DataFrame:
    """(dim, cell, part, id, vec) of rows (dim, id, vec): the cell of space that holds the vector, and the range of ids in it."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    shard_rows = max(shard_rows, -(-total // max_shards))
    large = {r.dim: r.rows for r in counts.where(F.col("rows") > shard_rows).collect()}  # max_shards at most
    cuts = {}
    if large:
        share = min(1.0, sample_rows / total)
        sample = rows.where(F.col("dim").isin(list(large))).sample(share, seed).select("dim", "vec").limit(2 * sample_rows).toPandas()
        for dim, vecs in sample.groupby("dim")["vec"]:
            cuts[dim] = cut_space(np.stack(vecs.to_numpy()), -(-large[dim] // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(0).to_numpy()
            cells = [cells_of(cuts.get(int(dims[a]), []), matrix(batch.column(2), a, b, dims[a])) for a, b in runs_of(dims)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(cells), pa.int32()), batch.column(1), batch.column(2)], names=["dim", "cell", "id", "vec"])

    if not large:
        return rows.select("dim", F.lit(0).alias("cell"), F.lit(0).alias("part"), "id", "vec")
    celled = cut_lineage(rows.select("dim", "id", "vec").mapInArrow(run, "dim int, cell int, id long, vec array<long>"))
    full = celled.groupBy("dim", "cell").agg(F.count("*").alias("rows")).where(2 * F.col("rows") > 3 * shard_rows)
    full = cut_lineage(full.select("dim", "cell", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("rows") / shard_rows))).cast("int").alias("parts")))
    out = celled.join(F.broadcast(full.select("dim", "cell")), ["dim", "cell"], "left_anti").withColumn("part", F.lit(0))  # full has fewer rows than max_shards
    for (parts,) in full.select("parts").distinct().collect():
        own = celled.join(F.broadcast(full.where(F.col("parts") == parts).select("dim", "cell")), ["dim", "cell"])
        cut = own.groupBy("dim", "cell").agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("cuts"))
        out = out.unionByName(own.join(F.broadcast(cut), ["dim", "cell"]).withColumn("part", place_among("cuts", F.col("id"), parts)).drop("cuts"))
    return out.select("dim", "cell", "part", "id", "vec")


def planted(rows: DataFrame) -> DataFrame:
    """(dim, cell, part, n, least, low, high, tree): one row a shard, with its KD-tree."""
    dealt = rows.select("dim", "cell", "part", "id", "vec").repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    names = ["dim", "cell", "part", "n", "least", "low", "high", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []

        def row() -> pa.RecordBatch:
            tree = KDTree(np.concatenate(ids), np.concatenate(vectors))
            one = [*map(int, now), len(tree.ids), tree.least[0], tree.low[0].tolist(), tree.high[0].tolist(), tree.kept()]
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if now != (key := tuple(keys[a])):
                    if ids:
                        yield row()
                    now, ids, vectors = key, [], []
                ids.append(batch.column(3).to_numpy()[a:b])
                vectors.append(matrix(batch.column(4), a, b, key[0]))
        if ids:
            yield row()

    return dealt.mapInArrow(run, "dim int, cell int, part int, n long, least long, low array<long>, high array<long>, tree binary")


class Boxes:
    """Keys, rows, smallest ids and boxes of the shards of one dimension."""

    def __init__(self, rows: list):
        self.keys = [(r.cell, r.part) for r in rows]
        self.n, self.least = (np.array([r[c] for r in rows], np.int64) for c in ("n", "least"))
        self.low, self.high = (np.array([r[c] for r in rows], np.int64).reshape(len(rows), -1) for c in ("low", "high"))


def routed(asked: DataFrame, boxes: dict[int, Boxes], k: int, turn: int, fan: int) -> DataFrame:
    """(dim, cell, part, id, vec, score, worst) of asked (dim, id, vec, score, worst), once for each shard it goes to in this turn.

    Shards stand in the order of their bounds. Turn 0: the first, and more until
    they hold k rows besides the query's own. Turn 1: the next ``fan`` of them,
    turn 2 all others; both only where the box reaches the k-th score so far, or
    equals it and has smaller ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, score, worst = (batch.column(c).to_numpy() for c in (0, 3, 4))
            for a, b in runs_of(dims):
                if int(dims[a]) not in boxes:
                    continue
                own, queries = boxes[int(dims[a])], matrix(batch.column(2), a, b, dims[a])
                kind = exact_kind(queries, own.low, own.high)
                most = reach(queries.astype(kind), own.low.astype(kind), own.high.astype(kind)).astype(np.int64)
                order = np.argsort(-most, axis=1, kind="stable")
                first = 1 + np.argmax(np.append(np.cumsum(own.n[order], axis=1), np.full((b - a, 1), MOST), axis=1) > k, axis=1)[:, None]
                place = np.arange(len(own.n))[None]
                sent = (place < first) if turn == 0 else (place >= first) & (place < first + fan) if turn == 1 else place >= first + fan
                if turn:
                    bound, least = np.take_along_axis(most, order, 1), own.least[order]
                    sent &= (bound > score[a:b, None]) | ((bound == score[a:b, None]) & (-least >= worst[a:b, None]))
                row, at = np.nonzero(sent)
                shard = [own.keys[s] for s in order[row, at]]
                take = batch.slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take.column(0), *(pa.array([s[c] for s in shard], pa.int32()) for c in (0, 1)), *(take.column(c) for c in range(1, 5))], names=["dim", "cell", "part", "id", "vec", "score", "worst"])

    return asked.select("dim", "id", "vec", "score", "worst").mapInArrow(run, "dim int, cell int, part int, id long, vec array<long>, score long, worst long")


def searched(trees: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each shard it is sent to, none below what it brings along."""
    rows = trees.select("dim", "cell", "part", F.lit(0).alias("kind"), "tree", F.lit(0).cast("long").alias("id"), F.array().cast("array<long>").alias("vec"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("worst"))
    rows = rows.unionByName(sent.select("dim", "cell", "part", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "id", "vec", "score", "worst"))
    rows = rows.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                if batch.column(3)[i].as_py() == 0:
                    held, tree = batch.column(4)[i], None
                    continue
                if held is not None:  # a tree is read when its first query comes
                    tree, held = KDTree.of(held.as_py()), None
                    wide = (tree.low, tree.high)
                query = batch.column(6)[i].values.to_numpy(zero_copy_only=False)
                kind = exact_kind(query, *wide)
                tree = tree if tree.vectors.dtype == kind else tree.as_numbers(kind)
                id_, score, worst = (batch.column(c)[i].as_py() for c in (5, 7, 8))
                found += [(id_, -n, s) for s, n in tree.search(id_, query.astype(kind), k, (score, worst))]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with its rank, the k best of each query; a limit before the shuffle keeps k rows a task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = 2048, max_shards: int = 8192, sample_rows: int = 65_536, fan: int = 8, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner product with each row of queries.

    Components x count as floor(scale * x); ties go to the smaller id; rows that
    carry the query's own id are left out. Rows whose id or vector is null, or
    whose vector holds a null or non-finite component, take no part; vectors
    only meet those of their own length. Of several query rows with one id the
    one with the smallest vector asks; repeated rows of vectors are candidates
    each. Fewer than k candidates: all. Other columns are not read; an empty table returns none.

    Where space is cut is learned from about sample_rows rows (2 * sample_rows at
    most); every row is indexed. Shards hold shard_rows rows, or more where the
    table has more than max_shards times as many.
    """
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    bad = F.exists(F.col(f"`{vector_col}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    clean = lambda df: df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull()).where(~bad).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("vec")).withColumn("dim", F.size("vec"))
    trees = cut_lineage(planted(placed(clean(vectors), shard_rows, max_shards, sample_rows, seed)))
    boxes: dict[int, list] = {}
    for r in trees.drop("tree").orderBy("dim", "cell", "part").collect():  # a few numbers a shard
        boxes.setdefault(r.dim, []).append(r)
    held = {dim: Boxes(rows) for dim, rows in boxes.items()}
    most = max(map(len, boxes.values()), default=0)
    asked = cut_lineage(clean(queries).groupBy("id", "dim").agg(F.min("vec").alias("vec"))).select("*", F.lit(NONE).alias("score"), F.lit(NONE).alias("worst"))
    best = cut_lineage(ranked(searched(trees, routed(asked, held, k, 0, fan), k), k))
    for turn in (1, 2):
        if most <= (1, 1 + fan)[turn - 1]:
            break
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score", (-F.col("vec_id")).alias("worst"))
        bound = asked.drop("score", "worst").join(kth, "id", "left").fillna(NONE, ["score", "worst"])
        found = searched(trees, routed(bound, held, k, turn, fan), k)
        best = cut_lineage(ranked(best.drop("rank").unionByName(found), k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
