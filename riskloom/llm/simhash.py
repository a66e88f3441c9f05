"""SimHash near-duplicate groups through a hierarchical index in Gray order.

Plan. Texts become 64-bit fingerprints where they are read (one map, no
shuffle). Copies collapse first: the index sees each distinct fingerprint once.
Fingerprints that differ in at most ``max_bits`` bits agree on at least one of
``max_bits + 1`` bit blocks (or on two of ``max_bits + 2``, and so on). The upper
nodes of the index are masked bit patterns inside such blocks, of just as many
bits as leave a few thousand members in each; a shuffle deals the nodes out.
Below, members lie in Gray order, runs of neighbours form nodes that again factor
out the bits all members share, and the self-join walks pairs of nodes: a pair is
dropped once the differences accumulated on shared bits exceed ``max_bits``, and
taken whole once the bits left open cannot exceed it. Upper nodes that hold far
more members than planned are cut into runs of Gray order, and pairs of runs are
dropped by the same rule before their members are sent. A node yields a spanning
forest of its links, never all pairs; star contraction joins the forests into
components.

Links by shingle sets go the same way with longer fingerprints, of 256 bits and
more, over the distinct shingles: sets of a similarity s have fingerprints that
differ in a share arccos(2s / (1 + s)) / pi of the bits. max_bits lies above that
share by as much as chance needs, and the masked patterns are spread over all
bits, as many as make pairs at the similarity agree on one (no blocks would be free of that
many differences). The texts of the components that the index gives are then compared by their exact
shingle sets. (MinHash bands and leaders, ``loose_links``, are another index for
such pairs; no query uses it.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, id_and_text, map_texts, place_among

LEAF, FANOUT, CHUNK = 2, 8, 1 << 14
#: The same for fingerprints of several words, whose members are compared in blocks, and members of an upper node on average.
WIDE_LEAF, WIDE_ROWS = 16, 512
#: Fingerprints an upper node holds on average, rows beyond which it is cut into parts, and rows of a part.
NODE_ROWS, HEAVY_ROWS, PART_ROWS = 2048, 1 << 16, 1 << 14
#: Hash functions of a sketch, and their odd factors and addends.
SKETCH = 128
SALTS = np.random.default_rng(20240229).integers(0, 1 << 63, (SKETCH, 2), np.uint64) | np.array([1, 0], np.uint64)


def fingerprint(text: str, shingle_words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of word shingles, repeats included; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, hashes = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    width = min(shingle_words, len(words))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.fromiter((hashes(joined[a : b - 1], seed) for a, b in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; empty for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashes = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words)))
    width = min(shingle_words, len(words))
    found = {hashes(joined[a : b - 1]) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def sketch_of(shingles: np.ndarray, size: int = SKETCH) -> bytes:
    """MinHash of a set of shingle hashes, a byte for each of ``size`` hash functions; equal bytes estimate the Jaccard similarity."""
    if not len(shingles):
        return b""
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    odd, add = SALTS[:size, 0], SALTS[:size, 1]
    for at in range(0, len(shingles), 1 << 10):
        low = np.minimum(low, ((shingles[at : at + (1 << 10), None] * odd + add) >> np.uint64(11)).min(axis=0))
    return (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketch(text: str, shingle_words: int, size: int = SKETCH) -> bytes:
    """Sketch of a text's set of word shingles. Empty for a text without words."""
    return sketch_of(shingle_set(text, shingle_words), size)


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingle hashes in ``words`` 64-bit words; zero for an empty set."""
    steps, ones = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 255):  # counts of 255 fit a byte
        h = shingles[at : at + 255, None] + steps
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; null and empty texts have fingerprint zero."""
    return map_texts(id_and_text(docs, id_col, text_col), lambda t: (fingerprint(t, shingle_words),), "fp long", [pa.int64()])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Order of codes (words, members) in the reflected Gray sequence, first word highest."""
    ranks, odd = [], np.uint64(0)
    for word in codes:
        ranks.append(gray_rank(word) ^ odd)
        odd = np.uint64(0) - (ranks[-1] & np.uint64(1))
    return np.lexsort(ranks[::-1])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowers labels until both ends of every link carry the same one."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


class GrayIndex:
    """Levels of nodes over distinct codes in Gray order; each node holds its first and last member, the mask of bits that all members share, and their pattern.

    pruned and compared count the pairs of nodes that accumulated differences
    drop, and the pairs of codes that are compared in the end. Codes of several
    words come as (words, members).
    """

    def __init__(self, codes: np.ndarray):
        codes = np.atleast_2d(codes)
        self.leaf = LEAF if len(codes) == 1 else WIDE_LEAF
        self.order = gray_order(codes)
        self.codes, self.pruned, self.compared = codes[:, self.order], 0, 0
        n = codes.shape[1]
        edges = np.arange(0, n, self.leaf)
        low, high = np.bitwise_and.reduceat(self.codes, edges, axis=1), np.bitwise_or.reduceat(self.codes, edges, axis=1)
        self.levels = []
        while True:
            self.levels.append((~(low ^ high), low, edges, np.append(edges[1:], n)))
            if len(edges) == 1:
                break
            up = np.arange(0, len(edges), FANOUT)
            low, high, edges = np.bitwise_and.reduceat(low, up, axis=1), np.bitwise_or.reduceat(high, up, axis=1), edges[up]

    def forest(self, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (member, a member of its component) that span the components, as places in the codes given."""
        n = self.codes.shape[1]
        label, stack = np.arange(n), [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            chunk = CHUNK if level else CHUNK * LEAF**2 // self.leaf**2
            if len(i) > chunk:
                stack += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
                continue
            mask, pattern, first, last = self.levels[level]
            shared = mask[:, i] & mask[:, j]
            least = np.bitwise_count((pattern[:, i] ^ pattern[:, j]) & shared).sum(axis=0, dtype=np.int64)
            near = least <= max_bits
            self.pruned += len(i) - int(near.sum())
            # Two nodes that one component holds already have nothing to add.
            low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            near &= ~((low[i] == high[i]) & (low[i] == low[j]) & (low[j] == high[j]))
            i, j, least, shared = i[near], j[near], least[near], shared[:, near]
            whole = least + np.bitwise_count(~shared).sum(axis=0, dtype=np.int64) <= max_bits
            for a, b in zip(i[whole], j[whole], strict=True):  # every member links with every other
                members = np.concatenate([np.arange(first[a], last[a]), np.arange(first[b], last[b])])
                label = merge(label, members, np.full(len(members), members[0]))
            i, j = i[~whole], j[~whole]
            if level:
                count = len(self.levels[level - 1][2])
                steps = np.arange(FANOUT)
                a = (i[:, None, None] * FANOUT + steps[None, :, None]).repeat(FANOUT, axis=2).ravel()
                b = (j[:, None, None] * FANOUT + steps[None, None, :]).repeat(FANOUT, axis=1).ravel()
                ok = (a < count) & (b < count) & (a <= b)
                if ok.any():
                    stack.append((level - 1, a[ok], b[ok]))
            elif len(i):
                steps = np.arange(self.leaf)
                x, y = (np.minimum(first[k][:, None] + steps, n - 1) for k in (i, j))
                differ = np.bitwise_count(self.codes[0][x][:, :, None] ^ self.codes[0][y][:, None, :])
                for k, word in enumerate(self.codes[1:]):
                    differ = np.add(differ, np.bitwise_count(word[x][:, :, None] ^ word[y][:, None, :]), dtype=np.uint8 if k < 2 else np.uint16)
                near = differ <= max_bits
                self.compared += near.size
                if near.any():
                    near &= label[x][:, :, None] != label[y][:, None, :]
                    p, q, r = np.nonzero(near)
                    label = merge(label, x[p, q], y[p, r])
        roots = np.flatnonzero(label != np.arange(n))
        return self.order[roots], self.order[label[roots]]


def block_masks(max_bits: int, blocks: int, bits: int = 64) -> list[int]:
    """Masks of which one at least is free of differences when at most max_bits bits differ; each keeps ``bits`` of its bits, evenly spread."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - max_bits):
        own = [b for k in chosen for b in range(cuts[k], cuts[k + 1])]
        kept = own if bits >= len(own) else [own[len(own) * k // bits] for k in range(bits)]
        out.append(sum(1 << b for b in kept))
    return out


def upper_masks(distinct: int, max_bits: int, blocks: int | None = None, node_rows: int = NODE_ROWS) -> list[int]:
    """Masked patterns that make the upper nodes: just as many bits as leave about node_rows of evenly spread fingerprints in a node, so one node where there are no more."""
    bits = max(0, int(np.ceil(np.log2(max(1, distinct) / node_rows))))
    if not bits and blocks is None:
        return [0]
    if blocks is None:
        blocks = max_bits + 1
        while 64 * (blocks - max_bits) // blocks < bits and blocks < 16:
            blocks += 1
    return block_masks(max_bits, blocks, bits)


def set_disagreement(similarity: float) -> float:
    """Probability, at most, that a bit of SimHash differs between two sets of this Jaccard similarity.

    arccos(cosine) / pi for large sets of one size, whose cosine is the least;
    sets of up to 12 common members are counted out, as their ties make it larger.
    """
    most = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    odds = lambda n: np.array([comb(n, k) for k in range(n + 1)]) / 2**n
    for both in range(1, 13):
        for own in range(1, int(both / similarity - both + 1e-9) + 1):
            for a in range(own // 2 + 1):
                ones = np.arange(both + 1)[:, None, None], np.arange(a + 1)[:, None], np.arange(own - a + 1)
                p = odds(both)[:, None, None] * odds(a)[:, None] * odds(own - a)
                most = max(most, float(p[(2 * (ones[0] + ones[1]) > both + a) != (2 * (ones[0] + ones[2]) > both + own - a)].sum()))
    return most


def set_radius(similarity: float, missed: float = 0.0005) -> tuple[int, int]:
    """(words, bits): as few 64-bit words, 4 at least, as keep chance neighbours out, and the differing bits that a pair of this similarity exceeds with probability missed at most."""
    p = set_disagreement(similarity)
    for words in range(4, 17):
        n, below, bits = 64 * words, (1 - p) ** (64 * words), 0
        while below < 1 - missed:
            bits += 1
            below += comb(n, bits) * p**bits * (1 - p) ** (n - bits)
        if bits <= n / 2 - 6 * np.sqrt(n) / 2:
            break
    return words, bits


def spread_masks(distinct: int, similarity: float, words: int, node_rows: int = WIDE_ROWS, missed: float = 0.0005) -> list[int]:
    """Masked patterns over all bits of long fingerprints, as many as a pair of this similarity disagrees on with probability missed at most; of just as many bits as leave about node_rows members in a node."""
    bits = max(0, int(np.ceil(np.log2(max(1, distinct) / node_rows))))
    agreed = (1 - set_disagreement(similarity)) ** bits
    if agreed >= 1:
        return [0]
    rng, out, n = np.random.default_rng(20240229), [], 64 * words
    while len(out) < int(np.ceil(np.log(missed) / np.log1p(-agreed))):
        order = rng.permutation(n)  # masks of one permutation have no bit in common
        out += [sum(1 << int(b) for b in order[k : k + bits]) for k in range(0, n - bits + 1, bits)]
    return out[: int(np.ceil(np.log(missed) / np.log1p(-agreed)))]


def gray_rank_column(code: Column) -> Column:
    """gray_rank() as a column, below zero for the upper half of the sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def code_words(nodes: DataFrame) -> list[str]:
    """The columns that hold a fingerprint's words, highest first: all but the node's."""
    return [c for c in nodes.columns if c not in ("block", "bits", "node")]


def parted(dealt: DataFrame, heavy: DataFrame, max_bits: int, part_rows: int) -> DataFrame:
    """(key, words, node) of the members of heavy upper nodes, under every pair of parts that can hold a link.

    A heavy node is cut into parts of about part_rows members by quantiles of the
    Gray rank, of the first word where there are several; a part whose first words
    are too much alike for that is cut by a hash. A part keeps the mask of bits all
    its members share, and their pattern; pairs of parts whose patterns differ in
    more than max_bits shared bits are dropped before any member is sent.
    """
    words, out = code_words(dealt), None
    rank = gray_rank_column(F.col(words[0]))
    sized = heavy.withColumn("parts", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("rows") / part_rows))).cast("int"))
    for (parts,) in sized.select("parts").distinct().collect():  # powers of two, so a few dozen at most
        own = dealt.join(F.broadcast(sized.where(F.col("parts") == parts).select("block", "bits")), ["block", "bits"])
        cuts = own.groupBy("block", "bits").agg(F.percentile_approx(rank, [k / parts for k in range(1, parts)] or [1.0], max(10_000, 20 * parts)).alias("cuts"))
        placed = cut_lineage(own.join(F.broadcast(cuts), ["block", "bits"]).select("block", "bits", place_among("cuts", rank, parts).cast("long").alias("part"), *words, "node"))
        if len(words) > 1:
            tall = placed.groupBy("block", "bits", "part").agg(F.ceil(F.count("*") / part_rows).alias("pieces")).where("pieces > 2")
            piece = F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")), F.lit(0)) * parts + F.col("part")
            placed = cut_lineage(placed.join(F.broadcast(tall), ["block", "bits", "part"], "left").select("block", "bits", piece.alias("part"), *words, "node"))
        nodes = placed.groupBy("block", "bits", "part").agg(*[f(w).alias(f"{name}_{w}") for w in words for name, f in (("all", F.bit_and), ("any", F.bit_or))])
        sides = {p: [x for w in words for x in (F.bitwise_not(F.col(f"all_{w}").bitwiseXOR(F.col(f"any_{w}"))).alias(f"{p}_mask_{w}"), F.col(f"all_{w}").alias(f"{p}_bits_{w}"))] for p in ("low", "high")}
        one, other = (nodes.select("block", "bits", F.col("part").alias(p), *sides[p]) for p in ("low", "high"))
        differ = sum((F.bit_count(F.col(f"low_bits_{w}").bitwiseXOR(F.col(f"high_bits_{w}")).bitwiseAND(F.col(f"low_mask_{w}")).bitwiseAND(F.col(f"high_mask_{w}"))) for w in words), F.lit(0))
        pairs = one.join(other, ["block", "bits"]).where((F.col("low") <= F.col("high")) & (differ <= max_bits)).select("block", "bits", "low", "high")
        meets = pairs.withColumn("part", F.explode(F.array_distinct(F.array("low", "high"))))
        sent = placed.join(meets, ["block", "bits", "part"]).select(F.xxhash64("block", "bits", "low", "high").alias("key"), *words, "node")
        out = sent if out is None else out.unionAll(sent)
    return out


def masked(mask: int, words: list[str]) -> Column:
    """The bits that a mask keeps of a fingerprint; a hash of them where there are several words."""
    kept = [(w, m - (1 << 64) if m >> 63 else m) for k, w in enumerate(words) if (m := mask >> 64 * k & ((1 << 64) - 1)) or len(words) == 1]
    cut = [F.col(w).bitwiseAND(F.lit(m)) for w, m in kept]
    return cut[0] if len(words) == 1 else F.xxhash64(*cut) if cut else F.lit(0).cast("long")


def links(nodes: DataFrame, max_bits: int, masks: list[int], heavy_rows: int = HEAVY_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Spanning links (u, v) between nodes (node, fp) of distinct fingerprints; all columns but node are words of the fingerprint."""
    words = code_words(nodes)
    upper = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), masked(m, words).alias("bits")) for k, m in enumerate(masks)]))
    dealt = nodes.select(*words, "node", upper.alias("upper")).select("upper.block", "upper.bits", *words, "node")
    heavy = cut_lineage(dealt.groupBy("block", "bits").agg(F.count("*").alias("rows")).where(F.col("rows") > heavy_rows))
    light = dealt
    if heavy.take(1):  # at most len(masks) * rows / heavy_rows of them
        light = dealt.join(F.broadcast(heavy), ["block", "bits"], "left_anti")
    keyed = light.select(F.xxhash64("block", "bits").alias("key"), *words, "node")
    if heavy.take(1):
        keyed = keyed.unionAll(parted(dealt, heavy, max_bits, part_rows))
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, *fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            fp = np.stack(fp).view(np.uint64)
            held.clear()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in zip(np.append(0, new), np.append(new, len(key)), strict=True):
                if b - a > 1:
                    found.append(tuple(node[a:b][x] for x in GrayIndex(fp[:, a:b]).forest(max_bits)))
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [column.to_numpy() for column in batch.columns]
            # Rows after the last change of key stay for the next batch.
            change = np.flatnonzero(rows[0] != rows[0][-1])
            cut = change[-1] + 1 if len(change) else 0
            if cut or (held and held[-1][0][-1] != rows[0][0]):
                held.append(tuple(x[:cut] for x in rows))
                yield flush()
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield flush()

    return keyed.mapInArrow(run, "u long, v long")


def beside_least(edges: DataFrame, hub: int) -> DataFrame:
    """(u, v, m) of edges (u, v): m is the smallest v of a row's u. Nodes with more than hub edges get theirs by a broadcast, so that no node's edges meet in one task."""
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
    if not least.where(F.col("degree") > hub).take(1):
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("degree") > hub).select("u", "m"))
    light = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("degree") <= hub).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionAll(light.select("u", "v", "m"))


def components(edges: DataFrame, hub_rows: int = 1024, most_hubs: int = 100_000) -> DataFrame:
    """(node, root) for every node of an edge: large-star and small-star rounds until nothing changes.

    Each round aggregates with map-side minima before it joins. A node is a hub
    from hub_rows edges on, or from a most_hubs-th of all edges if that is more,
    so there are never more than 2 * most_hubs of them to broadcast.
    """
    e = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, hub = tuple(now), max(hub_rows, now[0] // most_hubs)
        both = beside_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), hub)
        large = cut_lineage(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = beside_least(large, hub)
        kept = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(kept.union(small.select("u", F.col("m").alias("v"))).distinct())


def sketch_bands(similarity: float, missed: float = 0.002, size: int = SKETCH) -> tuple[int, int]:
    """(bytes a band, bands) within ``size`` bytes so that a pair of this similarity agrees on no band with probability missed at most."""
    for width in range(5, 0, -1):
        bands = 1 if similarity >= 1 else int(np.ceil(np.log(missed) / np.log1p(-(similarity**width))))
        if width * bands <= size:
            return width, bands
    return 1, size


class Bucket:
    """Sketches that share a band, as they stream by; only leaders stay.

    A sketch that agrees with a leader on all but ``slack`` bytes is absorbed, any
    other one becomes a leader. Differing bytes are a metric, so two sketches with
    ``near`` equal bytes are both linked to one leader by ``near - slack``.
    """

    def __init__(self, near: int, slack: int = 12):
        self.near, self.slack = near, slack
        self.sketches, self.nodes, self.label = np.zeros((0, SKETCH), np.uint8), [], np.zeros(0, np.int64)

    def add(self, nodes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        """Links of these members, one each and one more for each two components they join."""
        out, free, tag, old = [], np.ones(len(nodes), bool), np.full(len(nodes), -1), len(self.nodes)
        self.label = np.append(self.label, np.arange(old, old + len(nodes)))

        def attach(rows: np.ndarray, leader: int) -> None:
            mine, node = self.label[leader], self.nodes[leader]
            new = rows[tag[rows] < 0]
            out.extend((int(x), node) for x in nodes[new])
            tag[new] = mine
            for other, k in zip(*np.unique(tag[rows], return_index=True), strict=True):
                if other != mine:
                    out.append((int(nodes[rows[k]]), node))
                    self.label[self.label == other] = mine
                    tag[tag == other] = mine

        for at in range(0, old, 1 << 10):
            leaders = self.sketches[at : at + (1 << 10)]
            step = max(1, (1 << 18) // len(leaders))
            for a in range(0, len(nodes), step):
                equal = (sketches[a : a + step, None] == leaders).sum(axis=2)
                for k in np.flatnonzero((equal >= self.near - self.slack).any(axis=0)).tolist():
                    attach(a + np.flatnonzero(equal[:, k] >= self.near - self.slack), at + k)
                free[a : a + step] &= (equal < SKETCH - self.slack).all(axis=1)
        rest, led = np.flatnonzero(free), []
        while len(rest):
            first, rest = rest[0], rest[1:]
            self.nodes.append(int(nodes[first]))
            led.append(first)
            mine = len(self.nodes) - 1
            if tag[first] >= 0:
                self.label[mine] = tag[first]
            equal = (sketches[rest] == sketches[first]).sum(axis=1)
            attach(rest[equal >= self.near - self.slack], mine)
            rest = rest[equal < SKETCH - self.slack]
        self.label = self.label[: len(self.nodes)]
        self.sketches = np.concatenate([self.sketches, sketches[led]])
        return out


def band_members(nodes: DataFrame, similarity: float, heavy_rows: int = HEAVY_ROWS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(key, node, sketch) of nodes (node, sketch) under the patterns they are compared in.

    A pattern is a band of the sketch. Members of a pattern with more than heavy_rows
    of them go under second patterns instead, bands of the bytes that follow the
    first one around the sketch: a pair at the similarity misses all of those with
    probability 0.0005, and only counts as missed if it shares no other band.
    """
    width, bands = sketch_bands(similarity)
    upper = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.expr(f"substring(sketch, {1 + k * width}, {width})").alias("bits")) for k in range(bands)]))
    dealt = nodes.select("node", "sketch", upper.alias("upper")).select(F.xxhash64("upper.band", "upper.bits").alias("key"), F.col("upper.band").alias("band"), "node", "sketch")
    heavy = cut_lineage(dealt.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > heavy_rows).select("key"))
    many = heavy.count()
    if not many:
        return dealt.select("key", "node", "sketch")
    held = F.broadcast(heavy) if many <= broadcast_rows else heavy  # 8 bytes each
    inner, parts = sketch_bands(similarity, 0.0005, SKETCH - width)
    turned = F.concat("sketch", "sketch")  # bytes after the last are the first
    second = F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.substring(turned, (F.col("band") + 1) * width + (1 + j * inner), F.lit(inner)).alias("bits")) for j in range(parts)]))
    cut = dealt.join(held, "key", "left_semi").select("key", "node", "sketch", second.alias("second"))
    cut = cut.select(F.xxhash64("key", "second.part", "second.bits").alias("key"), "node", "sketch")
    return dealt.join(held, "key", "left_anti").select("key", "node", "sketch").unionAll(cut)


def loose_links(nodes: DataFrame, similarity: float, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Links (u, v) between nodes (node, sketch) whose components hold together all pairs of the similarity that share a pattern."""
    near = int(SKETCH * similarity - 4 * np.sqrt(SKETCH * similarity * (1 - similarity)))
    dealt = band_members(nodes, similarity, heavy_rows).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, bucket, held = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = batch.column(2)
            at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
            sketches = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, SKETCH)
            found = []
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(edges[1:], len(key))
            busy = ends - edges > 1
            busy[0] = busy[-1] = True  # may go on in other batches
            for a, b in zip(edges[busy].tolist(), ends[busy].tolist(), strict=True):
                if key[a] != open_:
                    open_, bucket = key[a], Bucket(near)
                found += bucket.add(node[a:b], sketches[a:b])
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of sets with this Jaccard similarity, exactly."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    out, mark = [], np.zeros(len(values), bool)
    left, stack = np.arange(len(sets)), []
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        k = stack.pop()
        close = left[(np.minimum(sizes[left], sizes[k]) >= similarity * np.maximum(sizes[left], sizes[k])) & (sizes[left] > 0)]
        if sizes[k] and len(close):
            mark[dense[starts[k] : starts[k + 1]]] = True
            marked = np.concatenate([[0], np.cumsum(mark[dense])])
            both = marked[starts[close + 1]] - marked[starts[close]]
            mark[dense[starts[k] : starts[k + 1]]] = False
            hit = close[both >= similarity * (sizes[close] + sizes[k] - both) - 1e-9]
            out += [(k, x) for x in hit.tolist()]
            stack += hit.tolist()
            left = left[~np.isin(left, hit)]
    return out


def exact_links(texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Links (u, v) between nodes of texts (key, node, text) that have one key and whose shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, nodes, sets = None, [], []
        for batch in batches:
            found = []
            for key, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != open_:
                    if len(nodes) > 1:
                        found += [(nodes[a], nodes[b]) for a, b in set_forest(sets, similarity)]
                    open_, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(shingle_set(text.as_py() or "", shingle_words))
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if len(nodes) > 1:
            found = [(nodes[a], nodes[b]) for a, b in set_forest(sets, similarity)]
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return texts.repartition("key").sortWithinPartitions("key").select("key", "node", "text").mapInArrow(run, "u long, v long")


def name_groups(rows: DataFrame, nodes: DataFrame, edges: DataFrame, broadcast_rows: int = 500_000, salts: int = 64) -> DataFrame:
    """rows with component_id, the smallest id (low) among the nodes that edges reach from a row's node.

    The lowest ids of components with links go back to their members by a
    broadcast while there are at most broadcast_rows (16 bytes each), and beyond
    by a join dealt by root and salt, so that a large component spreads.
    """
    stars = components(edges).withColumnRenamed("node", "member")
    rooted = cut_lineage(nodes.join(stars, nodes.node == stars.member, "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    lowest = cut_lineage(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size")).where("size > 1").select("root", "component_id"))
    if lowest.count() <= broadcast_rows:
        joined = rooted.join(F.broadcast(lowest), "root", "left")
    else:
        salted = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rooted.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(salted, ["root", "salt"], "left")
    named = cut_lineage(joined.select("node", F.coalesce("component_id", "low").alias("component_id")))
    return rows.join(named, "node")


def similar_groups(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, with_fingerprint: bool, block_rows: int = 1024, block_bytes: int = 1 << 23, node_rows: int = WIDE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp is zero unless asked for.

    Equal shingle sets are one node. The index over their long fingerprints
    gives components that are too wide; one text of each node in those is read again, by id and digest, and they meet, in pairs of blocks
    where there are many, and link by their exact shingle sets. So docs must be the same
    when it is read twice.
    """

    words, max_bits = set_radius(similarity)
    names = [f"word{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, codes = [], [], np.zeros((words, batch.num_rows), np.uint64)
            for k, x in enumerate(batch.column(3)):
                text = x.as_py() or ""
                shingles = shingle_set(text, shingle_words)
                fp.append(fingerprint(text, shingle_words) if with_fingerprint else 0)
                node.append(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))
                codes[:, k] = wide_fingerprint(shingles, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.int64()), pa.array(node, pa.int64()), *map(pa.array, codes.view(np.int64))], names=["doc_id", "digest", "bytes", "fp", "node", *names])

    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    rows = cut_lineage(texts.select("doc_id", "digest", F.octet_length("text").alias("bytes"), "text").mapInArrow(run, "doc_id long, digest long, bytes int, fp long, node long, " + ", ".join(f"{w} long" for w in names)))
    named = F.min_by("digest", F.struct(F.col("doc_id").isNull(), "doc_id"))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("low"), named.alias("digest"), F.max("bytes").alias("bytes"), *[F.min(w).alias(w) for w in names]))
    wide = cut_lineage(components(links(nodes.select("node", *names), max_bits, spread_masks(nodes.count(), similarity, words, node_rows))))
    wide = cut_lineage(wide.union(wide.select("root", "root")).distinct().join(nodes.select("node", "low", "digest", "bytes"), "node"))
    sizes = wide.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("bytes") / block_bytes)).alias("blocks"))
    met = wide.join(sizes, "root").withColumn("block", F.expr("pmod(xxhash64(node, 7), blocks)")).select("node", "low", F.col("digest").alias("met"), "root", "blocks", "block")
    found = texts.join(met, (F.col("digest") == F.col("met")) & F.col("doc_id").eqNullSafe(F.col("low"))).dropDuplicates(["node"])
    pairs = found.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pairs = pairs.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "text")
    edges = exact_links(pairs, shingle_words, similarity)
    return name_groups(rows.select("doc_id", "fp", "node"), nodes.select("node", "low"), edges).select("doc_id", "fp", "component_id")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4, blocks: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that
    links of at most max_bits differing bits reach; with a similarity, links
    whose shingle sets have that Jaccard similarity instead, however far apart
    the fingerprints are (texts without words have only each other). Null and empty texts
    have fingerprint zero and link like others; rows with a null id keep it, take
    part in links, and never name a component unless all its ids are null (then
    null). Repeated rows each return a row. Other columns are not read; an empty
    table returns none. blocks None: chosen from the number of distinct fingerprints.
    """
    if similarity is None:
        fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle_words).withColumn("node", F.col("fp")))
        nodes = cut_lineage(fps.groupBy("node", "fp").agg(F.min("doc_id").alias("low")))
        groups = name_groups(fps, nodes.select("node", "low"), links(nodes.select("node", "fp"), max_bits, upper_masks(nodes.count(), max_bits, blocks)))
    else:
        groups = similar_groups(docs, id_col, text_col, shingle_words, similarity, with_fingerprint=True)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 4, similarity: float | None = None, broadcast_ids: int = 4_000_000) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest id; all columns stay.

    The ids that go are broadcast while there are at most broadcast_ids of them
    (8 bytes each) and joined by a shuffle beyond. Repeated ids keep one row, that
    with the smallest hash of its columns, so the same one in every run.
    Rows with a null id stay as they are; an empty table returns none.
    """
    ident = F.col(f"`{id_col}`")
    groups = near_duplicate_groups(docs, id_col, text_col, shingle_words, max_bits) if similarity is None else similar_groups(docs, id_col, text_col, shingle_words, similarity, with_fingerprint=False)
    groups = cut_lineage(groups.select("doc_id", "component_id"))
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("times"))
    ids = cut_lineage(ids.where("low <> doc_id or times > 1"))
    gone = ids.where("low <> doc_id").select(F.col("doc_id").alias(key := fresh(docs, "gone_id")[0]))
    size, repeated = ids.agg(F.count("*"), F.max("times")).first()
    kept = docs.join(F.broadcast(gone) if size <= broadcast_ids else gone, docs[f"`{id_col}`"].cast("long") == gone[key], "left_anti")
    if (repeated or 1) > 1:
        rank = fresh(docs, "row_rank")[0]
        first = Window.partitionBy(ident).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text_col}`"))
        kept = kept.withColumn(rank, F.when(ident.isNull(), 1).otherwise(F.row_number().over(first))).where(F.col(rank) == 1).drop(rank)
    return kept
