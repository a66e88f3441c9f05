"""Near duplicates and exact search against brute force, and the pipeline's stages."""

import hashlib
import math
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.simhash import SKETCH, Bucket, GrayIndex, band_members, block_masks, components, drop_near_duplicates, fingerprint, gray_rank, gray_rank_column, links, loose_links, merge, name_groups, near_duplicate_groups, set_forest, similar_groups, sketch, upper_masks
from riskloom.llm.tokens import Encoder
from riskloom.llm.topk import NONE, Boxes, KDTree, cells_of, cut_space, placed, planted, ranked, routed, searched, top_k
from test_text_operators import BYTE, brute_kept, check_pieces


def brute_fingerprint(text):
    words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, bits):
    label = np.arange(len(codes))
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits)
    return merge(label, a, b)


def test_fingerprint():
    for text in ("", " \n", "one", "a b c", "A b C d E f", "é x y z w", "w " * 300):
        assert fingerprint(text) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("n,spread", [(3, 64), (50, 8), (700, 12), (900, 64)])
def test_gray_index(n, spread):
    rng = np.random.default_rng(n)
    bits = rng.random((n, 64)) < (spread / 128)
    codes = np.unique(np.packbits(bits, axis=1).view(np.uint64).ravel() ^ np.uint64(0x123456789ABCDEF))
    u, v = GrayIndex(codes).forest(4)
    label = merge(np.arange(len(codes)), u, v)
    assert (label == brute_components(codes, 4)).all()


def test_gray_rank_and_blocks():
    seen = [int(gray_rank(np.array([k ^ (k >> 1)], np.uint64))[0]) for k in range(100)]
    assert seen == list(range(100))
    rng = random.Random(3)
    for blocks in (5, 6, 7):
        masks = block_masks(4, blocks)
        for _ in range(200):
            diff = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)
    for bits in (1, 3, 12):
        masks = block_masks(4, 5, bits)
        assert [m.bit_count() for m in masks] == [bits] * 5
    assert upper_masks(1000, 4) == [0] and len(upper_masks(10**5, 4)) == 5 < len(upper_masks(10**9, 4))


def test_gray_rank_column(spark):
    codes = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 500)
    got = spark.createDataFrame([(int(c),) for c in codes], "fp long").select("fp", gray_rank_column(F.col("fp")).alias("r")).collect()
    assert [r.r for r in got] == gray_rank(np.array([r.fp for r in got]).view(np.uint64)).view(np.int64).tolist()


def test_index_prunes(spark):
    """On a whole table most pairs of fingerprints are never compared: differences accumulated in upper nodes drop them."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    codes = np.unique(np.array([fingerprint(t) for t in texts], np.int64).view(np.uint64))
    index = GrayIndex(codes)
    u, v = index.forest(4)
    assert (merge(np.arange(len(codes)), u, v) == brute_components(codes, 4)).all()
    assert index.pruned > 10_000 and index.compared < 0.05 * len(codes) ** 2 / 2


def test_heavy_nodes_are_cut(spark):
    """Upper nodes beyond the bound are cut into parts in Gray order; the links span the same components, and no task sees a whole node."""
    rng = np.random.default_rng(8)
    ball = np.uint64(0x0F0F0F0F12345678) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2000, 5), np.uint64), axis=1)
    codes = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 1500, np.uint64), rng.integers(0, 1 << 63, 300, np.uint64) & np.uint64(0xFF)]))
    nodes = spark.createDataFrame([(k, int(c)) for k, c in enumerate(codes.view(np.int64))], "node long, fp long")
    for masks, heavy, part in ((upper_masks(len(codes), 4, node_rows=50), 200, 100), (upper_masks(len(codes), 4, 6), 10**6, 10**6)):
        found = [(r.u, r.v) for r in links(nodes, 4, masks, heavy, part).collect()]
        label = merge(np.arange(len(codes)), *np.array(found, np.int64).reshape(-1, 2).T)
        assert (label == brute_components(codes, 4)).all()
        assert len(found) < 40 * len(codes)
    edges = spark.createDataFrame([(0, k) for k in range(1, 500)] + [(600, 601)], "u long, v long")
    rows = spark.range(700).select(F.col("id").alias("node"), (1000 - F.col("id")).alias("low"))
    plain, salted = (sorted((r.node, r.component_id) for r in name_groups(rows.select("node"), rows, edges, broadcast_rows=b).collect()) for b in (500, 0))
    assert plain == salted and dict(plain)[7] == 501 and dict(plain)[600] == 399 and dict(plain)[650] == 350


def test_similarity_of_sets(spark):
    """With a similarity asked for, close fingerprints link only where the shingle sets agree, and copies always do."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=400)
    near = [base[:k] + ["changed"] + base[k + 1 :] for k in range(0, 400, 40)]
    hot = "boiler plate line that repeats " * 200  # decides every bit of the fingerprint
    rows = [(0, " ".join(base), "x"), *[(1 + k, " ".join(w), "x") for k, w in enumerate(near)], (50, " ".join(base), "x"), (60, hot + "one tail " + " ".join(rng.choices(words, k=60)), "x"), (61, hot + "other tail " + " ".join(rng.choices(words, k=60)), "x"), (70, None, "x"), (71, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    out = {r.doc_id: r for r in near_duplicate_groups(docs, shingle_words=5, max_bits=8, similarity=0.8).collect()}
    codes = {k: int(r.fingerprint, 16) for k, r in out.items()}
    linked = [k for k in range(11) if bin(codes[k] ^ codes[0]).count("1") <= 8]
    assert len(linked) > 3 and all(out[k].component_id == 0 for k in linked) and out[50].component_id == 0
    assert out[61].component_id == 61 and out[60].component_id == 60 and out[71].component_id == 70
    assert bin(codes[60] ^ codes[61]).count("1") <= 8
    a, b = (set(zip(*(x.split()[k:] for k in range(5)))) for x in (rows[0][1], rows[3][1]))
    x, y = (np.frombuffer(sketch(r[1], 5), np.uint8) for r in (rows[0], rows[3]))
    assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.12
    assert sorted(r.doc_id for r in drop_near_duplicates(docs, max_bits=8, similarity=0.8).collect()) == sorted({r.component_id for r in out.values()})
    assert near_duplicate_groups(docs.limit(0), similarity=0.8).count() == 0


def brute_similar(texts, width, similarity):
    """Component labels of texts by exact Jaccard similarity of word shingles, every pair compared."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if (len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) if sets[a] and sets[b] else sets[a] == sets[b])]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return merge(np.arange(len(texts)), a, b), pairs


def test_similar_pairs_beyond_eight_bits(spark, small):
    """Near copies link by their shingle sets, however many bits their fingerprints differ in."""
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for _ in range(60):
        base = rng.choices([f"w{k}" for k in range(3000)], k=200)
        texts += [" ".join(base), " ".join(x if k not in (20, 70, 120, 150) else "changed" for k, x in enumerate(base))]
    label, pairs = brute_similar(texts, 5, 0.8)
    far = [(a, b) for a, b in pairs if bin((fingerprint(texts[a], 5) ^ fingerprint(texts[b], 5)) % (1 << 64)).count("1") > 8]
    assert len(far) >= 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_duplicate_groups(docs, shingle_words=5, similarity=0.8).collect()}
    assert [out[k] for k in range(len(texts))] == label.tolist()
    kept = drop_near_duplicates(docs, similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label.tolist()))
    blocks = similar_groups(docs, "doc_id", "text", 5, 0.8, False, block_rows=1, block_bytes=500).collect()
    assert {r.doc_id: r.component_id for r in blocks} == out


def test_long_fingerprints():
    """Bits of several words: a majority of the hashes each; the index in Gray order gives the components of every pair within the radius."""
    rng = np.random.default_rng(31)
    for n in (0, 1, 2, 255, 256, 700):
        bits = np.zeros(256, int)
        shingles = rng.integers(0, 1 << 63, n, np.uint64)
        for h in shingles.tolist():
            for k in range(4):
                x = (h + (k + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
                x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
                bits[64 * k : 64 * k + 64] += [(x ^ x >> 31) >> b & 1 for b in range(64)]
        got = simhash.wide_fingerprint(shingles, 4)
        assert [int(got[b // 64]) >> b % 64 & 1 for b in range(256)] == (2 * bits > n).astype(int).tolist()
    hearts = rng.integers(0, 1 << 63, (4, 12), np.uint64)
    near = hearts[:, rng.integers(0, 12, 600)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (9, 4, 600), np.uint64), axis=0)
    codes = np.concatenate([near, rng.integers(0, 1 << 63, (4, 300), np.uint64)], axis=1)
    ranks = []
    for code in codes.T:
        ones = accumulate(int(b) for w in code for b in f"{int(w):064b}")
        ranks.append(int("".join(str(n % 2) for n in ones), 2))
    assert [ranks[k] for k in simhash.gray_order(codes)] == sorted(ranks)
    differ = np.bitwise_count(codes[:, :, None] ^ codes[:, None]).sum(axis=0, dtype=int)
    for radius in (40, 69, 90):
        index = GrayIndex(codes)
        u, v = index.forest(radius)
        assert (merge(np.arange(900), u, v) == merge(np.arange(900), *np.nonzero(differ <= radius))).all()
    assert (differ <= 69).sum() > 20_000 and index.compared < 900**2


def test_radius_and_masks_of_sets():
    """Pairs at the similarity lie within the radius and agree on a masked pattern; the smallest sets, whose ties cost bits, as well."""
    rng = np.random.default_rng(5)
    words, radius = simhash.set_radius(0.8)
    masks = np.array([[m >> 64 * k & (1 << 64) - 1 for k in range(words)] for m in simhash.spread_masks(200_000, 0.8, words)], np.uint64)
    assert words == 4 and (np.bitwise_count(masks).sum(axis=1) == 9).all() and len({tuple(m) for m in masks.tolist()}) == len(masks)
    for both, own in ((4, (0, 1)), (5, (0, 1)), (8, (1, 1)), (32, (4, 4)), (200, (0, 50)), (200, (25, 25))):
        far = apart = 0
        for _ in range(400):
            x = rng.integers(0, 1 << 63, both + sum(own), np.uint64)
            d = simhash.wide_fingerprint(x[: both + own[0]], words) ^ simhash.wide_fingerprint(np.append(x[:both], x[both + own[0] :]), words)
            far += int(np.bitwise_count(d).sum()) > radius
            apart += bool((d & masks).any(axis=1).all())
        assert far <= 3 and apart <= 3
    assert simhash.set_radius(1.0)[1] == 0 and simhash.spread_masks(10**6, 1.0, 4) == simhash.spread_masks(100, 0.8, 4) == [0]


def test_similar_sets_go_through_the_index(spark, monkeypatch):
    """Texts at a similarity of just 0.8 meet by SimHash, masked patterns and the Gray-order index, in small nodes and cut ones too, and none is missed."""
    rng = random.Random(3)
    texts = []
    for _ in range(1500):  # 36 shingles each, 32 in common
        base = [f"w{rng.randrange(10**6)}" for _ in range(44)]
        texts += [" ".join(base[:40]), " ".join(base[:36] + base[40:])]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), []
    real = simhash.links

    def recorded(nodes, max_bits, masks, *bounds):
        asked.append((nodes.columns, max_bits, len(masks)))
        return real(nodes, max_bits, masks, *bounds)

    monkeypatch.setattr(simhash, "links", recorded)
    monkeypatch.setattr(simhash, "loose_links", None)
    for node_rows in (simhash.WIDE_ROWS, 8):
        out = {r.doc_id: r.component_id for r in similar_groups(docs, "doc_id", "text", 5, 0.8, False, node_rows=node_rows).collect()}
        assert all(out[k] == k - k % 2 for k in range(3000))
    assert [(c[1:], b) for c, b, _ in asked] == [([f"word{k}" for k in range(4)], 69)] * 2 and 1 < asked[0][2] < asked[1][2]
    alike = np.random.default_rng(2).integers(0, 1 << 63, (4, 700), np.uint64)
    alike[0, :400] = alike[0, 0]  # no cut by the first word parts these
    alike[1:, 1:80] = alike[1:, :1] ^ (np.uint64(1) << np.arange(79, dtype=np.uint64) % np.uint64(64))
    nodes = spark.createDataFrame([(k, *c) for k, c in enumerate(alike.view(np.int64).T.tolist())], "node long, word0 long, word1 long, word2 long, word3 long")
    differ = np.bitwise_count(alike[:, :, None] ^ alike[:, None]).sum(axis=0, dtype=int)
    found = [(r.u, r.v) for r in real(nodes, 69, [0, 0xFF], 100, 50).collect()]
    assert (merge(np.arange(700), *np.array(found, np.int64).reshape(-1, 2).T) == merge(np.arange(700), *np.nonzero(differ <= 69))).all()


def test_bucket_and_sets():
    """Leaders hold together every pair near enough, in whatever batches it comes; set forests are the exact components."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        heart = rng.integers(0, 256, (3, SKETCH), np.uint8)
        rows = heart[rng.integers(0, 3, 60)]
        flip = rng.random(rows.shape) < rng.random((60, 1)) * 0.3
        rows = np.where(flip, rng.integers(0, 256, rows.shape, np.uint8), rows)
        bucket, found = Bucket(84), []
        for a in range(0, 60, 17):
            found += bucket.add(np.arange(a, min(60, a + 17)), rows[a : a + 17])
        assert len(found) < 120  # in proportion to the members, not to their pairs
        label = merge(np.arange(60), *np.array(found, np.int64).reshape(-1, 2).T)
        for a in range(60):
            for b in range(a):
                assert (rows[a] == rows[b]).sum() < 84 or label[a] == label[b]
        sets = [np.unique(rng.choice(14, rng.integers(1, 12))).astype(np.uint64) for _ in range(30)]
        want = [(a, b) for a in range(30) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        x, y = (merge(np.arange(30), *np.array(e, np.int64).reshape(-1, 2).T) for e in (want, set_forest(sets, 0.8)))
        assert (x == y).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 6000 + k) for k in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for hub in (1024, 3):
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), hub_rows=hub).collect()}
        assert all(found[x] == find(x) for x in root if find(x) != x)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_bands_are_cut(spark):
    """Patterns beyond the bound are cut by second patterns: no key keeps a template's rows, and pairs at the similarity stay together."""
    rng = np.random.default_rng(21)
    template = rng.integers(0, 256, SKETCH)
    own = rng.integers(0, 256, (1500, SKETCH))
    base = np.where(rng.random((1500, SKETCH)) < 0.7, template, own)  # bytes that come from a shared template
    near = np.where(rng.random((1500, SKETCH)) < 0.82, base, rng.integers(0, 256, (1500, SKETCH)))
    rows = np.concatenate([base, near]).astype(np.uint8)
    nodes = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(rows)] + [(3000, bytearray(SKETCH)), (3001, bytearray(SKETCH))], "node long, sketch binary")
    most = [band_members(nodes, 0.8, heavy).groupBy("key").count().agg(F.max("count")).first()[0] for heavy in (10**6, 50)]
    assert most[0] > 400 > 3 * most[1]
    for heavy in (10**6, 50):
        found = [(r.u, r.v) for r in loose_links(nodes, 0.8, heavy).collect()]
        label = merge(np.arange(3002), *np.array(found, np.int64).reshape(-1, 2).T)
        apart = [k for k in range(1500) if label[k] != label[k + 1500] and (rows[k] == rows[k + 1500]).sum() >= 103]
        assert len(apart) <= 3 and label[3000] == label[3001]
    assert loose_links(nodes.limit(0), 0.8, 50).count() == 0


def test_texts_read_again_by_id_and_digest(spark):
    """Null ids, ids that stand for several texts and repeated rows: each node's own text is compared."""
    rng = random.Random(4)
    words = [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(900)]
    long, other, third = (" ".join(words[k : k + 300]) for k in (0, 300, 600))
    rows = [(None, long), (None, long + " tail"), (None, other), (None, other + " tail"), (5, third), (5, "quite another text"), (5, third), (9, third + " tail"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in similar_groups(docs, "doc_id", "text", 5, 0.8, False, block_rows=1).collect()), key=repr)
    assert out == sorted([(None, None)] * 4 + [(5, 5)] * 3 + [(9, 5), (2, 2)], key=repr)


def test_near_duplicates(spark, small):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(k, r.text, None) for k, r in enumerate(spark.read.parquet(f"{small}/documents.parquet").limit(60).collect())]
    rows += [(100 + k, base + f" tail{k}", "x") for k in range(30)] + [(200, None, None), (201, "", None), (None, base, None), (7, rows[7][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = near_duplicate_groups(docs).collect()
    assert len(out) == len(rows)
    codes = np.array([int(r.fingerprint, 16) for r in out], np.uint64)
    label = brute_components(codes, 4)
    for k, r in enumerate(out):
        assert int(r.fingerprint, 16) == brute_fingerprint(dict((x[0], x[1] or "") for x in rows)[r.doc_id] or "")
        same = [out[j].doc_id for j in np.flatnonzero(label == label[k]) if out[j].doc_id is not None]
        assert r.component_id == min(same)
    kept = [r.doc_id for r in drop_near_duplicates(docs, shingle_words=4).collect()]
    want = sorted({r.component_id for r in out})
    assert sorted(x for x in kept if x is not None) == want and kept.count(None) == 1
    twice = spark.createDataFrame([(1, f"text {k} " + base, str(k)) for k in range(9)], docs.schema)
    assert len({tuple(drop_near_duplicates(twice.repartition(n), shingle_words=4).collect()) for n in (1, 5)}) == 1
    assert near_duplicate_groups(docs.limit(0)).count() == drop_near_duplicates(docs.limit(0)).count() == 0


def brute_top(ids, v, queries, k):
    out = []
    for q in queries:
        s = v @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("dims,low,high", [(1, -3, 3), (8, -50, 50), (3, 0, 1)])
def test_kd_tree(dims, low, high):
    rng = np.random.default_rng(dims)
    v, ids = rng.integers(low, high + 1, (500, dims)), rng.permutation(500) * 3
    tree = KDTree(ids, v)
    got = sorted((int(ids[q]), n + 1, -i, s) for q in range(0, 500, 25) for n, (s, i) in enumerate(sorted(tree.search(int(ids[q]), v[q], 5), reverse=True)))
    assert got == brute_top(ids, v, range(0, 500, 25), 5)
    again = KDTree.of(tree.kept())
    assert sorted(again.search(3, v[7].astype(np.int64), 5)) == sorted(tree.search(3, v[7], 5))
    nodes = cut_space(v, 16)
    cells = cells_of(nodes, v)
    assert cells.min() == 0 and len(np.unique(cells)) == len(nodes) + 1 and (np.bincount(cells).max() <= 250 or high - low < 3)


def test_most_shards_are_never_asked(spark):
    """With shards that are cells of space, a query's k-th score closes most of them before it is sent."""
    rng = np.random.default_rng(7)
    hearts = rng.normal(size=(40, 16)) * 3
    v = np.floor(256 * (hearts[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.2)).astype(np.int64)
    v[:1200] = v[0]  # one vector on a third of all rows: cut by ranges of ids
    rows = spark.createDataFrame([(16, k, x.tolist()) for k, x in enumerate(v)], "dim int, id long, vec array<long>")
    trees = planted(placed(rows, 100, 8192, 2000, 1)).cache()
    shards = trees.drop("tree").collect()
    assert len(shards) >= 20 and max(r.n for r in shards) <= 500 and sum(r.n for r in shards) == 4000
    assert len({(r.dim, r.cell, r.part) for r in shards}) == len(shards)
    boxes = {16: Boxes(shards)}
    asked = rows.where("id % 50 = 0").withColumns({"score": F.lit(NONE), "worst": F.lit(NONE)})
    first = routed(asked, boxes, 5, 0, 8)
    best = ranked(searched(trees, first, 5), 5)
    kth = {r.query_id: (r.score, -r.vec_id) for r in best.where("rank = 5").collect()}
    bound = spark.createDataFrame([(16, r.id, r.vec, *kth[r.id]) for r in asked.collect()], "dim int, id long, vec array<long>, score long, worst long")
    sent = first.count() + sum(routed(bound, boxes, 5, turn, 8).count() for turn in (1, 2))
    assert sent < 0.25 * 80 * len(shards)
    df = spark.createDataFrame([(k, [float(c) for c in x]) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0"), scale=1, shard_rows=100).collect())
    assert got == brute_top(np.arange(4000), v, range(0, 4000, 50), 5)


def test_top_k(spark, small):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=6)], "c") for k in range(400)] + [(400 + k, [0.5] * 6, "c") for k in range(200)]
    odd = [(1000, None, "c"), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (1100, [float("nan")] * 6, "c"), (None, [1.0] * 6, "c"), (1150, [1.0, 2.0], "c"), (1151, [1.0, 1.0], "c"), (1200, [], "c")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=100).collect())
    ids, v = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    want = brute_top(ids, v, range(0, 600, 50), 5) + [(1150, 1, 1151, 256 * 256 + 256 * 512)]
    assert got == sorted(want)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [3.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(twice, twice.where("vec_id = 0"), scale=1).collect()]
    assert sorted(asked) == [(0, 1, 1, 2), (0, 2, 2, 0)]  # of two queries with one id the smallest vector asks


def brute_lines(docs):
    """docs (id, text, source) without the lines that three or more sources have, but in the first document that has them."""
    bare = lambda x: x.strip(" \t\r\v\f")
    sites, first = {}, {}
    for k, text, source in docs:
        for x in map(bare, text.split("\n")):
            if x:
                sites.setdefault(x, set()).add(source or "")
                first[x] = min(k, first.get(x, k))
    gone = lambda k, x: len(sites.get(bare(x), ())) >= 3 and first[bare(x)] != k
    return {k: "\n".join(x for x in text.split("\n") if not gone(k, x)) for k, text, _ in docs}


def brute_counts(docs):
    """Poisson count of each document (id, source) at the square-root mixture."""
    n = Counter(source for _, source in docs)
    total = sum(round(math.sqrt(x), 9) for x in n.values())
    out = {}
    for k, source in docs:
        rate = round(math.sqrt(n[source]) / total * len(docs) / n[source], 12)
        u, log_p, below, count = int(hashlib.md5(f"17:{k}".encode()).hexdigest()[:13], 16) / 2**52, -rate, math.exp(-rate), 0
        while below <= u:
            count += 1
            log_p += math.log(rate / count)
            below += math.exp(log_p)
        out[k] = count
    return out


def test_pipeline(spark, small, tmp_path):
    """Every stage, run on what the stage before it kept, against brute force; then run() as a whole."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    base = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    for k in range(40):
        words = rng.choices([f"w{n}" for n in range(2000)], k=150)
        changed = [w if n not in (20, 90, 130) else "changed" for n, w in enumerate(words)]
        lines = [f"shared line {k % 4} of many sites", " ".join(words), "short text"]
        base += [(10_000 + 3 * k + m, t, "en", f"s{(k + m) % 5}", len(t)) for m, t in enumerate(("\n".join(lines), "\n".join([lines[0], " ".join(changed)]), lines[2] if k % 2 else "JUNK### " * 60))]
    types = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(base, types).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    quality, lines, near, mixing, packing = (stage for _, stage in corpus_pipeline.STAGES)

    def kept(stage, given):
        out = stage(spark, given, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return sorted(map(tuple, out.collect()), key=lambda r: r[0])

    one = kept(quality, docs)
    assert one == [r for r in base if brute_kept(r[1] or "")[1]]
    texts = brute_lines([(r[0], r[1], r[3]) for r in one])
    two = kept(lines, spark.createDataFrame(one, docs.schema))
    assert two == [(r[0], texts[r[0]], *r[2:4], len(texts[r[0]])) for r in one] and any(a[1] != b[1] for a, b in zip(one, two, strict=True))
    label, _ = brute_similar([r[1] for r in two], 5, 0.8)
    three = kept(near, spark.createDataFrame(two, docs.schema))
    assert three == [r for k, r in enumerate(two) if label[k] == k] and len(three) < len(two) - 30
    counts = brute_counts([(r[0], r[3]) for r in three])
    four = kept(mixing, spark.createDataFrame(three, docs.schema))
    assert four == [r for r in three for _ in range(counts[r[0]])]
    tokenizer = Encoder(BYTE)
    ids = {r[0]: [*tokenizer.whole(r[1]).ids, 0] for r in four}
    pieces = packing(spark, spark.createDataFrame(four, docs.schema), str(tmp_path)).collect()
    covered, padding = check_pieces(pieces, ids, 1024)
    assert covered == {k: len(v) * counts[k] for k, v in ids.items()} and padding < 0.2
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    piece = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert piece(whole) == piece(pieces)
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
