"""Ball trees against brute force; the ring's law and its slots."""
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.llm.op2_ball_tree import BallTree, op2_ball_tree, top_k
from wardflow.llm.op3_ring_shards import Ring, fill, op3_ring_shards


def brute(rows, queries, k):
    out = []
    for q in queries:
        v = rows[q][1]
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i)
                      for i, w in rows if i != rows[q][0] and len(w) == len(v))[:k]
        out += [(rows[q][0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r[0], [int(np.floor(64 * float(x))) for x in r[1]]) for r in df.collect()]
    want = brute(rows, [i for i, r in enumerate(rows) if r[0] % 20 == 0], 20)
    assert sorted(map(tuple, op2_ball_tree(df).collect())) == want


def test_many_shards_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    got = top_k(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=90, block_rows=15)
    assert sorted(map(tuple, got.collect())) == brute(whole, range(0, 1000, 20), 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=60), st.integers(1, 5))
def test_tree_with_ties(points, k):
    ids, v = np.arange(len(points)), np.array(points, float)
    tree = BallTree.unpack(BallTree(ids, v, leaf=4).pack())
    low, any_id = np.full(len(ids), -1 << 62), np.full(len(ids), (1 << 63) - 1)
    names, scores = tree.search(ids, v, k, low, any_id)
    for j in range(len(ids)):
        want = sorted((-float(v[j] @ v[i]), i) for i in range(len(ids)) if i != j)[:k]
        assert [(-s, i) for i, s in zip(names[j], scores[j], strict=True) if i >= 0] == want


def test_unfit_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]),
            (4, [inf, 1.0]), (5, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (6, []), (60, []), (None, [1.0, 1.0]),
            (80, [1e300, 1.0]), (-20, [1.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in sorted(op2_ball_tree(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[40] == [(5, 64 * 64 * 6)] and got[60] == [(6, 0)]
    assert got[0][0] == (80, 2**63 - 1) and got[0][1:3] == [(20, 64 * 32 * 3), (20, 64 * 32 * 3)]
    assert [i for i, _ in got[20]] == [80, 0, -20]
    assert op2_ball_tree(df.limit(0)).count() == 0


def check(rows, texts, shards=16):
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == Counter(
        (d, None if t is None else zlib.crc32(t.encode())) for d, t in texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_are_even(docs, doc_rows):
    rows = op3_ring_shards(docs).collect()
    sizes = check(rows, [(d, t) for d, t, _, _ in doc_rows])
    assert sum(sizes.values()) == sum(len(t.encode()) + 1 for _, t, _, _ in doc_rows)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) <= 1.01 * mean and min(sizes.values()) >= 0.97 * mean


def test_copies_mostly_stay_together(docs):
    rows = op3_ring_shards(docs).groupBy("text_crc32", "size").agg(
        F.countDistinct("shard").alias("k"), F.count("*").alias("c")).filter("c > 1").collect()
    assert sum(r["k"] == 1 for r in rows) > 0.8 * len(rows)


def test_shards_of_edge_rows(edge):
    check(op3_ring_shards(edge).collect(), [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert op3_ring_shards(edge.limit(0)).count() == 0


def test_growth_moves_little():
    rng = np.random.default_rng(1)
    cells = [(c, int(x)) for c, x in enumerate(rng.integers(800, 1200, 4096))]
    total = sum(x for _, x in cells)

    def owner(shards):
        got = {}
        for c, a, b, s in fill(Ring(shards), [], cells, total, 0.05)[1]:
            got.setdefault(c, []).append((a, b, s))
        return got
    one, two = owner(16), owner(17)
    stay = sum(max(0, min(b, d) - max(a, c)) for x in one for a, b, s in one[x]
               for c, d, t in two[x] if s == t)
    assert stay / total > 0.6
    load = Counter()
    for spans in one.values():
        for a, b, s in spans:
            load[s] += b - a
    assert max(load.values()) <= 1.05 * total / 16 + 1
