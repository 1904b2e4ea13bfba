"""BOND against a plain search over all scores."""
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.llm.op12_bond_negatives import Shard, hard_negatives, negatives, op12_bond_negatives, positives, window

LONG = (-(1 << 63), (1 << 63) - 1)


def plain(rows, every=50, n_positives=5, n_negatives=3):
    """(vec_id, label, vector) rows -> the contract's rows, with Python's integers."""
    fit = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        fit.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label,
                    tuple(int(np.floor(256 * float(x))) for x in v)))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, v in {a for a in fit if a[0] is not None and a[0] % every == 0}:
        scored = [(max(LONG[0], min(LONG[1], sum(x * y for x, y in zip(v, w, strict=True)))), j, other)
                  for j, other, w in fit if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, j, _ in [s for s in scored if s[2] == label][:n_positives]:
            hard = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:n_negatives]
            out += [(i, j, n + 1, k, p, s) for n, (s, k, _) in enumerate(hard)]
    return Counter(out)


def got(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, df.select(*cols).collect()))


def test_table_against_plain_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])
    assert want and got(op12_bond_negatives(df)) == want


def test_many_shards_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), [float(x) for x in np.abs(rng.normal(size=9)).round(1)]) for i in range(500)]
    rows += [(500 + i, i % 3, rows[5][2]) for i in range(200)] + [rows[50]] * 4 + [rows[51]] * 20
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    assert got(hard_negatives(df, F.col("vec_id") % 50 == 0, shard_rows=60, block_rows=4)) == plain(rows)


def test_unfit_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (50, 2, [1.0, 2.0]), (50, 2, [1.0, 2.0]), (50, 3, [2.0, 1.0]), (100, None, [1.0, 1.0]),
            (150, 2, None), (200, 2, [1.0, None]), (250, 2, [nan, 1.0]), (300, 2, [inf, 1.0]), (350, 2, [1.0]),
            (400, 2, []), (450, 2, []), (None, 2, [1.0, 1.9]), (None, 3, [1.0, 1.0]), (1, 2, [1.0, 2.0]),
            (2, 2, [1.0, 2.0]), (3, 3, [0.5, 1.5]), (4, 4, [0.5, 1.5]), (-50, 3, [0.1, 1.0]), (-7, 9, [0.9, 1.0]),
            (5, 2, [-1.0, -1.0]), (6, 5, [-1.0, -0.6]), (8, 2, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    want = plain(rows)
    assert want and got(op12_bond_negatives(df)) == want
    assert got(op12_bond_negatives(df.filter("vec_id > 1000"))) == Counter()
    assert got(op12_bond_negatives(df.withColumn("label", F.lit(None).cast("int")))) == Counter()


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e300])
def test_sums_beyond_doubles(spark, scale):
    rng = np.random.default_rng(int(np.log10(scale)))
    rows = [(i, int(rng.integers(3)), [float(x) * scale for x in np.abs(rng.normal(size=4))]) for i in range(101)]
    rows += [(200 + i, 0, [1.0, 0.5, 0.25, i / 3]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(op12_bond_negatives(df)) == plain(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(-4, 9), min_size=10, max_size=10)),
                min_size=2, max_size=40))
def test_bounds_lose_nothing(rows):
    labels = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], float)
    shard = Shard.unpack(Shard(np.arange(len(rows)), np.zeros(len(rows), bool), labels, vectors.T.copy()).pack())
    all_ = vectors @ vectors[0]
    best = sorted((-all_[i], i) for i in range(1, len(rows)) if labels[i] == labels[0])[:2]
    at, score = positives(shard, 0, labels[0], vectors[0], 2)
    assert [(-s, i) for i, s in zip(at, score, strict=True)] == best
    asked = [int(-s) for s, _ in best]
    for s, at, score in negatives(shard, 0, labels[0], vectors[0], asked, 2):
        low, high = window(s)
        assert [(-x, i) for i, x in zip(at, score, strict=True)] == sorted(
            (-all_[i], i) for i in range(len(rows)) if labels[i] != labels[0] and low <= all_[i] <= high)[:2]


def test_bitmap_shrinks_on_telling_dimensions():
    """With few large components, most rows go before most dimensions are read."""
    rng = np.random.default_rng(1)
    vectors = np.round(256 * rng.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 3))
    shard = Shard(np.arange(4000), np.zeros(4000, bool), rng.integers(2, size=4000), vectors.T.copy())
    for i in range(0, 4000, 400):
        positives(shard, i, shard.labels[i], vectors[i], 5)
    assert shard.cells < 0.5 * 10 * 64 * 2000
