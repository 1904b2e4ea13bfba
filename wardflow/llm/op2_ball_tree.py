"""Exact top-k inner-product search with ball trees.

Vectors are turned into whole numbers, floor(64 x) of each component, and
dealt over shards of about ``SHARD_ROWS`` rows by a hash of their id. Each
shard builds a ball tree: nodes with a centre, a radius, and the smallest id
below them. No point of a node has a larger inner product with a query q than
centre . q + radius * |q|.

Queries go in blocks of ``BLOCK_ROWS``; every (shard, block) pair is a task of
its own. In a task, nodes whose bound cannot reach a query's k-th best score
are cut off on the way down; the leaves that are left are visited in the order
of their bounds, and every visit raises the k-th score that the next must
beat. A node whose bound equals that score is visited only if it holds an id
small enough to win the tie.

The k-th score is shared between shards: a first pass looks at the best leaf
of every shard, the 20 best of all those are merged, and the k-th of them is
the score that every shard starts from in the second pass. All bounds are
upper bounds, so the result is exact; scores are computed in whole numbers
(in floating point while every sum is below 2^53, beyond it in Python's
integers; scores outside the range of a long are set to its end).

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id. Vectors are compared with those of
their own length only; empty ones score 0 with each other. Rows that share
the query's id are its own and no candidates. Repeated rows are candidates of
their own; a query that is repeated is searched once. Other columns are not
read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import reliable_checkpoint

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF = 64
SAFE = 2.0 ** 53


class BallTree:
    """A shard's vectors in leaf order, and its nodes in arrays. Node 0 is the
    root; ``left`` is 0 in leaves. Equal vectors share a ball of radius 0."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        centre, radius, left, right, start, end, least = ([] for _ in range(7))
        perm = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = vectors[perm[a:b]]
            c = rows.mean(0) if b > a else np.zeros(vectors.shape[1])
            spread = np.sqrt(np.maximum(((rows - c) ** 2).sum(1), 0)) if b > a else np.zeros(1)
            node = len(centre)
            centre.append(c)
            radius.append(float(spread.max()))
            left.append(0)
            right.append(0)
            start.append(a)
            end.append(b)
            least.append(int(ids[perm[a:b]].min()) if b > a else 0)
            if parent >= 0:
                (left, right)[side][parent] = node
            if b - a > leaf and spread.max() > 0:
                # Split between the two points that lie far apart.
                p = rows[np.argmax(spread)]
                q = rows[np.argmax(((rows - p) ** 2).sum(1))]
                along = rows @ (p - q)
                mid = (b - a) // 2
                perm[a:b] = perm[a:b][np.argsort(along, kind="stable")]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        for a, b, is_leaf in zip(start, end, [x == 0 for x in left], strict=True):
            if is_leaf:
                perm[a:b] = np.sort(perm[a:b])
        self.ids, self.vectors = ids[perm], vectors[perm]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.left, self.right = np.array(left), np.array(right)
        self.start, self.end, self.least = np.array(start), np.array(end), np.array(least)

    def pack(self) -> bytes:
        state = dict(self.__dict__)
        if np.abs(self.vectors).max(initial=0) < 1 << 15:
            state["vectors"] = self.vectors.astype(np.int16)
        state["centre"] = self.centre.astype(np.float32)
        # The rounding of the centres to 32 bits is added to the radii.
        moved = np.sqrt(((state["centre"].astype(float) - self.centre) ** 2).sum(1))
        state["radius"] = self.radius + moved
        return pickle.dumps(state)

    @classmethod
    def unpack(cls, data: bytes) -> BallTree:
        tree = object.__new__(cls)
        tree.__dict__ = pickle.loads(data)
        tree.vectors, tree.centre = tree.vectors.astype(float), tree.centre.astype(float)
        return tree

    def bound(self, nodes: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds (nodes x queries); rounding errors are allowed for."""
        b = self.centre[nodes] @ queries.T + self.radius[nodes][:, None] * norms[None, :]
        size = np.abs(self.centre[nodes]).max(initial=0) * np.abs(queries).max(initial=0) * queries.shape[1]
        return np.floor(b + 1e-9 * (np.abs(b) + size) + 1e-6)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floor_score: np.ndarray,
               floor_id: np.ndarray, visits: int | None = None):
        """The k best of this shard for each query: ids and scores, unused
        places having id -1. Rows that are worse than the given floor (a score
        and the largest id that still ties with it) may be missing. ``visits``
        bounds the number of leaves a query sees."""
        norms = np.sqrt((queries ** 2).sum(1))
        n = len(queries)
        best = np.full((n, k), -np.inf)
        names = np.full((n, k), np.iinfo(np.int64).max)
        score, last = floor_score.astype(float).copy(), floor_id.copy()
        # Down the tree: pairs of a node and a query that its bound can serve.
        at, who = np.zeros(n, np.int64), np.arange(n)
        leaves, leaf_who, leaf_bound = [], [], []
        while len(at):
            bound = np.empty(len(at))
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                bound[a:b] = self.bound(at[a:a + 1], queries[who[a:b]], norms[who[a:b]])[0]
            fit = (bound > score[who]) | ((bound == score[who]) & (self.least[at] <= last[who]))
            at, who, bound = at[fit], who[fit], bound[fit]
            leaf = self.left[at] == 0
            leaves.append(at[leaf])
            leaf_who.append(who[leaf])
            leaf_bound.append(bound[leaf])
            inner, q = at[~leaf], who[~leaf]
            at, who = np.concatenate([self.left[inner], self.right[inner]]), np.concatenate([q, q])
        at, who, bound = map(np.concatenate, (leaves, leaf_who, leaf_bound)) if leaves else (at, who, np.zeros(0))
        # Each query visits its leaves by bound; all their n-th visits together.
        order = np.lexsort((at, -bound, who))
        at, who, bound = at[order], who[order], bound[order]
        first = np.searchsorted(who, np.arange(n))
        count = np.diff(np.append(first, len(who)))
        live, turn = np.flatnonzero(count > 0), 0
        while len(live) and (visits is None or turn < visits):
            here = first[live] + turn
            leaf, top = at[here], bound[here]
            fit = (top > score[live]) | ((top == score[live]) & (self.least[leaf] <= last[live]))
            # Bounds only fall from here on; a tie may still hold smaller ids.
            done = top < score[live]
            go, to = live[fit], leaf[fit]
            order = np.argsort(to, kind="stable")
            go, to = go[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
                if b > a:
                    self._visit(int(to[a]), go[a:b], ids, queries, best, names, score, last, k)
            turn += 1
            live = live[~done]
            live = live[count[live] > turn]
        return np.where(np.isfinite(best), names, -1), best

    def _visit(self, leaf, who, ids, queries, best, names, score, last, k):
        a, b = self.start[leaf], self.end[leaf]
        got = _products(queries[who], self.vectors[a:b])
        own = self.ids[a:b]
        better = (got > score[who][:, None]) | (
            (got == score[who][:, None]) & (own[None, :] <= last[who][:, None]))
        better &= own[None, :] != ids[who][:, None]
        any_ = better.any(1)
        who, got, better = who[any_], got[any_], better[any_]
        if not len(who):
            return
        s = np.concatenate([best[who], np.where(better, got, -np.inf)], axis=1)
        i = np.concatenate([names[who], np.broadcast_to(own, got.shape)], axis=1)
        i = np.where(np.isfinite(s), i, np.iinfo(np.int64).max)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        best[who], names[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        full = np.isfinite(best[who, -1])
        w = who[full]
        higher = (best[w, -1] > score[w]) | ((best[w, -1] == score[w]) & (names[w, -1] < last[w]))
        w = w[higher]
        score[w], last[w] = best[w, -1], names[w, -1]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond 2^53 only their order is kept in floats."""
    return queries @ rows.T


def _large(a: np.ndarray, b: np.ndarray) -> bool:
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) >= SAFE


def search_large(tree: BallTree, ids, queries, k: int):
    """All scores in Python's integers, for components too large for floats."""
    rows = [[int(x) for x in v] for v in tree.vectors.tolist()]
    out_ids, out = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf, object)
    for j, q in enumerate([int(x) for x in v] for v in queries.tolist()):
        all_ = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i)
                      for r, i in zip(rows, tree.ids.tolist(), strict=True) if i != ids[j])[:k]
        for n, (s, i) in enumerate(all_):
            out_ids[j, n], out[j, n] = i, max(-2**63, min(2**63 - 1, -s))
    return out_ids, out


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(64 * flat).reshape(len(column), dim)


def _build(key, table):
    dim, shard = (x.as_py() for x in key)
    tree = BallTree(table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": [tree.pack()]})


def _block(key, table):
    dim, block = (x.as_py() for x in key)
    data = pickle.dumps((table.column("vec_id").to_numpy(), table.column("qh").to_numpy(),
                         _matrix(table.column("v"), dim), table.column("floor_score").to_numpy(),
                         table.column("floor_id").to_numpy()))
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "queries": [data]})


def _search(k: int, visits: int | None):
    def run(batches):
        for batch in batches:
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("queries").to_pylist(),
                                  strict=True):
                tree = BallTree.unpack(tree)
                ids, qh, queries, floor_score, floor_id = pickle.loads(data)
                if _large(queries, tree.vectors):
                    names, score = search_large(tree, ids, queries, k) if visits is None else (
                        np.full((len(ids), k), -1), np.zeros((len(ids), k)))
                else:
                    names, score = tree.search(ids, queries, k, floor_score, floor_id, visits)
                at = np.nonzero(names >= 0) if names.size else (np.zeros(0, int),) * 2
                at = np.nonzero(score != -np.inf) if visits is None else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[0]]), pa.array(qh[at[0]]), pa.array(names[at]),
                     pa.array([int(x) for x in score[at].tolist()], pa.int64())],
                    names=["query_id", "qh", "vec_id", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every row for
    which ``is_query`` (a condition on ``vec_id``) holds."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & sound)
            .withColumn("dim", F.size("v")))
    sizes = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = (max(1, -(-n // m)) for n, m in zip(sizes, (shard_rows, block_rows), strict=True))
    trees = reliable_checkpoint(
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        .groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, tree binary"), "ball-trees")
    queries = (rows.filter(is_query).withColumn("qh", F.xxhash64("v")).dropDuplicates(["vec_id", "qh"])
               .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")))
    none = [F.lit(-1 << 62).alias("floor_score"), F.lit((1 << 63) - 1).alias("floor_id")]

    def found(asked: DataFrame, visits: int | None) -> DataFrame:
        packed = asked.groupBy("dim", "block").applyInArrow(_block, "dim int, block int, queries binary")
        left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        pairs = (left.join(right.hint("merge"), ["dim", "shard", "block"])
                 .repartition(min(shards * blocks, 100_000), "dim", "shard", "block"))
        return pairs.select("tree", "queries").mapInArrow(
            _search(k, visits), "query_id long, qh long, vec_id long, score long")

    pilot = _best(found(queries.select("*", *none), 1), k)
    kth = pilot.filter(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), "qh", F.col("score").alias("floor_score"),
        F.col("vec_id").alias("floor_id"))
    kth = reliable_checkpoint(kth, "kth-scores")
    asked = queries.join(kth, ["vec_id", "qh"], "left").select(
        *queries.columns, F.coalesce("floor_score", none[0]).alias("floor_score"),
        F.coalesce("floor_id", none[1]).alias("floor_id"))
    return _best(found(asked, None), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ball_tree(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: the 20 best for every id divisible by 20."""
    return top_k(embeddings, F.col("vec_id") % 20 == 0)
