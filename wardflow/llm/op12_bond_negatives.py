"""Hard negatives by BOND: branch and bound on vertically stored vectors.

Vectors are turned into whole numbers, floor(256 x) of each component, and
stored by column: a shard of about ``SHARD_ROWS`` rows holds one array for
each dimension, with its smallest and largest value. For an anchor the
dimensions are read in the order of its own components' magnitude, the largest
first, ``STEP`` at a time. What the unread dimensions can still add to a row's
score lies between the sums of their smallest and largest contributions, so a
row's score is known within bounds that close with every step, and a bitmap of
candidates shrinks:

* positives (rows of the anchor's label): a row goes once its upper bound is
  below the k-th best lower bound;
* negatives (rows of other labels): each positive opens a window of scores. A
  row goes once it can be in no window, or only in windows for which enough
  rows are known to be inside and above its upper bound.

Only the rows still in the bitmap are read in the next dimensions; after the
last one their scores are exact, and so are the windows. Nothing is lost.

Anchors go in blocks of ``BLOCK_ROWS``; every (shard, block) pair is a task of
its own with two bounded arrays. The positives of all shards are merged before
the windows are opened, the negatives after.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part. A row whose id is divisible by ``shift`` first gets
the label (label + 1) % labels. Rows that share the anchor's id are the anchor
itself. A null id is no anchor; its row may be chosen, after all others of the
same score. Rows of another length than the anchor's are not compared. Repeated
rows are candidates of their own, and one anchor. Scores are exact: in doubles
while no sum reaches 2^53, else in Python's integers; beyond the range of a
long a score is that range's end (and a component whose 256-fold is no double
the largest one). An empty or all-null table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import reliable_checkpoint

SHARD_ROWS = 16384
BLOCK_ROWS = 512
STEP = 8
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
SAFE = 2.0 ** 53
LONG = (-(1 << 63), (1 << 63) - 1)


class Shard:
    """Vectors by column, with the range of each dimension. ``id_null`` marks
    the rows without an id. ``cells`` counts the components read."""

    def __init__(self, ids, id_null, labels, columns):
        self.ids, self.id_null, self.labels, self.columns = ids, id_null, labels, columns
        none = np.zeros(len(columns))
        self.low = columns.min(1) if columns.size else none
        self.high = columns.max(1) if columns.size else none
        self.cells = 0

    def pack(self) -> bytes:
        small = np.abs(self.columns).max(initial=0) < 1 << 15
        return pickle.dumps((self.ids, self.id_null, self.labels,
                             self.columns.astype(np.int16) if small else self.columns))

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        ids, id_null, labels, columns = pickle.loads(data)
        return cls(ids, id_null, labels, columns.astype(float))

    def exact_for(self, vectors: np.ndarray) -> Shard:
        """This shard, in Python's integers if doubles could round a sum."""
        most = np.abs(self.columns).max(initial=0) * np.abs(vectors).max(initial=0)
        if most * max(1, len(self.columns)) < SAFE:
            return self
        return Shard(self.ids, self.id_null, self.labels, whole(self.columns))

    def of(self, name: int) -> np.ndarray:
        return (self.ids == name) & ~self.id_null

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the candidates in the bitmap ``alive`` that
        ``keep(lower bounds, upper bounds)`` never turned down."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        # What the dimensions from the k-th on can still add.
        least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (ends.min(0), ends.max(0)))
        alive = alive.copy()
        rows = np.flatnonzero(alive)
        score = np.zeros(len(rows), dtype=self.columns.dtype)
        for k in range(0, len(order), STEP):
            if not len(rows):
                break
            read = order[k: k + STEP]
            self.cells += len(read) * len(rows)
            score = score + anchor[read] @ self.columns[np.ix_(read, rows)]
            after = min(k + STEP, len(order))
            stays = keep(_long(score + least[after]), _long(score + most[after]))
            alive[rows[~stays]] = False
            rows, score = rows[stays], score[stays]
        return np.flatnonzero(alive), _long(score)

    def first(self, rows: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` best of the given rows, ties to smaller ids."""
        order = np.lexsort((self.ids[rows], self.id_null[rows], -score))[:n]
        return rows[order], score[order]


def whole(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out[...] = [[int(x) for x in line] for line in values.tolist()] if values.ndim == 2 else [
        int(x) for x in values.tolist()]
    return out


def _long(score: np.ndarray) -> np.ndarray:
    return np.clip(score, *LONG) if score.dtype == object else score


def _kth(values: np.ndarray, k: int):
    return np.sort(values)[-k]


def positives(shard: Shard, anchor_id: int, label: int, vector: np.ndarray, k: int):
    def keep(lower, upper):
        return upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), bool)

    rows, score = shard.scan(vector, (shard.labels == label) & ~shard.of(anchor_id), keep)
    return shard.first(rows, score, k)


def window(positive: int) -> tuple[int, int]:
    """Scores s with 50 positive <= 100 s <= 95 positive."""
    return -(-50 * positive // 100), 95 * positive // 100


def negatives(shard: Shard, anchor_id: int, label: int, vector: np.ndarray, scores: list[int], n: int):
    """For each positive score: the best rows of other labels in its window."""
    windows = [w for w in map(window, scores) if w[0] <= w[1]]

    def keep(lower, upper):
        stays = np.zeros(len(lower), bool)
        for low, high in windows:
            may = (upper >= low) & (lower <= high)
            sure = lower[(lower >= low) & (upper <= high)]
            stays |= (may & (upper >= _kth(sure, n))) if len(sure) >= n else may
        return stays

    if not windows:
        return [(s, np.zeros(0, int), np.zeros(0)) for s in scores]
    rows, score = shard.scan(vector, (shard.labels != label) & ~shard.of(anchor_id), keep)
    out = []
    for s in scores:
        low, high = window(s)
        inside = (score >= low) & (score <= high)
        out.append((s, *shard.first(rows[inside], score[inside], n)))
    return out


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    most = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -most, most).reshape(len(column), dim)


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), null


def _columns(key, table):
    dim, shard = (x.as_py() for x in key)
    made = Shard(*_ids(table.column("vec_id")), table.column("label").to_numpy(),
                 np.ascontiguousarray(_matrix(table.column("v"), dim).T))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "rows": [made.pack()]})


def _block(key, table):
    dim, block = (x.as_py() for x in key)
    data = pickle.dumps((table.column("vec_id").to_pylist(), table.column("ah").to_pylist(),
                         table.column("label").to_pylist(), _matrix(table.column("v"), dim),
                         table.column("scores").to_pylist()))
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "anchors": [data]})


FOUND = "anchor_id long, ah long, positive_score long, vec_id long, score long"


def _search(n: int, asked: str):
    def run(batches):
        for batch in batches:
            for rows, anchors in zip(batch.column("rows").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                ids, ah, labels, vectors, scores = pickle.loads(anchors)
                shard = Shard.unpack(rows).exact_for(vectors)
                vectors = whole(vectors) if shard.columns.dtype == object else vectors
                out = []
                for i, name in enumerate(ids):
                    found = ([(None, *positives(shard, name, labels[i], vectors[i], n))] if asked == "positives"
                             else negatives(shard, name, labels[i], vectors[i], scores[i], n))
                    out += [(name, ah[i], s, None if shard.id_null[r] else int(shard.ids[r]), int(x))
                            for s, at, value in found for r, x in zip(at.tolist(), value.tolist(), strict=True)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["anchor_id", "ah", "positive_score", "vec_id", "score"])
    return run


def _best(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   shift: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for every row for which ``is_anchor`` (a condition on
    ``vec_id``) holds."""
    v, label = F.col("v"), F.col("label")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                           F.col(f"`{label_col}`").cast("long").alias("label"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .filter(label.isNotNull() & v.isNotNull() & sound)
            .withColumn("label", F.when(F.col("vec_id") % shift == 0, (label + 1) % labels).otherwise(label))
            .withColumn("dim", F.size("v")))
    sizes = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    shards, blocks = (max(1, -(-n // m)) for n, m in zip(sizes, (shard_rows, block_rows), strict=True))
    # Rows are dealt in turn, so that repeated rows do not meet in one shard;
    # the written table holds what was dealt.
    columns = reliable_checkpoint(
        rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
        .groupBy("dim", "shard").applyInArrow(_columns, "dim int, shard int, rows binary"), "vector-columns")
    anchors = (rows.filter(is_anchor).withColumn("ah", F.xxhash64("label", "v")).dropDuplicates(["vec_id", "ah"])
               .withColumn("block", F.pmod(F.xxhash64("vec_id", "ah"), F.lit(blocks)).cast("int")))

    def found(wanted: DataFrame, n: int, asked: str) -> DataFrame:
        packed = wanted.groupBy("dim", "block").applyInArrow(_block, "dim int, block int, anchors binary")
        left = columns.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        pairs = (left.join(right.hint("merge"), ["dim", "shard", "block"])
                 .repartition(min(shards * blocks, 100_000), "dim", "shard", "block"))
        return pairs.select("rows", "anchors").mapInArrow(_search(n, asked), FOUND)

    none = F.array().cast("array<long>").alias("scores")
    near = found(anchors.select("*", none), n_positives, "positives")
    near = _best(near, ["anchor_id", "ah"], n_positives).select(
        "anchor_id", "ah", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = reliable_checkpoint(near, "positives")
    windows = near.groupBy(F.col("anchor_id").alias("vec_id"), "ah").agg(
        F.collect_set("positive_score").alias("scores"))
    hard = _best(found(anchors.join(windows, ["vec_id", "ah"]), n_negatives, "negatives"),
                 ["anchor_id", "ah", "positive_score"], n_negatives)
    return near.join(hard, ["anchor_id", "ah", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op12_bond_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: three negatives for each of five positives of
    every anchor whose id is divisible by 50."""
    return hard_negatives(embeddings, F.col("vec_id") % 50 == 0)
