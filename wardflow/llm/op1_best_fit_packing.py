"""Best-fit-decreasing packing into id matrices.

Texts are tokenized and dealt over shards of about ``SHARD_IDS`` ids by a hash
of their id and text. In a shard, documents longer than a window are split:
their whole windows are rows of their own, and what is left is packed like
other documents, so no id is lost. Pieces are placed from the largest to the
smallest, each into the row whose free places it fills best; the row is found
by walking down a segment tree over the numbers of free places, whose nodes
know whether any row below them has that many.

A row of the result is a row of the matrix: ``ids`` (``window`` little-endian
ids, padded), ``lengths`` (cumulative segment lengths, from 0), ``positions``
(ids' places in their segments, which start again at 0 with each, as 16-bit
numbers), and the documents with the places their pieces start from.
``write_matrices`` writes them.

Defined results: a null or empty text is its end id alone. Padding ids and
positions are 0 and belong to no segment. Repeated rows are packed as often
as they occur; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._tokens import EOS, Encoder, binary_rows, default_tokenizer
from wardflow.session import reliable_checkpoint

WINDOW = 2048
SHARD_IDS = 2_000_000
SLICE = 4 << 20
SCHEMA = ("shard int, row int, n_ids int, ids binary, lengths array<int>, positions binary, "
          "doc_ids array<long>, starts array<long>, doc_lengths array<long>")


class FreePlaces:
    """Segment tree over numbers of free places: how many rows lie below."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        k = free + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """The row with the fewest free places of at least ``need``, and how
        many it has; row -1 if there is none."""
        k = need + self.size
        if not self.count[k]:
            # Up to the first right-hand neighbour that has rows, then down.
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return -1, 0
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.size
        row = self.rows[free].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return row, free


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Row of each piece; pieces are placed in order of falling length."""
    row = np.empty(len(lengths), np.int64)
    tree, used = FreePlaces(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at, free = (-1, 0) if need == window else tree.take(need)
        if at < 0:
            at, free = used, window
            used += 1
        row[i] = at
        if free > need:
            tree.add(free - need, at)
    return row


def _pack(window: int):
    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in ("text_hash", "doc_id", "from")])
        dtype = np.dtype("<u2" if table.column("width")[0].as_py() == 2 else "<u4")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype)
        n = table.column("n").to_numpy()
        head = np.cumsum(n) - n
        doc, part = A.expand(-(-n // window))
        start = part * window
        length = np.minimum(n[doc] - start, window)
        row = best_fit(length, window)
        # Pieces in row order, longest first, and their places in the rows.
        order = np.lexsort((np.arange(len(row)), -length, row))
        doc, start, length, row = doc[order], start[order], length[order], row[order]
        first = np.searchsorted(row, np.arange(row[-1] + 1))
        after = np.cumsum(length)
        offset = after - length - (after - length)[first][row]
        rows = int(row[-1]) + 1
        matrix, place = np.zeros((rows, window), dtype), np.zeros((rows, window), "<u2")
        piece, inside = A.expand(length)
        to = (row[piece], offset[piece] + inside)
        matrix[to] = ids[head[doc][piece] + start[piece] + inside]
        place[to] = inside
        ends = np.append(first[1:], len(row))
        names = table.column("doc_id").combine_chunks().take(pa.array(doc))
        cuts = pa.array(np.append(first, len(row)).astype(np.int32))
        cumulative = [np.concatenate([offset[a:b], [offset[b - 1] + length[b - 1]]])
                      for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        return pa.table({
            "shard": pa.array(np.full(rows, key[0].as_py()), pa.int32()),
            "row": pa.array(np.arange(rows), pa.int32()),
            "n_ids": pa.array([int(c[-1]) for c in cumulative], pa.int32()),
            "ids": pa.array([r.tobytes() for r in matrix], pa.binary()),
            "lengths": pa.array(cumulative, pa.list_(pa.int32())),
            "positions": pa.array([r.tobytes() for r in place], pa.binary()),
            "doc_ids": pa.ListArray.from_arrays(cuts, names),
            "starts": pa.ListArray.from_arrays(cuts, pa.array(start + table.column("from").to_numpy()[doc])),
            "doc_lengths": pa.ListArray.from_arrays(cuts, pa.array(table.column("total").to_numpy()[doc])),
        })
    return run


def pack_best_fit(docs: DataFrame, window: int = WINDOW, shard_ids: int = SHARD_IDS,
                  tokenizer: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Rows of the id matrices, shard by shard."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            for part in A.slices(batch, "text", SLICE):
                ids, offsets = encoder.texts(part.column("text"), EOS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), binary_rows(ids, offsets),
                     pa.array(np.diff(offsets)),
                     pa.array(np.full(part.num_rows, encoder.dtype.itemsize, np.int32))],
                    names=["doc_id", "text_hash", "ids", "n", "width"])

    if window >= 1 << 16:
        raise ValueError("positions are 16-bit numbers: the window must be below 65536")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    tokens = reliable_checkpoint(rows.mapInArrow(
        run, "doc_id long, text_hash long, ids binary, n long, width int"), "tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_ids))
    # A document longer than a shard is cut at whole windows before it is dealt.
    step = window * max(1, shard_ids // window)
    cut = (tokens.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1,
                                                         F.lit(step).cast("long"))))
           .withColumn("_n", F.least(F.lit(step).cast("long"), F.col("n") - F.col("_at"))))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "_at", F.spark_partition_id()), F.lit(shards))
    cut = cut.select("doc_id", "text_hash", "width", F.col("n").alias("total"), F.col("_at").alias("from"),
                     F.col("_n").alias("n"), salt.cast("int").alias("shard"),
                     F.when(F.col("n") <= step, F.col("ids")).otherwise(F.substring(
                         "ids", (F.col("_at") * F.col("width") + 1).cast("int"),
                         (F.col("_n") * F.col("width")).cast("int"))).alias("ids"))
    return cut.groupBy("shard").applyInArrow(_pack(window), SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Packed rows as Parquet under ``path``, one folder a shard."""
    pack_best_fit(docs, **options).write.partitionBy("shard").mode("overwrite").parquet(path)


def op1_best_fit_packing(docs: DataFrame) -> DataFrame:
    """Every row of the matrices: windows of 2048 ids."""
    return pack_best_fit(docs)
