"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points (virtual nodes) on a ring. A document's key, a
hash of its text, falls on the ring and belongs to the next point clockwise;
once that shard holds its share of bytes, the key continues clockwise to the
next shard with room. Copies of a text share a key, so they stay together
unless their shard is full. Loads are bounded by ``(1 + slack)`` times the
mean number of bytes, so the law that holds is ``bytes``.

How it is spread: the ring is cut into ``RING`` cells. Only the byte totals
of the cells (a table of at most ``RING`` rows) and the documents larger than
1/``ROCK`` of a shard (at most ``ROCK`` times the number of shards) reach the
driver, which walks the ring once. Inside a cell, documents are ordered and
given the running byte count that decides between the shards of a cell that
overflows. A cell is cut into sub-cells by a hash of the document id, so a
text that fills a third of the table is still many tasks.

Defined results: a null text has size 1, no checksum, and a key of its id; an
empty text has size 1 and checksum 0. Repeated rows are rows of their own.
Null ids are kept. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.prefix import running_sum
from wardflow.session import reliable_checkpoint

RING = 4096
ROCK = 256
ROWS_PER_CELL = 1_000


class Ring:
    """Virtual nodes of ``shards`` shards, and the walk clockwise from a cell."""

    def __init__(self, shards: int, vnodes: int = 64):
        points = []
        for s in range(shards):
            for v in range(vnodes):
                digest = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
                points.append((int.from_bytes(digest, "big"), s))
        points.sort()
        self.cells = [p * RING >> 64 for p, _ in points]
        self.owners = [s for _, s in points]
        self.shards = shards
        self._orders: dict[int, list[int]] = {}

    def clockwise(self, cell: int) -> list[int]:
        """Every shard once, in the order in which the walk meets them."""
        at = bisect.bisect_left(self.cells, cell) % len(self.cells)
        if at not in self._orders:
            turn = self.owners[at:] + self.owners[:at]
            self._orders[at] = list(dict.fromkeys(turn))
        return self._orders[at]


def fill(ring: Ring, rocks: list[tuple[int, int, int]], cells: list[tuple[int, int]],
         total: int, slack: float):
    """Walk the ring: rocks ``(row, cell, size)`` first, then the bytes of each
    cell. Returns the shard of each rock, and intervals ``(cell, from, to,
    shard)`` of each cell's running byte count."""
    capacity = int(-(-total * (1 + slack) // ring.shards))
    load = [0] * ring.shards
    placed, spans = [], []
    for row, cell, size in rocks:
        order = ring.clockwise(cell)
        s = next((s for s in order if load[s] + size <= capacity), None)
        s = min(order, key=lambda x: load[x]) if s is None else s
        load[s] += size
        placed.append((row, s))
    for cell, size in cells:
        at, order = 0, ring.clockwise(cell)
        for s in order:
            if at == size:
                break
            take = min(size - at, capacity - load[s])
            if take > 0:
                spans.append((cell, at, at + take, s))
                load[s] += take
                at += take
        if at < size:  # every shard is full: only rocks can bring this about
            s = min(order, key=lambda x: load[x])
            spans.append((cell, at, size, s))
            load[s] += size - at
    return placed, spans


def ring_shards(docs: DataFrame, shards: int = 16, slack: float = 0.02, vnodes: int = 64,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``size``, ``text_crc32``, ``shard`` and gapless ``slot``."""
    spark = docs.sparkSession
    text, ident = F.col(text_col), F.col(id_col)
    key = F.xxhash64(text, F.when(text.isNull(), ident))
    narrow = docs.select(
        ident.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        key.alias("_key"),
        F.shiftrightunsigned(key, 52).cast("int").alias("_cell"),
        F.monotonically_increasing_id().alias("_row"))
    narrow = reliable_checkpoint(narrow, "ring-keys")
    # At most RING rows: how many parts each cell's rows are dealt into.
    stats = [tuple(r) for r in narrow.groupBy("_cell").agg(F.count("*"), F.sum("size")).collect()]
    total = sum(n for _, _, n in stats)
    rock = total / shards / ROCK
    subs = spark.createDataFrame([(c, -(-n // ROWS_PER_CELL)) for c, n, _ in stats] or [(-1, 1)],
                                 "_cell int, _subs long")
    narrow = narrow.join(F.broadcast(subs), "_cell").withColumn(
        "_sub", F.pmod(F.xxhash64("doc_id", "_row"), F.col("_subs"))).drop("_subs")
    pebbles = narrow.filter(F.col("size") <= rock)
    cells = pebbles.groupBy("_cell", "_sub").agg(F.sum("size").alias("_bytes"))
    ring = Ring(shards, vnodes)
    # At most ROCK * shards rows, and at most RING rows.
    big = [tuple(r) for r in narrow.filter(F.col("size") > rock)
           .select("_row", "_cell", "size").orderBy("_cell", "_key", "_row").collect()]
    per_cell = [tuple(r) for r in cells.groupBy("_cell").agg(F.sum("_bytes")).orderBy("_cell").collect()]
    placed, spans = fill(ring, big, per_cell, total, slack)

    base = running_sum(cells, ["_cell"], "_sub", "_bytes", "_from")
    order = Window.partitionBy("_cell", "_sub").orderBy("_key", "doc_id", "_row")
    at = (pebbles.withColumn("_n", F.row_number().over(order))
          .withColumn("_before", F.sum("size").over(order) - F.col("size"))
          .join(base.select("_cell", "_sub", "_from"), ["_cell", "_sub"])
          .withColumn("_at", F.col("_before") + F.col("_from")))
    walk = (spark.createDataFrame(spans or [(-1, 0, 0, 0)], "_cell int, lo long, hi long, s int")
            .groupBy("_cell").agg(F.collect_list(F.struct("lo", "hi", "s")).alias("_spans")))
    hit = F.filter("_spans", lambda x: (x["lo"] <= F.col("_at")) & (F.col("_at") < x["hi"]))
    # ``walk`` has one row per ring cell: RING rows and as many spans as splits.
    assigned = at.join(F.broadcast(walk), "_cell").select(
        "doc_id", "size", "text_crc32", "_row", "_cell", "_sub", "_n",
        F.get(hit, F.lit(0))["s"].alias("shard"))
    assigned = reliable_checkpoint(assigned, "ring-shards")
    runs = assigned.groupBy("shard", "_cell", "_sub").agg(
        F.count("*").alias("_count"), F.min("_n").alias("_first"))
    by_cell = running_sum(runs.groupBy("shard", "_cell").agg(F.sum("_count").alias("_cells")),
                          ["shard"], "_cell", "_cells", "_cell_base")
    runs = running_sum(runs, ["shard", "_cell"], "_sub", "_count", "_sub_base").join(
        by_cell.select("shard", "_cell", "_cell_base"), ["shard", "_cell"])
    pebble_rows = assigned.join(runs, ["shard", "_cell", "_sub"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_cell_base") + F.col("_sub_base") + F.col("_n") - F.col("_first")).alias("slot"))
    # The rocks follow the other rows of their shard; both tables are bounded.
    counts = {r["shard"]: r["n"] for r in assigned.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    seen, numbered = dict(counts), []
    for row, s in placed:
        numbered.append((row, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + 1
    stones = spark.createDataFrame(numbered or [(-1, 0, 0)], "_row long, shard int, slot long")
    rock_rows = narrow.filter(F.col("size") > rock).join(F.broadcast(stones), "_row").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
    return pebble_rows.unionByName(rock_rows).withColumn("law", F.lit("bytes"))


def op3_ring_shards(docs: DataFrame) -> DataFrame:
    """The contract's columns, for 16 shards."""
    return ring_shards(docs, shards=16, slack=0.0005).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
