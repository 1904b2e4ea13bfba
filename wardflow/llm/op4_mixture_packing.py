"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids, in table order. Windows of
``WINDOW`` ids are filled in turn: each window credits every queue with its
share of the window, a queue is served the whole ids of its credit, and the
few ids still missing go to the queues with the largest deficits, which carry
what they lack (or have had too much) into the next window. So every window
holds the target proportions to within one id a queue, and the queues run dry
as their targets say: with no targets, shares are the sources' own sizes and
all of them end together. Cuts fall where windows end, so only the last
window of the corpus is padded.

How it is spread:

1. Texts are tokenized once and written; inside each task the ids of each
   source are counted on, which gives the place of a document in its queue
   after a running sum over the (task, source) totals.
2. Each queue advances by the same fraction in every *partition* of about
   ``WINDOWS`` windows. Where a queue stands when a partition begins is
   floor(quantum * partition), a closed form, so every partition knows its own
   ids, the fraction of an id that it is owed (the carried deficits), and the
   place of its first id in the one sequence of windows. The partition of an
   id is the inverse of that form, in whole numbers; a queue of fewer ids than
   there are partitions has rows only in those where it advances.
   With targets there are two such laws, one behind the other: by the targets
   until every queue with at least 1/``MINOR`` of an equal share is dry, then,
   for what is left of the others (those of weight 0 have all of theirs left),
   in proportion to what is left. So small weights and zeros cost no more
   partitions or pieces than others do.
3. A partition's ids (about ``WINDOWS * WINDOW``, whatever the sizes of
   sources and documents) meet in one task, which runs the round-robin. A
   window may begin in one partition and go on in the next. In the partition
   in which a queue ends, what is left of it is spread over the windows.

Defined results: a null or empty text is its end id alone. A null source is
the queue of the empty name. Repeated rows are packed as often as they occur.
Columns other than the id, the text and the source are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._tokens import EOS, Encoder, binary_rows, default_tokenizer
from wardflow.llm.prefix import running_sum
from wardflow.session import reliable_checkpoint

WINDOW = 2048
WINDOWS = 512
MINOR = 8
#: Bytes of texts that are tokenized at once; the temporaries are some twenty times that.
SLICE = 1 << 20


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's ids (little-endian, ``width`` bytes each), with its task and
    the count of ids that the task had before it from the same source."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder, part, counts = Encoder.at(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in A.slices(batch, "text", SLICE):
                ids, offsets = encoder.texts(piece.column("text"), EOS)
                n = np.diff(offsets)
                start = np.empty(len(n), np.int64)
                names = piece.column("source").to_pylist()
                for i, (s, k) in enumerate(zip(names, n.tolist(), strict=True)):
                    start[i] = counts.get(s, 0)
                    counts[s] = counts.get(s, 0) + k
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("source"), binary_rows(ids, offsets),
                     pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(start),
                     pa.array(np.full(len(n), encoder.dtype.itemsize, np.int32))],
                    names=["doc_id", "source", "ids", "n", "part", "start", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, source string, ids binary, n long, part int, start long, width int")


def schedule(queues: dict[str, int], owed: dict[str, float], at: int, window: int = WINDOW
             ) -> tuple[list[str], np.ndarray]:
    """Deficit round-robin over one partition's queues ``{source: ids}``, from
    place ``at`` in the sequence of windows. Returns the sources and the ids
    each window takes from each of them. Credits are whole numbers of 1/total
    of an id, so nothing is lost to rounding."""
    names = sorted(queues)
    left = np.array([queues[s] for s in names], np.int64)
    total = int(left.sum())
    share = left.copy()
    deficit = np.array([int(owed.get(s, 0) * total) for s in names], np.int64)
    served, room = [], window - at % window
    while total > 0 and (rest := int(left.sum())):
        size = min(room, rest)
        deficit += size * share
        take = np.clip(deficit // total, 0, left)
        gap = size - int(take.sum())
        while gap > 0:
            open_ = np.flatnonzero(take < left)
            lack = (deficit - take * total)[open_]
            for i in open_[np.argsort(-lack, kind="stable")][:gap]:
                take[i] += 1
                gap -= 1
        while gap < 0:
            given = np.flatnonzero(take > 0)
            lack = (deficit - take * total)[given]
            for i in given[np.argsort(lack, kind="stable")][:-gap]:
                take[i] -= 1
                gap += 1
        deficit -= take * total
        left -= take
        served.append(take)
        room = window
    return names, np.array(served, np.int64).reshape(len(served), len(names))


_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, source string, ids binary")


def _pack(window: int, with_ids: bool):
    def run(key, table):
        table = table.sort_by([("source", "ascending"), ("place", "ascending"), ("doc_id", "ascending")])
        cols = {c: table.column(c).to_numpy() for c in ("doc_id", "from", "n", "doc_tokens", "owed")
                if table.column(c).null_count == 0}
        doc = table.column("doc_id").combine_chunks()
        source = table.column("source").to_pylist()
        at = table.column("at")[0].as_py()
        dtype = np.dtype("<u2" if table.column("width")[0].as_py() == 2 else "<u4")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype).astype("<u4")
        queues: dict[str, int] = {}
        owed: dict[str, float] = {}
        for s, k, o in zip(source, cols["n"].tolist(), cols["owed"].tolist(), strict=True):
            queues[s] = queues.get(s, 0) + k
            owed[s] = o
        names, served = schedule(queues, owed, at, window)
        # Rows are in queue order, so a place in ``ids`` is a place in a queue.
        row_end = np.cumsum(cols["n"])
        row_start = row_end - cols["n"]
        base = np.cumsum([queues[s] for s in names]) - np.array([queues[s] for s in names])
        ends = base + np.cumsum(served, axis=0)          # of each window's slot, in ``ids``
        starts = ends - served
        skip = np.zeros(len(served), np.int64)           # ids that are in the window already
        skip[0] = at % window
        inside = skip[:, None] + np.cumsum(served, axis=1) - served
        cuts = np.unique(np.concatenate([row_start, starts.ravel(), row_end[-1:]]))
        cuts = cuts[cuts <= len(ids)]
        a, b = cuts[:-1], cuts[1:]
        row = np.searchsorted(row_start, a, "right") - 1
        flat = np.flatnonzero(served.T.ravel() > 0)      # slots in queue order
        slot_start = starts.T.ravel()[flat]
        slot = flat[np.searchsorted(slot_start, a, "right") - 1]
        queue, win = np.divmod(slot, len(served))
        raw = ids.tobytes()
        crc = [zlib.crc32(raw[4 * x: 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        out = {
            "doc_id": doc.take(pa.array(row)),
            "start": pa.array(cols["from"][row] + a - row_start[row]),
            "length": pa.array(b - a),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(cols["doc_tokens"][row]),
            "sequence_id": pa.array(at // window + win),
            "offset": pa.array(inside[win, queue] + a - starts[win, queue]),
        }
        if with_ids:
            out["source"] = pa.array(np.array(names, object)[queue], pa.string())
            out["ids"] = pa.array([raw[4 * x: 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                                  pa.binary())
        return pa.table(out)
    return run


class _Law:
    """How a queue advances over partitions: by ``whole`` + ``part`` / ``steps``
    ids in each, the whole ids of it when a partition ends."""

    def __init__(self, whole: str, part: str, steps: int):
        self.whole, self.part, self.steps = F.col(whole), F.col(part), steps

    def stands(self, k: Column) -> Column:
        """Ids of the queue that come before partition ``k``."""
        return (self.whole * k + self.part * F.floor(k / F.lit(self.steps))
                + F.floor(self.part * (k % F.lit(self.steps)) / F.lit(self.steps)))

    def owed(self, k: Column) -> Column:
        """The fraction of an id that the queue lacks when partition ``k`` begins."""
        return self.part * (k % F.lit(self.steps)) % F.lit(self.steps) / F.lit(float(self.steps))

    def step_of(self, j: Column) -> Column:
        """The smallest partition behind which the queue stands beyond ``j``."""
        whole, steps, after = (x.cast("decimal(19,0)") for x in (self.whole, F.lit(self.steps), j + 1))
        return F.call_function("div", after * steps - 1, F.greatest(whole * steps + self.part, F.lit(1)))

    def steps_of(self, lo: Column, hi: Column) -> Column:
        """The partitions that hold any of the ids ``lo`` to ``hi``: those
        between, or where less than an id goes into each, that of every id."""
        between = F.sequence(self.step_of(lo), self.step_of(hi))
        singly = F.transform(F.sequence(lo, hi), self.step_of)
        return F.when(hi < lo, F.array().cast("array<bigint>")).when(self.whole == 0, singly).otherwise(between)


def pack_mixture(docs: DataFrame, window: int = WINDOW, windows: int = WINDOWS,
                 targets: dict[str, float] | None = None, tokenizer: str | None = None,
                 with_ids: bool = True, **columns) -> DataFrame:
    """One row per piece of a document: its ids from ``start`` on lie in
    sequence ``sequence_id`` from ``offset`` on. ``targets`` gives sources
    weights; those it does not name share what weight a source has on average
    in it; those of weight 0 follow when the others are dry. Without targets,
    weights are the sources' numbers of ids."""
    tokens = reliable_checkpoint(tokenize(docs, tokenizer, **columns), "tokens")
    heads = (tokens.groupBy("source", "part").agg(F.max(F.col("start") + F.col("n")).alias("_n")))
    heads = reliable_checkpoint(running_sum(heads, ["source"], "part", "_n", "_before"), "queue-heads")
    queues = heads.groupBy("source").agg(F.sum("_n").alias("supply"))
    total = queues.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    parts = max(1, round(total / (window * windows)))
    supply = F.col("supply")
    turn = 0  # the first partition of the second law; without targets there is no other
    if targets:
        if min(targets.values()) < 0:
            raise ValueError("weights must not be negative")
        mean = sum(targets.values()) / len(targets)
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")],
                            F.lit(mean)).cast("double")
        all_weights, names = queues.agg(F.sum(weight), F.count("*")).first()
        quantum = weight / F.lit(all_weights or 1.0) * F.lit(float(window * windows))
        queues = queues.withColumn("_a", F.floor(quantum)).withColumn(
            "_r", F.floor((quantum - F.floor(quantum)) * parts))
        first = _Law("_a", "_r", parts)
        turn = queues.filter(quantum * F.lit(MINOR * max(names, 1)) >= F.lit(window * windows)).agg(
            F.coalesce(F.max(first.step_of(supply - 1) + 1), F.lit(0))).first()[0]
        queues = queues.withColumn("_turn", F.least(supply, first.stands(F.lit(turn).cast("long"))))
        rest = queues.agg(F.coalesce(F.sum(supply - F.col("_turn")), F.lit(0))).first()[0]
        later = _Law("_b", "_s", max(1, round(rest / (window * windows))))
    else:
        first = later = _Law("_b", "_s", parts)
        queues = queues.withColumn("_a", F.lit(0)).withColumn("_r", F.lit(0)).withColumn("_turn", F.lit(0).cast("long"))
    left = supply - F.col("_turn")
    queues = (queues.withColumn("_b", F.floor(F.call_function("div", left, F.lit(later.steps))))
              .withColumn("_s", left % F.lit(later.steps)))
    queues = reliable_checkpoint(queues.select("source", "supply", "_a", "_r", "_turn", "_b", "_s"), "queues")

    p, place, at_turn = F.col("p"), F.col("place"), F.col("_turn")

    def stands(k):
        """Ids of the queue that come before partition ``k``."""
        return F.when(k < turn, F.least(supply, first.stands(k))).otherwise(
            F.least(supply, at_turn + later.stands(k - turn)))

    def deal(df, lo, hi):
        """A row for each partition ``p`` that holds any of the ids ``lo`` to ``hi``."""
        by_targets = first.steps_of(lo, F.least(hi, at_turn - 1))
        behind = F.transform(later.steps_of(F.greatest(lo, at_turn) - at_turn, hi - at_turn), lambda x: x + turn)
        return df.withColumn("p", F.explode(F.concat(by_targets, behind) if turn else behind))

    # Where each partition begins in the one sequence of ids.
    steps = (deal(queues.filter("supply > 0"), F.lit(0).cast("long"), supply - 1)
             .groupBy("p").agg(F.sum(stands(p + 1) - stands(p)).alias("_ids")))
    places = reliable_checkpoint(
        running_sum(steps.withColumn("_g", F.lit(0)), ["_g"], "p", "_ids", "at").select("p", "at"), "partitions")

    rows = (tokens.join(heads.select("source", "part", "_before"), ["source", "part"])
            .withColumn("_j", F.col("_before") + F.col("start")).drop("_before", "start", "part")
            .join(queues, "source"))
    rows = (deal(rows, F.col("_j"), F.col("_j") + F.col("n") - 1)
            .withColumn("_from", F.greatest(F.lit(0), stands(p) - F.col("_j")))
            .withColumn("_to", F.least(F.col("n"), stands(p + 1) - F.col("_j"))))
    rows = rows.select(
        "p", "doc_id", "source", (F.col("_j") + F.col("_from")).alias("place"),
        F.col("_from").alias("from"), (F.col("_to") - F.col("_from")).alias("n"),
        F.col("n").alias("doc_tokens"), "width",
        F.substring("ids", (F.col("_from") * F.col("width") + 1).cast("int"),
                    ((F.col("_to") - F.col("_from")) * F.col("width")).cast("int")).alias("ids"),
        F.when(stands(p) >= supply, F.lit(0.0)).when(p < turn, first.owed(p))
        .otherwise(later.owed(p - turn)).alias("owed"))
    schema = _PIECE if with_ids else _PIECE.replace(", source string, ids binary", "")
    return rows.join(places, "p").groupBy("p").applyInArrow(_pack(window, with_ids), schema)


def op4_mixture_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns: windows of 2048 ids."""
    return pack_mixture(docs, with_ids=False)
