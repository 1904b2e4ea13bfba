"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ``WINDOW`` consecutive words of the benchmark
items (an item with fewer words, but some, is one window). They are searched
in every document at once:

* a cursor looks at the last ``block`` words of a possible occurrence and
  reads from a shift table how far it may move: a pair of words that no
  window holds lets it skip a whole window but one word;
* where the shift is 0, the hash of that suffix block selects a bucket of
  windows, and the hash of the whole window the window in the bucket;
* the words' bytes are compared to confirm the occurrence.

Cursors of many stretches of text advance together in numpy; a text is cut
into stretches of ``STRETCH`` window ends, each scanned by one cursor.

The windows are broadcast if the benchmark has no more than ``BLOCK_BYTES`` of
text. Beyond that, what is broadcast is of a fixed size: for each window length
a shift table of ``SLOTS`` entries, and a bitmap of ``BITS`` bits of window
hashes. One scan of the documents walks the same cursors by these tables; a
place where the shift is 0 and the window's bit is set is a candidate, and a
join with the written table of windows, on hash and words, confirms it. So the
documents are scanned once, by one Python stage, whatever the benchmark's size,
and both ways give the same rows. (In a benchmark of many million windows the
tables fill up: cursors skip less and more candidates reach the join.)
Occurrences are counted by text, so copies of a text are joined once.

Defined results: A-Z is lower-cased; words are runs of digits, small letters
and non-ASCII characters. A null or empty document has no words and is clean.
A null or empty item has no windows; items of a null id are named ``null``.
Repeated rows, of documents and items, are treated alike. Columns of the
documents other than the text and ``keep`` are not read; a kept column that is
named like a result comes back as ``<name>_in``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import Carried
from wardflow.session import reliable_checkpoint

WINDOW = 10
STRETCH = 256
BLOCK_BYTES = 2 << 20
SLOTS = 1 << 20
BITS = 1 << 26


def _block_hashes(hashes: np.ndarray, end: int, block: int) -> np.ndarray:
    """Hash of the block that ends before word ``end`` of each window."""
    return A.hash_windows(hashes[:, end - block: end].ravel(), block)[::block]


def _shift_table(hashes: np.ndarray, slots: int) -> np.ndarray:
    """How far a cursor may move behind each block, for windows of one length."""
    length = hashes.shape[1]
    block = min(2, length)
    table = np.full(slots, length - block + 1, np.int64)
    for end in range(block, length + 1):
        np.minimum.at(table, _slot(_block_hashes(hashes, end, block), slots), length - end)
    return table


def _slot(blocks: np.ndarray, slots: int) -> np.ndarray:
    return (blocks >> A.U64(65 - slots.bit_length())).astype(np.int64)


def _stops(table: np.ndarray, length: int, words: np.ndarray, first: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """The words at which a cursor's shift is 0, ascending, with the hashes of
    their blocks. ``first``: offsets of the texts in ``words``."""
    m, block = length, min(2, length)
    counts = np.maximum(first[1:] - first[:-1] - m + 1, 0)
    text, part = A.expand(-(-counts // STRETCH))
    at = first[text] + m - 1 + part * STRETCH
    stop = np.minimum(at + STRETCH, first[text + 1])
    found, suffixes = [np.zeros(0, np.int64)], [np.zeros(0, A.U64)]
    while len(at):
        h = A.mix(words[at]) if block == 1 else A.mix(words[at - 1] * A._MIX1 + words[at])
        step = table[_slot(h, len(table))]
        zero = step == 0
        if zero.any():
            found.append(at[zero])
            suffixes.append(h[zero])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    ends, suffix = np.concatenate(found), np.concatenate(suffixes)
    order = np.argsort(ends)
    return ends[order], suffix[order]


def _windows_at(words: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that end with the given words."""
    rows = words[ends[:, None] - np.arange(length - 1, -1, -1)]
    return A.hash_windows(rows.ravel(), length)[::length]


class Patterns:
    """Windows of one length, with the tables to search them."""

    def __init__(self, length: int, windows: list[bytes], hashes: np.ndarray, items: list[list[str]]):
        """``windows``: distinct texts, words parted by single spaces.
        ``hashes``: their words' hashes, one row each."""
        self.length = length
        self.block = min(2, length)
        whole = A.hash_windows(hashes.ravel(), length)[::length]
        order = np.argsort(whole, kind="stable")
        self.whole = whole[order]
        self.windows = [windows[i] for i in order]
        self.items = [items[i] for i in order]
        bits = max(12, int(np.ceil(np.log2(16 * len(windows) * length))))
        self.shift = _shift_table(hashes, 1 << bits)
        self.suffixes = np.unique(_block_hashes(hashes, length, self.block))

    def search(self, words: np.ndarray, first: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray]:
        """Last word and window of each occurrence. ``first``: offsets of the
        texts in ``words``; ``spelled(i, j)``: words i to j as bytes."""
        m = self.length
        ends, suffix = _stops(self.shift, m, words, first)
        k = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
        ends = ends[self.suffixes[k] == suffix]
        if not len(ends):
            return ends, ends
        whole = _windows_at(words, ends, m)
        k = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
        same = self.whole[k] == whole
        ends, k = ends[same], k[same]
        sure = np.fromiter((spelled(e - m + 1, e) == self.windows[w]
                            for e, w in zip(ends.tolist(), k.tolist(), strict=True)), bool, len(ends))
        return ends[sure], k[sure]


def _words(column: pa.Array):
    buf, offsets = A.utf8(column)
    low = A.LOWER[buf]
    starts, ends, first = A.runs(A.WORD[low], offsets)
    return low, starts, ends, first, A.hash_words(low, starts, ends)


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Search tables of the items' windows, one for each window length."""
    low, starts, ends, first, words = _words(pa.array([t for _, t in items], pa.string()))
    by_length: dict[int, dict[bytes, tuple[int, set]]] = {}
    for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
        m = min(window, b - a)
        if m == 0:
            continue
        spelled = [low[starts[i]: ends[i]].tobytes() for i in range(a, b)]
        group = by_length.setdefault(m, {})
        for i in range(b - a - m + 1):
            group.setdefault(b" ".join(spelled[i: i + m]), (a + i, set()))[1].add(name)
    return [Patterns(m, list(g), words[np.array([i for i, _ in g.values()])[:, None] + np.arange(m)],
                     [sorted(s) for _, s in g.values()])
            for m, g in sorted(by_length.items())]


def _scan(tables, text: str, keep: list[str]):
    """Counts of words and of those in occurrences, and the items found."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                low, starts, ends, first, words = _words(part.column(text))
                spelled = lambda i, j: b" ".join(
                    low[starts[x]: ends[x]].tobytes() for x in range(i, j + 1))
                hit = np.zeros(len(words) + 1, np.int64)
                found = [set() for _ in range(part.num_rows)]
                for p in tables.value:
                    at, which = p.search(words, first, spelled)
                    np.add.at(hit, at - p.length + 1, 1)
                    np.add.at(hit, at + 1, -1)
                    mine = np.searchsorted(first, at, "right") - 1
                    for d, w in np.unique(np.stack([mine, which]), axis=1).T.tolist():
                        found[d].update(p.items[w])
                hits = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])[first]
                cols = {c: part.column(c) for c in keep}
                cols["_items"] = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
                cols["_words"] = pa.array(np.diff(first))
                cols["_hits"] = pa.array(np.diff(hits), pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def _windows(window: int):
    """Every window of the items: length, hash, words, item."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                low, starts, ends, first, words = _words(part.column("text"))
                spelled = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                size = np.minimum(np.diff(first), window)
                row, k = A.expand(np.where(size > 0, np.diff(first) - size + 1, 0))
                at, size = first[row] + k, size[row]
                h = np.zeros(len(at), A.U64)
                for m in np.unique(size).tolist():
                    h[size == m] = _windows_at(words, at[size == m] + m - 1, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size.astype(np.int32)), pa.array(h.astype(np.int64)),
                     pa.array([b" ".join(spelled[i: i + m]) for i, m in zip(at.tolist(), size.tolist(), strict=True)],
                              pa.binary()), part.column("item").take(pa.array(row))],
                    names=["m", "h", "window", "item"])
    return run


def _shifts(batches):
    """The entries of one task's shift tables that windows have lowered."""
    tables: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column("m").to_numpy()
        for m in np.unique(sizes).tolist():
            mine = batch.filter(pa.array(sizes == m)).column("window").cast(pa.string())
            table = _shift_table(_words(mine)[4].reshape(-1, m), SLOTS)
            tables[m] = np.minimum(tables[m], table) if m in tables else table
    for m, table in tables.items():
        slot = np.flatnonzero(table < m - min(2, m) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(slot), m, np.int32)), pa.array(slot.astype(np.int32)),
             pa.array(table[slot].astype(np.int32))], names=["m", "slot", "shift"])


class Sieve:
    """Shift tables and a bitmap of window hashes, of a fixed size."""

    def __init__(self, shifts: pa.Table, bitmaps: pa.Table):
        m, slot, shift = (shifts.column(c).to_numpy() for c in ("m", "slot", "shift"))
        self.shifts = {}
        for length in np.unique(m).tolist():
            table = np.full(SLOTS, length - min(2, length) + 1, np.int8)
            table[slot[m == length]] = shift[m == length]
            self.shifts[length] = table
        self.bits = np.zeros(BITS // 8, np.uint8)
        for bucket, bits in zip(bitmaps.column("bucket").to_pylist(), bitmaps.column("bits").to_pylist(), strict=True):
            self.bits[(bucket - 1) * len(bits): bucket * len(bits)] = np.frombuffer(bits, np.uint8)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last word, length and hash of every candidate, by last word."""
        at, size, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, A.U64)]
        for m, table in self.shifts.items():
            ends, _ = _stops(table, m, words, first)
            h = _windows_at(words, ends, m) if len(ends) else hashes[0]
            place = (h & A.U64(BITS - 1)).astype(np.int64)
            fit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at.append(ends[fit])
            size.append(np.full(int(fit.sum()), m))
            hashes.append(h[fit])
        at, size, hashes = map(np.concatenate, (at, size, hashes))
        order = np.argsort(at, kind="stable")
        return at[order], size[order], hashes[order]


def _candidates(sieve, text: str, keep: list[str]):
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                low, starts, ends, first, words = _words(part.column(text))
                at, size, h = sieve.value.search(words, first)
                spelled = [b" ".join(low[starts[x]: ends[x]].tobytes() for x in range(i - m + 1, i + 1))
                           for i, m in zip(at.tolist(), size.tolist(), strict=True)]
                doc = np.searchsorted(first, at, "right") - 1
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                cols = {c: part.column(c) for c in keep}
                cols["_words"] = pa.array(np.diff(first))
                cols["_found"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(at - first[doc]), pa.array(size.astype(np.int32)), pa.array(h.astype(np.int64)),
                     pa.array(spelled, pa.binary())], names=["at", "m", "h", "window"]))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def _by_join(own: Carried, items: DataFrame, window: int) -> DataFrame:
    """The rows' kept columns, ``_words``, ``_hits`` and ``_items``, for a
    benchmark of any size."""
    spark = items.sparkSession
    windows = reliable_checkpoint(items.mapInArrow(
        _windows(window), "m int, h long, window binary, item string").distinct(), "benchmark-windows")
    same = ["m", "h", "window"]
    patterns = windows.select(*same).distinct()
    # At most SLOTS rows for each length up to ``window``, and BITS bits.
    shifts = (patterns.select("m", "window").mapInArrow(_shifts, "m int, slot int, shift int")
              .groupBy("m", "slot").agg(F.min("shift").alias("shift")).toArrow())
    place = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    bitmaps = (windows.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow())
    sieve = spark.sparkContext.broadcast(Sieve(shifts, bitmaps))
    keep = [*own.keep, "_key"]
    rows = reliable_checkpoint(
        own.rows.withColumn("_key", F.unhex(F.md5(F.col(own.text)))).mapInArrow(
            _candidates(sieve, own.text, keep),
            ", ".join([own.schema] * bool(own.keep) + [
                "_key binary", "_words long",
                "_found array<struct<at: long, m: int, h: long, window: binary>>"])), "benchmark-candidates")
    found = rows.filter(F.size("_found") > 0).select("_key", F.inline("_found")).distinct()
    sure = reliable_checkpoint(found.join(patterns, same, "left_semi"), "benchmark-occurrences")
    # Words in any occurrence: what each adds to those that begin before it.
    before = Window.partitionBy("_key").orderBy("lo", "at").rowsBetween(Window.unboundedPreceding, -1)
    known = F.greatest(F.coalesce(F.max("at").over(before), F.lit(-1)), F.col("lo") - 1)
    hits = (sure.withColumn("lo", F.col("at") - F.col("m") + 1)
            .withColumn("new", F.greatest(F.lit(0), F.col("at") - known))
            .groupBy("_key").agg(F.sum("new").alias("_hits")))
    names = (sure.select("_key", *same).distinct().join(windows, same)
             .groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("_items")))
    return (rows.drop("_found").join(hits, "_key", "left").join(names, "_key", "left")
            .withColumn("_hits", F.coalesce("_hits", F.lit(0)))
            .withColumn("_items", F.coalesce("_items", F.array().cast("array<string>"))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       keep: list[str] | None = None, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs``, with ``n_words``,
    ``n_hit`` and ``items`` (the sorted names of the items found).
    ``block_bytes``: the largest benchmark whose windows are broadcast."""
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else list(keep)
    own = Carried(docs, keep, text_col, ["n_words", "n_hit", "items"])
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text_col).alias("text")).filter("text is not null").distinct()
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > block_bytes:
        out = _by_join(own, items, window)
    else:
        tables = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in items.collect()], window))
        out = own.rows.mapInArrow(_scan(tables, own.text, own.keep), ", ".join(
            [own.schema] * bool(keep) + ["_items array<string>", "_words long", "_hits long"]))
    return out.select(*own.back(out), F.col("_words").alias("n_words"), F.col("_hits").alias("n_hit"),
                      F.col("_items").alias("items"))


def op5_wu_manber(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
