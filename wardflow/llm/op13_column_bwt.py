"""Repeated byte strings by column-wise construction of a collection's BWT.

Each byte that is covered by a string of ``LENGTH`` bytes which also starts
anywhere else is removed, in all its places. Three steps:

**Reads.** A string of LENGTH bytes (a *window*) has an anchor: the leftmost
of its ``GRAM``-byte grams with the smallest hash. Consecutive windows with the
same anchor make one *read*, a string of at most 2 LENGTH - GRAM bytes in which
the anchor's place is known. Equal windows have equal anchors, at the same
place in them, so windows can be equal only within reads of the same anchor
hash, and reads of an anchor hash that occurs once hold nothing. A read goes on
as 128 bits of its content; equal reads are counted before they are shuffled,
however many copies there are. All windows of a read that occurs twice occur
twice. No two windows of one read are equal.

**Columns.** What is left are groups of different reads with the same anchor
hash, of which some occur once. Their bytes are fetched, and the groups are
laid out as a matrix, one read a line, all anchors in the same columns. The
matrix is read column by column, from the right: each round inserts one symbol
of every read before the suffix that it has so far. The symbols in front of the
sorted suffixes are the Burrows-Wheeler transform of that column; sorting the
suffixes stably by them gives the next column's order, and the common prefix of
two neighbours there is one more than the smallest common prefix between their
places here (0 if their symbols differ). Only the last column's transform,
order and common prefixes are kept; each is read once, in sequence. Equal
windows lie in the same column, so a window repeats if its suffix shares LENGTH
symbols with a neighbour of its column. Comparing suffixes of different columns,
as a transform over all columns at once would, is not needed.

A group of more than ``GROUP_ROWS`` reads (a passage that very many documents
hold, each with something else before it) is not laid out: its windows are
dealt out singly, by 128 bits of their content, and counted.

**Cut.** The windows found are gathered for each document, and their bytes cut.
Between the steps the tables of reads are written files in the shared folder,
read in sequence; nothing is kept in a task but a batch of texts or one bin of
groups (about ``BIN_ROWS`` reads, at most ``GROUP_ROWS`` more).

Defined results: a null text is empty. Matches stay within a document; they may
overlap, also themselves. Repeated rows are documents of their own, so each is
the other's repetition; rows without an id, or that share one, are told apart by
128 bits of their text. Texts shorter than LENGTH stay whole. Bytes are cut
without regard to characters. Columns that clash with results and are kept come
back as ``<name>_in``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import Carried
from wardflow.session import reliable_checkpoint

LENGTH = 400
GRAM = 32
GROUP_ROWS = 20_000
BIN_ROWS = 4_000
#: Windows of a text that are handled at once.
PIECE = 1 << 20
#: Low bits that hold a place in a piece.
PLACE_BITS = 21
U64 = np.uint64


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a multiple of 8) from every place."""
    n = max(0, len(buf) - gram + 1)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(n, U64)
    for k in range(0, gram, 8):
        out ^= eight[k: k + n]
        out *= A._MIX1
        out ^= out >> U64(29)
    return A.mix(out)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    done, size = values, 1
    while 2 * size <= width:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    rest = width - size
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def reads_of(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Reads of texts laid out in ``buf``: text, start, number of windows,
    anchor hash, and the anchor's distance from the start. A piece of at most
    PIECE windows is handled at a time; a read that is cut there is two."""
    out = [[] for _ in range(5)]
    for piece in range(0, max(0, len(buf) - length + 1), PIECE):
        part = buf[piece: piece + PIECE + length - 1]
        hashes = gram_hashes(part, gram)
        # The place in the low bits: the leftmost of equal grams is the least.
        low = U64((1 << PLACE_BITS) - 1)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
        anchor = (least_in_windows(keyed, length - gram + 1) & low).astype(np.int64)
        start = np.arange(len(anchor)) + piece
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[text + 1]
        start, text, anchor = start[inside], text[inside], anchor[inside]
        if not len(start):
            continue
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        for col, x in zip(out, (text[first], start[first] - offsets[text[first]], np.diff(np.r_[first, len(start)]),
                                hashes[anchor[first]], anchor[first] + piece - start[first]), strict=True):
            col.append(x)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each string, as two longs."""
    view = memoryview(np.ascontiguousarray(buf))
    joined = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest()
                      for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


#: ``place`` is the text's key; ``times`` places from ``start`` on hold a read
#: of ``windows`` windows, whose anchor lies ``lead`` bytes behind its start.
READ = "h long, s1 long, s2 long, doc_id long, u1 long, u2 long, start int, windows int, times int, lead int"


def _reads(length: int, gram: int):
    def run(batches):
        for whole in batches:
            for batch in A.slices(whole, "text"):
                buf, offsets = A.utf8(batch.column("text"))
                text, start, windows, h, lead = reads_of(buf, offsets, length, gram)
                at = offsets[text] + start
                s = digests(buf, at, at + windows + (length - 1))
                # Equal reads that follow each other (a row of one character)
                # are one record.
                same = np.zeros(len(text), bool)
                same[1:] = ((s[1:] == s[:-1]).all(1) & (text[1:] == text[:-1]) & (windows[1:] == 1) & (windows[:-1] == 1)
                            & (start[1:] == start[:-1] + 1))
                first = np.flatnonzero(~same)
                times = np.diff(np.r_[first, len(text)])
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[first].view(np.int64)), pa.array(s[first, 0]), pa.array(s[first, 1]),
                     *[batch.column(c).take(of) for c in ("doc_id", "u1", "u2")],
                     *[pa.array(x[first].astype(np.int32)) for x in (start, windows)], pa.array(times.astype(np.int32)),
                     pa.array(lead[first].astype(np.int32))],
                    names=["h", "s1", "s2", "doc_id", "u1", "u2", "start", "windows", "times", "lead"])
    return run


class Columns:
    """Order of the reads by their suffixes from one column on, and the common
    prefixes of neighbours. ``lines[c]`` holds column c of all reads as numbers
    from 1; 0 stands where a read has no symbol and matches nothing."""

    def __init__(self, lines: np.ndarray):
        self.lines = lines
        n = lines.shape[1]
        self.order, self.common = np.arange(n), np.zeros(n + 1, np.int16)

    def insert(self, column: int) -> None:
        """Put each read's symbol of this column before its suffix."""
        transform = self.lines[column][self.order]
        to = np.argsort(transform, kind="stable")
        # Smallest common prefix between the former places of new neighbours.
        between = np.minimum.reduceat(self.common, to + 1)[:-1]
        sorted_ = transform[to]
        alike = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0)
        self.common[1:-1] = np.where(alike, between + 1, 0)
        self.order = self.order[to]

    def sharing(self, length: int) -> np.ndarray:
        """Reads that share ``length`` symbols with a neighbour."""
        long = self.common >= length
        return self.order[long[:-1] | long[1:]]


def repeated_windows(texts: list[bytes], leads: np.ndarray, length: int = LENGTH,
                     gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(read, start) of the windows that another of these reads holds too;
    ``leads`` are the distances of their anchors from their starts."""
    side = length - gram
    lines = np.zeros((len(texts), 2 * length - gram), np.int16)
    for line, text, lead in zip(lines, texts, leads.tolist(), strict=True):
        line[side - lead: side - lead + len(text)] = np.frombuffer(text, np.uint8)
        line[side - lead: side - lead + len(text)] += 1
    columns, found = Columns(np.ascontiguousarray(lines.T)), []
    for c in range(len(columns.lines) - 1, -1, -1):
        columns.insert(c)
        if c <= side:
            rows = columns.sharing(length)
            found.append(np.stack([rows, c - side + leads[rows]]))
    read, start = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    order = np.lexsort((start, read))
    return read[order], start[order]


PLACE = ["doc_id", "u1", "u2"]
MARK = "doc_id long, u1 long, u2 long, start int, windows int"


def _bin(length: int, gram: int):
    def run(key, table):
        texts = table.column("bytes").to_pylist()
        read, start = repeated_windows(texts, table.column("lead").to_numpy(), length, gram)
        once = table.column("n").to_numpy() == 1
        read, start = read[once[read]], start[once[read]]
        first = np.flatnonzero(np.r_[True, (read[1:] != read[:-1]) | (start[1:] != start[:-1] + 1)][: len(read)])
        of = pa.array(read[first])
        begin = table.column("start").to_numpy()[read[first]] + start[first]
        return pa.table([*[table.column(c).take(of) for c in PLACE], pa.array(begin.astype(np.int32)),
                         pa.array(np.diff(np.r_[first, len(read)]).astype(np.int32))],
                        names=[*PLACE, "start", "windows"])
    return run


def _fetch(length: int):
    """The bytes of the wanted reads of each text."""
    fields = ["h", "n", "rows", "start", "windows", "lead"]

    def run(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            of = pa.array(np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False)))
            items = dict(zip(fields, wanted.flatten().flatten(), strict=True))
            texts = [t.as_py().encode() for t in batch.column("text")]
            cut = [texts[i][a: a + w + length - 1] for i, a, w in zip(
                of.to_pylist(), items["start"].to_pylist(), items["windows"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(of) for c in PLACE], *[items[c] for c in fields], pa.array(cut, pa.binary())],
                names=[*PLACE, *fields, "bytes"])
    return run


def _single(length: int):
    """Every window of a read by its content."""
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                buf = np.frombuffer(text, np.uint8)
                n = len(buf) - length + 1
                of = pa.array(np.full(n, i))
                w = digests(buf, np.arange(n), np.arange(n) + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), *[batch.column(c).take(of) for c in [*PLACE, "n"]],
                     pa.array((np.arange(n) + batch.column("start")[i].as_py()).astype(np.int32))],
                    names=["w1", "w2", *PLACE, "n", "start"])
    return run


def _cut(length: int, names: list[str], text_name: str):
    """Without the marked bytes: what is left, and the digest of the cut."""
    def run(batches):
        for batch in batches:
            marks = batch.column("marks")
            lengths = np.nan_to_num(np.asarray(marks.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            starts, windows = (x.to_numpy(zero_copy_only=False) for x in marks.flatten().flatten())
            at = np.r_[0, np.cumsum(lengths)]
            out = [[] for _ in range(5)]
            for i, text in enumerate(batch.column(text_name)):
                raw = (text.as_py() or "").encode()
                a, w = starts[at[i]: at[i + 1]], windows[at[i]: at[i + 1]]
                order = np.argsort(a, kind="stable")
                a, z = a[order].astype(np.int64), (a + w + (length - 1))[order]
                reach = np.maximum.accumulate(z) if len(z) else z
                # A run ends where the next mark begins behind all before it.
                new = np.r_[True, a[1:] > reach[:-1]][: len(a)]
                begin, end = a[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1][: new.sum()]]
                left = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
                for col, x in zip(out, (len(raw), len(raw) - len(left), len(begin), hashlib.sha256(left).hexdigest(),
                                        left), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(c, pa.int64()) for c in out[:3]],
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
    return run


def repeated_marks(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   bin_rows: int = BIN_ROWS) -> DataFrame:
    """``doc_id, u1, u2, start, windows``: runs of window starts whose windows
    occur elsewhere too. ``texts``: ``doc_id, u1, u2, text``."""
    reads = reliable_checkpoint(texts.mapInArrow(_reads(length, gram), READ), "reads")
    counted = reads.groupBy("s1", "s2").agg(
        F.sum(F.col("times").cast("long")).alias("n"),
        *[F.first(c).alias(c) for c in ("h", *PLACE, "start", "windows", "lead")])
    counted = reliable_checkpoint(counted, "counted-reads")
    # Reads that occur twice are marked whole, wherever they are.
    twice = counted.filter("n > 1").select("s1", "s2")
    marks = reads.join(twice, ["s1", "s2"], "left_semi").select(
        *PLACE, "start", (F.col("windows") + F.col("times") - 1).alias("windows"))
    # Groups of different reads around the same anchor.
    groups = (counted.groupBy("h").agg(F.count("*").alias("rows"), F.min("n").alias("least"))
              .filter("rows > 1 AND least = 1").select("h", "rows"))
    wanted = counted.join(groups, "h")
    listed = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct(
        "h", "n", "rows", "start", "windows", "lead")).alias("wanted"))
    known = F.coalesce(F.col("doc_id"), F.lit(0))
    one = texts.withColumn("_k", known).groupBy("_k", "u1", "u2").agg(F.first("text").alias("text"))
    fetched = one.join(listed.withColumn("_k", known), ["_k", "u1", "u2"]).select(*PLACE, "text", "wanted").mapInArrow(
        _fetch(length), "doc_id long, u1 long, u2 long, h long, n long, rows long, start int, windows int, lead int, bytes binary")
    fetched = reliable_checkpoint(fetched, "fetched-reads")
    small = F.col("rows") <= group_rows
    bins = max(1, -(-fetched.filter(small).count() // bin_rows))
    laid = (fetched.filter(small).withColumn("bin", F.pmod(F.xxhash64("h"), F.lit(bins)))
            .drop("h", "rows", "windows"))
    marks = marks.unionByName(laid.groupBy("bin").applyInArrow(_bin(length, gram), MARK))
    single = fetched.filter(~small).mapInArrow(
        _single(length), "w1 long, w2 long, doc_id long, u1 long, u2 long, n long, start int")
    shared = single.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1")
    marks = marks.unionByName(single.filter("n = 1").join(shared, ["w1", "w2"], "left_semi").select(
        *PLACE, "start", F.lit(1).alias("windows")))
    return marks


def remove_repeated_bytes(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
                          text_col: str = "text", **how) -> DataFrame:
    """The ``keep`` columns (default: the id) with ``n_bytes, n_removed,
    n_spans, kept_sha256`` and ``kept_bytes``, what is left of the text."""
    keep = [id_col] if keep is None else keep
    carried = Carried(docs, keep, text_col, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # 128 bits of the text: two hashes with different beginnings.
    key = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("u1"),
           F.xxhash64(F.lit(1), text).alias("u2")]
    marks = repeated_marks(docs.select(*key, text.alias("text")), **how)
    # Without an id the place is 0 here; the text's hashes tell.
    at = F.coalesce(F.col("doc_id"), F.lit(0)).alias("_i")
    marks = marks.groupBy(at, "u1", "u2").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    rows = docs.select(*carried.columns, key[0].alias("doc_id"), *key[1:]).withColumn("_i", at).drop("doc_id")
    cut = rows.join(marks, ["_i", "u1", "u2"], "left").select(
        *carried.keep, *([] if text_col in keep else [carried.text]), "marks").mapInArrow(
        _cut(how.get("length", LENGTH), carried.keep, carried.text),
        ", ".join([*([carried.schema] if keep else []),
                   "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"]))
    return cut.select(*carried.back(cut), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")


def op13_column_bwt(documents: DataFrame) -> DataFrame:
    """The contract's columns, for strings of 400 bytes."""
    return remove_repeated_bytes(documents).drop("kept_bytes")
