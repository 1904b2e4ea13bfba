"""Quality by histogram gradient-boosted trees over document statistics.

Every text becomes ``len(STATISTICS)`` numbers: shares of kinds of characters,
word lengths, repetition of words and lines, punctuation. The trees are grown
level by level on histograms of at most ``BINS`` bins a statistic, over a
bounded sample of ``FIT_ROWS`` labelled rows (seeded by a hash of the id), with
the logistic loss. A model is five flat arrays (statistic, threshold, left,
right, value) and is applied to a batch by moving all rows of all trees down
one level at a time in numpy. Scoring is one pass over whole texts; only the
arrays are sent to tasks.

Defined results: a null text has the statistics of an empty one and gets their
score. Without labelled rows of both kinds, every score is the share of label
1 among them (0.5 without any). Label rows with nulls are not used; an id
labelled twice has the smaller label. An id that is null is not held out and
never learned from. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import one_text
from wardflow.session import reliable_checkpoint, release

FIT_ROWS = 10_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
THRESHOLD = 0.3

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "long_words", "capitals", "digits", "non_ascii", "spaces",
    "lines", "full_stops", "commas", "exclaims", "bars", "signs", "brackets", "doubled_marks",
    "distinct_words", "same_as_before", "top_word", "capital_words", "marked_ends",
    "words_per_sentence", "distinct_lines", "short_lines",
]


def _kind(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = _kind("0123456789")
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_MARKS = _kind("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_COUNTED = {
    "capitals": _CAPITAL, "digits": _DIGIT, "non_ascii": _HIGH, "spaces": A.SPACE, "lines": _kind("\n"),
    "full_stops": _kind("."), "commas": _kind(","), "exclaims": _kind("!?"), "bars": _kind("|;\t"),
    "signs": _kind("#$%&*+/<=>@\\^_`~"), "brackets": _kind("()[]{}\"'"),
}


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    buf, offsets = A.utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = {}
    per_byte = np.maximum(size, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    for name, table in _COUNTED.items():
        out[name] = per_text(table[buf]) / per_byte
    marks = _MARKS[buf]
    twice = np.zeros(len(buf), bool)
    twice[1:] = marks[1:] & marks[:-1]
    out["doubled_marks"] = per_text(twice) / per_byte
    starts, ends, first = A.runs(A.NOT_SPACE[buf], offsets)
    words, lengths = np.diff(first), ends - starts
    per_word = np.maximum(words, 1)
    text = A.expand(words)[0]
    total = lambda x: np.bincount(text, weights=x, minlength=n)
    h = A.hash_words(A.LOWER[buf], starts, ends)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(words)
    out["mean_word"] = total(lengths) / per_word
    out["long_words"] = total(lengths > 20) / per_word
    out["capital_words"] = total(_CAPITAL[buf[starts]] if len(starts) else lengths) / per_word
    out["marked_ends"] = total(_MARKS[buf[ends - 1]] if len(starts) else lengths) / per_word
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out["same_as_before"] = total(again) / per_word
    stops = per_text(_kind(".!?")[buf])
    out["words_per_sentence"] = words / (stops + 1)
    out["distinct_words"], out["top_word"] = _spread(h, text, n)
    line_starts, line_ends, first_line = A.runs(~_kind("\n\r")[buf], offsets)
    lines = np.diff(first_line)
    line_text = A.expand(lines)[0]
    out["distinct_lines"] = _spread(A.hash_words(buf, line_starts, line_ends), line_text, n)[0]
    out["short_lines"] = np.bincount(line_text, weights=line_ends - line_starts < 30, minlength=n) / np.maximum(lines, 1)
    return np.column_stack([out[s] for s in STATISTICS])


def _spread(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values in each text, and of its commonest value."""
    count = np.bincount(text, minlength=n)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        key, per = np.unique(A.mix(h ^ A.mix(text.astype(A.U64))), return_counts=True, return_index=True)[1:]
        of = text[key]
        distinct = np.bincount(of, minlength=n)
        np.maximum.at(top, of, per)
    return np.where(count > 0, distinct / np.maximum(count, 1), 1.0), top / np.maximum(count, 1)


@dataclass
class Trees:
    """All trees, one after another in flat arrays. A leaf points to itself."""

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            low = x[row, self.statistic[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each statistic's bins, between its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
              ridge: float = 1.0, least: int = 5) -> Trees:
    share = y.mean() if len(y) else 0.5
    empty = [np.zeros(0, np.int64)] * 6
    if share in (0.0, 1.0) or not len(y):
        return Trees(*empty, base=float({0.0: -30, 1.0: 30}.get(float(share), 0.0)), depth=0)
    edges = bin_edges(x)
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    width = max(len(e) for e in edges) + 1
    cell = binned + np.arange(x.shape[1]) * width
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    stat, thr, left, right, value, roots = [], [], [], [], [], []

    def new() -> int:
        for a in (stat, left, right):
            a.append(0)
        thr.append(0.0)
        value.append(0.0)
        left[-1] = right[-1] = len(stat) - 1
        return len(stat) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = new()
        roots.append(root)
        node = np.full(len(y), root)
        level = [root]
        for _ in range(depth):
            place = np.full(len(stat), -1)
            place[level] = np.arange(len(level))
            mine = place[node]
            rows = np.flatnonzero(mine >= 0)
            key = (mine[rows, None] * x.shape[1] * width + cell[rows]).ravel()
            shape = (len(level), x.shape[1], width)
            hist = [np.bincount(key, np.repeat(w[rows], x.shape[1]), int(np.prod(shape))).reshape(shape)
                    for w in (g, h, np.ones(len(y)))]
            gl, hl, nl = (np.cumsum(a, axis=2) for a in hist)
            gt, ht, nt = (a[:, :, -1:] for a in (gl, hl, nl))
            gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            following = []
            for k, parent in enumerate(level):
                s, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k][s, b] <= 1e-6 or b >= len(edges[s]):
                    continue
                lo, hi = new(), new()
                stat[parent], thr[parent], left[parent], right[parent] = int(s), float(edges[s][b]), lo, hi
                inside = node == parent
                node[inside] = np.where(binned[inside, s] <= b, lo, hi)
                following += [lo, hi]
            level = following
            if not level:
                break
        leaf_g, leaf_h = (np.bincount(node, w, len(stat)) for w in (g, h))
        for k in np.unique(node).tolist():
            value[k] = float(-rate * leaf_g[k] / (leaf_h[k] + ridge))
        z += np.array(value)[node]
    return Trees(np.array(stat), np.array(thr), np.array(left), np.array(right), np.array(value),
                 np.array(roots), base, depth)


_STATS = "array<double>"


def _measure(batches):
    for batch in batches:
        for part in A.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(list(statistics(part.column("text"))))], names=["label", "x"])


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> Trees:
    ident = F.col("_id")
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
              .dropna().filter(~held_out(ident)).groupBy("_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    # ``chosen`` holds at most ``fit_rows`` rows.
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "_id"))
    sample = (one_text(rows, "_id", "label").select("label", "text")
              .mapInArrow(_measure, f"label int, x {_STATS}"))
    sample = reliable_checkpoint(sample, "quality-sample")
    rows = sample.orderBy("label", "x").collect()
    release(sample)
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([float(r["label"] > 0) for r in rows]))


def score_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.score(statistics(part.column("text"))))],
                    names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def op6_boosted_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score_quality(docs, fit_quality(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
