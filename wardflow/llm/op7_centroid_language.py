"""Language identification by nearest centroids of n-gram vectors.

A text is the counts of its byte n-grams (1 to 3 bytes, small letters, with
every other run of bytes as one blank) in ``DIMENSIONS`` hashed places, damped
by a logarithm, weighted by inverse document frequency and scaled to length 1.
Each language has up to ``CENTROIDS`` centroids, found by spherical k-means on
a bounded sample (``FIT_ROWS`` rows, dealt in turn to the languages, in the
order of a hash of the id); those that draw texts of other languages are
dropped, but one of each language stays. A text gets the language of the centroid with the
largest cosine. A cosine below the smallest of nearly all sample texts of that
language (their ``REJECT`` quantile, less a margin) marks it as ``rejected``.

Scoring is one pass over whole texts without a shuffle: a batch of texts is a
matrix of counts, times the centroids. Only the centroids are sent to tasks.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if no language was learned. Rows without a language or a
text are not learned from, nor rows without an id; a null id is not held out.
Ties go to the smaller language name. Repeated rows get the same result.
Columns other than the id, the text and the language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import one_text
from wardflow.session import reliable_checkpoint, release

#: Upper bits of an id's hash by which a language's ids are counted.
PART_BITS = 12
FIT_ROWS = 3_000
DIMENSIONS = 4096
CENTROIDS = 3
REJECT = 0.005
MARGIN = 0.05
PURE = 0.98
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_MUL = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - 12)


def letters_low(buf: np.ndarray) -> np.ndarray:
    """A copy in small letters: A-Z, and the Latin-1 capitals."""
    low = A.LOWER[buf]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 32
    return low


def counts(column: pa.Array) -> np.ndarray:
    """n-gram counts: a row of ``DIMENSIONS`` for each text."""
    buf, offsets = A.utf8(column)
    n = len(offsets) - 1
    low = letters_low(buf)
    low[~_LETTER[low]] = 32
    # One blank before and behind each text, and runs of blanks as one.
    low = np.insert(low, np.concatenate([offsets[:-1], offsets[1:]]), 32)
    bounds = offsets + 2 * np.arange(n + 1)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[bounds[:-1]] = True
    text = A.expand(np.diff(bounds))[0][keep]
    low = low[keep].astype(np.uint32)
    out = np.zeros(n * DIMENSIONS, np.int64)
    grams = low + np.uint32(1 << 24)
    for size in (1, 2, 3):
        if size > 1:
            m = len(low) - size + 1
            if m <= 0:
                break
            grams = ((grams[:m] << np.uint32(8)) | low[size - 1:]) & np.uint32((1 << 8 * size) - 1)
            grams = grams | np.uint32(size << 24)
        inside = text[: len(grams)] == text[size - 1:]
        middle = low[size // 2: size // 2 + len(grams)] != 32
        ok = inside & middle
        place = ((grams[ok] * _MUL) >> _SHIFT).astype(np.int64)
        out += np.bincount(text[: len(grams)][ok] * DIMENSIONS + place, minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS)


def has_letter(column: pa.Array) -> np.ndarray:
    buf, offsets = A.utf8(column)
    ascii_ = np.concatenate([[0], np.cumsum((A.LOWER[buf] >= 97) & (A.LOWER[buf] <= 122))])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(map(str.isalpha, buf[offsets[i]: offsets[i + 1]].tobytes().decode()))
    return out


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = c.astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


@dataclass
class Languages:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]            # of each centroid
    limits: dict[str, float]    # cosines below are rejected

    def predict(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        n = len(column)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        cosine = vectors(counts(column), self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        known = has_letter(column)
        score = np.where(known, np.clip(cosine[np.arange(n), best], 0, 1), 0.0).astype(float)
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        limit = np.array([self.limits.get(x, 2.0) for x in names])
        return names, score, score < limit


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from texts at even steps of their cosine
    with the mean (outliers make poor starts: they often mix languages)."""
    order = np.argsort(v @ v.mean(0), kind="stable")
    k = min(k, len(v))
    c = v[order[((np.arange(k) + 0.5) * len(v) / k).astype(int)]]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_centroids(c: np.ndarray, names: list[str], k: int = CENTROIDS) -> Languages:
    full = c.any(1)
    c, own = c[full], np.array(names, object)[full]
    if not len(c):
        return Languages(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS)), [], {})
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32) + 1
    v = vectors(c, idf)
    found, of, limits = [], [], {}
    for name in sorted(set(own)):
        centres = cluster(v[own == name], k)
        found.append(centres)
        of += [name] * len(centres)
    centroids, of = np.concatenate(found), np.array(of, object)
    # A centroid that draws texts of other languages is dropped, unless it is
    # the one that most texts of its language are nearest to.
    near = np.argmax(v @ centroids.T, axis=1)
    stay = np.ones(len(of), bool)
    for j, name in enumerate(of):
        drawn = own[near == j]
        main = max(np.flatnonzero(of == name), key=lambda i: int(((near == i) & (own == of[i])).sum()))
        stay[j] = j == main or (len(drawn) > 0 and (drawn == name).mean() >= PURE)
    centroids, of = centroids[stay], of[stay].tolist()
    for name in sorted(set(of)):
        mine = v[own == name] @ centroids[[x == name for x in of]].T
        limits[name] = float(np.quantile(mine.max(1), REJECT)) - MARGIN
    return Languages(idf, centroids, of, limits)


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches):
    for batch in batches:
        for part in A.slices(batch, "text"):
            # Counts end at 65535: they enter by their logarithm.
            c = np.minimum(counts(part.column("text")), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array([r.tobytes() for r in c])], names=["lang", "c"])


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).alias("text"))
    ident = F.col("_id")
    usable = ident.isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(ident)
    # A language's first ids by hash: ids are counted by the hash's upper bits,
    # and only those of the first parts that hold enough of them are ranked.
    named = (rows.filter(usable).select("_id", "lang").distinct().withColumn("_hash", F.xxhash64("_id"))
             .withColumn("_part", F.shiftright("_hash", 64 - PART_BITS)))
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (named.groupBy("lang", "_part").agg(F.count("*").alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .filter(F.col("_before") < fit_rows).select("lang", "_part"))
    turn = Window.partitionBy("lang").orderBy("_hash", "_id")
    chosen = (named.join(parts, ["lang", "_part"])
              .withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= fit_rows)
              .orderBy("_turn", "lang").limit(fit_rows).select("_id", "lang"))
    # ``chosen`` holds at most ``fit_rows`` rows.
    rows = rows.filter(usable).join(F.broadcast(chosen), ["_id", "lang"])
    sample = (one_text(rows, "_id", "lang").select("lang", "text")
              .mapInArrow(_count, "lang string, c binary"))
    sample = reliable_checkpoint(sample, "language-sample")
    got = sample.orderBy("lang", F.xxhash64("c")).collect()
    release(sample)
    names = [r["lang"] for r in got]
    c = np.frombuffer(b"".join(r["c"] for r in got), "<u2").reshape(len(got), DIMENSIONS)
    del got
    return fit_centroids(c, names, centroids)


def predict_language(docs: DataFrame, model: Languages, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    names, score, rejected = shared.value.predict(some.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                        names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_centroid_language(docs: DataFrame) -> DataFrame:
    """The contract's columns, and whether the text lies far from all it learned."""
    return predict_language(docs, fit_languages(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
