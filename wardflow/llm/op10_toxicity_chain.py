"""Toxicity by a classifier chain over categories.

Documents are described by the presence of words and word beginnings (4, 5
and 6 bytes). From a bounded, seeded sample of labelled rows (``FIT_ROWS``),
the ``FEATURES`` most telling ones are kept, by the chi-square statistic. The
labels name no kinds of toxicity, so categories are found: features that mark
toxic documents are clustered by the documents they share, and a toxic
document belongs to the categories whose features it holds. (``fit_chain``
takes any label columns.)

The chain predicts the categories one after another and toxicity last. Each
link is a logistic regression on the features and on the probabilities of the
links before it. In training, those probabilities are out-of-fold predictions,
so that later links learn from errors of the size they will meet.

The fit needs only the sample; scoring is one pass over whole texts without a
shuffle. Only the kept features and the weights are sent to tasks.

Defined results: words are runs of digits, letters and non-ASCII characters,
A-Z lower-cased. A null or empty text holds no features and gets the score of
that. If the labels hold no toxic (or no clean) row that is in the table,
every score is 0 (or 1). Label rows with nulls are not used; an id labelled
twice is toxic if one of its labels says so. Repeated rows are scored alike.
Columns other than the id, the text and ``keep`` are not read; a kept column
that is named like a result comes back as ``<name>_in``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import Carried, one_text
from wardflow.session import reliable_checkpoint, release

FIT_ROWS = 8_000
FEATURES = 256
CATEGORIES = 3
FOLDS = 5
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6)


def feature_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the features in each text, with repeats, and their texts."""
    buf, offsets = A.utf8(column)
    low = A.LOWER[buf]
    starts, ends, first = A.runs(A.WORD[low], offsets)
    text = A.expand(np.diff(first))[0]
    keys, texts = [A.hash_words(low, starts, ends)], [text]
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        v = eight[starts[at]] & A.U64((1 << 8 * k) - 1)
        keys.append(A.mix(v * A._MIX1 + A.U64(k)))
        texts.append(text[at])
    return np.concatenate(keys), np.concatenate(texts)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 8) -> np.ndarray:
    """Weights, the last being the intercept, by damped Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(x1.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x1 @ w)
        g = x1.T @ (p - y) + penalty * w
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x1.T * s) @ x1 + np.diag(penalty), g)
        w -= step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector per label column, in chain order."""
    fold = np.arange(len(x)) % folds
    links = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        links.append(fit_logistic(x, y))
        if k + 1 < labels.shape[1]:
            out = np.empty(len(x))
            for f in range(folds):
                out[fold == f] = _apply(fit_logistic(x[fold != f], y[fold != f]), x[fold == f])
            x = np.column_stack([x, out])
    return links


def apply_chain(links: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of all links, one column each."""
    n = x.shape[1]
    for w in links:
        x = np.column_stack([x, _apply(w, x)])
    return x[:, n:]


@dataclass
class Toxicity:
    keys: np.ndarray            # of the features, sorted
    links: list                 # weights; empty: every score is ``constant``
    constant: float = 0.0
    width: int = 1

    def matrix(self, column: pa.Array) -> np.ndarray:
        x = np.zeros((len(column), len(self.keys)))
        keys, texts = feature_keys(column)
        if len(keys) and len(self.keys):
            bits = A.U64(64 - 16)
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.keys >> bits).astype(np.int64)] = True
            near = maybe[(keys >> bits).astype(np.int64)]
            keys, texts = keys[near], texts[near]
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[k] == keys
            x[texts[same], k[same]] = 1
        return x

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.links:
            return np.full((len(column), self.width), self.constant)
        return apply_chain(self.links, self.matrix(column))


def find_categories(x: np.ndarray, toxic: np.ndarray, categories: int) -> np.ndarray:
    """Category columns for the rows of ``x``, most frequent first: clusters
    of the features that speak for toxicity, by the toxic rows they share."""
    inside, outside = x[toxic], x[~toxic]
    lift = inside.mean(0) / (outside.mean(0) + 1 / max(1, len(outside)))
    telling = np.flatnonzero((lift > 10) & (inside.sum(0) > 0))
    if not len(telling):
        return np.zeros((len(x), 0), bool)
    rows = inside[:, telling].T
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    centres = [rows[np.argmax(inside[:, telling].sum(0))]]
    while len(centres) < min(categories, len(telling)):
        centres.append(rows[np.argmin(np.max(rows @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(10):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.array([rows[own == c].sum(0) if (own == c).any() else centres[c]
                         for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    member = np.array([(x[:, telling[own == c]].sum(1) > 0) & toxic for c in range(len(centres))]).T
    return member[:, np.argsort(-member.sum(0), kind="stable")]


def _sample_keys(batches):
    for batch in batches:
        for part in A.slices(batch, "text"):
            keys, texts = feature_keys(part.column("text"))
            order = np.lexsort((keys, texts))
            keys, texts = keys[order], texts[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
            keys, texts = keys[new], texts[new]
            offsets = np.searchsorted(texts, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.ListArray.from_arrays(offsets, pa.array(keys.astype(np.int64)))],
                names=["toxic", "keys"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
                 features: int = FEATURES, categories: int = CATEGORIES,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
              .dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    # ``chosen`` holds at most ``fit_rows`` rows.
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "_id"))
    sample = one_text(rows, "_id", "toxic").select("toxic", "text")
    sample = reliable_checkpoint(sample.mapInArrow(_sample_keys, "toxic int, keys array<long>"), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n1 in (0, n):
        release(sample)
        return Toxicity(np.zeros(0, A.U64), [], float(bool(n1)), 1 + categories)
    a, b = F.col("t").cast("double"), (F.col("c") - F.col("t")).cast("double")
    chi = (F.pow(a * F.lit(float(n - n1)) - b * F.lit(float(n1)), 2)
           / (F.col("c").cast("double") * (F.lit(float(n)) - F.col("c") + F.lit(1.0))))
    top = (sample.select("toxic", F.explode("keys").alias("key"))
           .groupBy("key").agg(F.sum("toxic").alias("t"), F.count("*").alias("c"))
           .orderBy(chi.desc(), "key").limit(features))
    keys = np.sort(np.array([r["key"] for r in top.select("key").collect()], np.int64).astype(A.U64))
    wanted = F.array(*[F.lit(int(k)) for k in keys.astype(np.int64)])
    rows = sample.select("toxic", F.array_sort(F.array_intersect("keys", wanted)).alias("keys")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["keys"]))  # the same order in every run
    release(sample)
    x = np.zeros((len(rows), len(keys)))
    toxic = np.array([r["toxic"] > 0 for r in rows])
    for i, r in enumerate(rows):
        x[i, np.searchsorted(keys, np.array(r["keys"], np.int64).astype(A.U64))] = 1
    shuffle = np.random.default_rng(7).permutation(len(x))
    x, toxic = x[shuffle], toxic[shuffle]
    y = np.column_stack([find_categories(x, toxic, categories), toxic])
    return Toxicity(keys, fit_chain(x, y), 0.0, y.shape[1])


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD,
                   keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, with ``toxicity`` (the last link's
    probability), ``category_scores`` (the links before it) and ``rejected``."""
    keep = ["doc_id"] if keep is None else list(keep)
    own = Carried(docs, keep, text_col, ["toxicity", "category_scores", "rejected"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, text = own.keep, own.text

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                p = shared.value.scores(part.column(text))
                cols = {c: part.column(c) for c in names}
                cols["_p"] = pa.array(p[:, -1])
                cols["_links"] = pa.array(list(p[:, :-1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = own.rows.mapInArrow(run, ", ".join(
        [own.schema] * bool(keep) + ["_p double", "_links array<double>"]))
    return out.select(*own.back(out), F.col("_p").alias("toxicity"), F.col("_links").alias("category_scores"),
                      (F.col("_p") >= F.lit(threshold)).alias("rejected"))


def op10_toxicity_chain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's category probabilities, toxicity and decision."""
    return score_toxicity(docs, fit_toxicity(docs, labels))
