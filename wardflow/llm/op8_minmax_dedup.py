"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct word shingles. Under every hash
permutation both the smallest and the largest value are kept, so
``PERMUTATIONS`` evaluations a shingle give twice as many signature values;
each of them agrees between two documents with a probability equal to their
Jaccard similarity, and the two of a permutation are nearly uncorrelated.
Signatures are cut into bands of ``ROWS`` values, of minima and of maxima.
With 15 + 15 bands of four values, a pair at similarity 0.8 shares no band
with probability (1 - 0.8^4)^30 = 1.4e-7.

1. Documents with equal sets become one class, so exact copies never meet.
   Buckets (equal bands) that hold the same classes become one bucket.
2. Classes are linked to the first class of their bucket, confirmed on the
   full sets, and joined into components. Another such round links what is
   left of a bucket to its first and last component. These rounds make as
   many pairs as a bucket has classes.
3. Buckets that still hold several components are searched for further links
   between them, without making their pairs: the classes of a bucket, in
   blocks of ``BLOCK``, meet as matrices of shingle codes of 16 bits, whose
   product bounds every intersection from above. Pairs that reach the
   similarity by that bound are confirmed on the full sets. Pairs inside a
   component need no test, since they change nothing.

In step 2, pairs are dropped before their texts are read if their sizes or
their 240-bit sketches (two bits of every signature value) rule them out.
Sets are compared by 64-bit shingle hashes, all of them. No bucket, group or
text is capped.

Defined results: lower-casing touches A-Z only; words are runs of anything
but ASCII white space. A text of fewer words than a shingle is one shingle; a
text without words, or null, has an empty set and is linked with nothing.
Rows that repeat an id are documents of their own under that id. A row whose
id is null is linked like any other, and is kept only if its whole group has
no id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm.components import components, joined
from wardflow.session import reliable_checkpoint, release

PERMUTATIONS = 60
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Differing bits of two sketches at similarity 0.8: mean 24, deviation 5.6.
SKETCH_BITS = 64

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | A.U64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and
    the size of each text's set."""
    buf, offsets = A.utf8(column)
    low = A.LOWER[buf]
    starts, ends, first = A.runs(A.NOT_SPACE[low], offsets)
    words = A.hash_words(low, starts, ends)
    windows = A.hash_windows(words, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(windows[a: b - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            sets.append(A.hash_windows(words[a:b], b - a) ^ A.U64(b - a))
        else:
            sets.append(words[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, A.U64)), sizes


def min_max(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of each non-empty set under every permutation."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(heads), 2 * PERMUTATIONS), A.U64)
    if len(heads):
        for k in range(PERMUTATIONS):
            v = flat * _MUL[k] + _ADD[k]
            out[:, k] = np.minimum.reduceat(v, heads)
            out[:, PERMUTATIONS + k] = np.maximum.reduceat(v, heads)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), BANDS), A.U64)
    for j in range(BANDS):
        h = np.full(len(values), j + 1, A.U64)
        for k in range(j * ROWS, (j + 1) * ROWS):
            h = A.mix(h ^ values[:, k])
        keys[:, j] = h
    return keys


def sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of each value: 4 words of 60 bits."""
    bits = A.mix(values) & A.U64(3)
    out = np.zeros((len(values), 4), A.U64)
    for k in range(2 * PERMUTATIONS):
        out[:, k // 30] |= bits[:, k] << A.U64(2 * (k % 30))
    return out


_SIGNED = ("doc_id long, text_hash long, n_shingles long, k1 long, k2 long, "
           "s0 long, s1 long, s2 long, s3 long, bands array<long>")


def _sign(size: int):
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                flat, sizes = shingle_sets(part.column("text"), size)
                full = sizes > 0
                values = min_max(flat, sizes)
                heads = (np.cumsum(sizes) - sizes)[full]
                digest = np.zeros((4 + 2, len(sizes)), A.U64)
                if len(heads):
                    digest[0, full] = np.add.reduceat(A.mix(flat), heads)
                    digest[1, full] = np.add.reduceat(A.mix(flat ^ A.U64(0x5BD1E995)), heads)
                    digest[2:, full] = sketches(values).T
                keys = band_keys(values).astype(np.int64).ravel()
                bands = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes),
                     *[pa.array(d.astype(np.int64)) for d in digest], bands],
                    names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "s0", "s1", "s2", "s3",
                           "bands"])
    return run


def _confirm(size: int, similarity: int):
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text_a"):
                fa, na = shingle_sets(part.column("text_a"), size)
                fb, nb = shingle_sets(part.column("text_b"), size)
                ea, eb = np.cumsum(na), np.cumsum(nb)
                keep = np.zeros(len(na), bool)
                for i in range(len(na)):
                    x, y = fa[ea[i] - na[i]: ea[i]], fb[eb[i] - nb[i]: eb[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))],
                    names=["a", "b"])
    return run


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int,
           similarity: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` of classes that are similar enough. The
    sizes and the sketches are compared before any text is read."""
    side = lambda x: classes.select(
        F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in _CLASS])
    fit = pairs.join(side("a"), "a").join(side("b"), "b").filter(_possible(similarity)).select("a", "b")
    both = fit
    for x in ("a", "b"):
        both = both.join(texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x)
    linked = both.select("a", "b", "text_a", "text_b").mapInArrow(
        _confirm(size, similarity), "a long, b long")
    return reliable_checkpoint(linked, "links")


_CLASS = ["n_shingles", "s0", "s1", "s2", "s3"]
BLOCK = 1024
SMALL = 64
BATCH_ROWS = 2000
_COLUMNS = 4096


def _possible(similarity: int):
    na, nb = F.col("n_shingles_a"), F.col("n_shingles_b")
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(4)),
                F.lit(0))
    return (100 * F.least(na, nb) >= similarity * F.greatest(na, nb)) & (apart <= SKETCH_BITS)


def _codes(size: int):
    """Each class's shingles as sorted codes of 16 bits, repeats included."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                flat, sizes = shingle_sets(part.column("text"), size)
                codes = (flat >> A.U64(48)).astype("<u2").tobytes()
                ends = 2 * np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(sizes),
                     pa.array([codes[e - 2 * n: e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)],
                              pa.binary())], names=["node", "n", "codes"])
    return run


def overlap_bounds(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For every two code lists: at least the size of their intersection (the
    sum over codes of the product of their counts)."""
    sizes = np.array([len(x) for x in left + right])
    row = A.expand(sizes)[0]
    code, column = np.unique(np.concatenate(left + right), return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(code), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        m = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        np.add.at(m, (row[a:b], column[a:b] - low), 1)
        total += m[: len(left)] @ m[len(left):].T
    return total


def _between(similarity: int):
    """Pairs of a bucket's block pair that lie in different components and may
    reach the similarity."""
    def run(key, table):
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        table, key = table.take(pa.array(order)), key[order]
        node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        mine, first, second = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        codes = [np.frombuffer(x, "<u2") for x in table.column("codes").to_pylist()]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        out_a, out_b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(lo, hi)
            left, right = at[mine[at] == first[at]], at[mine[at] == second[at]]
            if not len(left) or not len(right):
                continue
            apart = label[left][:, None] != label[right][None, :]
            if first[lo] == second[lo]:
                apart &= left[:, None] < right[None, :]
            x, y = n[left][:, None], n[right][None, :]
            apart &= 100 * np.minimum(x, y) >= similarity * np.maximum(x, y)
            if not apart.any():
                continue
            keep_x, keep_y = apart.any(1), apart.any(0)
            left, right, apart = left[keep_x], right[keep_y], apart[keep_x][:, keep_y]
            most = overlap_bounds([codes[i] for i in left], [codes[i] for i in right])
            x, y = n[left][:, None], n[right][None, :]
            most = np.minimum(most, np.minimum(x, y))
            p, q = np.nonzero(apart & (100 * most >= similarity * (x + y - most)))
            out_a.append(node[left[p]])
            out_b.append(node[right[q]])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(empty + out_a), "b": np.concatenate(empty + out_b)})
    return run


def _unlinked(open_: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Pairs between components of a bucket that may be similar enough."""
    codes = texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(
        _codes(size), "node long, n long, codes binary")
    counts = open_.groupBy("key").agg(F.count("*").alias("m"))
    rows = open_.join(counts, "key").withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row goes to every pair of blocks that its block is one of.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).cast("int").alias("i"), F.greatest(x, F.col("block")).cast("int").alias("j")))
    batches = max(1, counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // BATCH_ROWS)
    # Small buckets share a task's call; this changes nothing but the calls.
    group = F.when(F.col("m") > SMALL, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(batches)))
    rows = rows.select("key", "node", "label", "block", group.alias("g"), F.explode(pair).alias("p"))
    rows = rows.select("key", "node", "label", "block", "g", "p.i", "p.j").join(codes, "node")
    return rows.groupBy("g", "i", "j").applyInArrow(_between(similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, similarity: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id``, ``text_hash``, ``n_shingles``, ``group_id`` (null
    for empty sets), ``component_id`` and ``kept``; ``similarity`` is in per
    cent. ``text_hash`` is ``xxhash64`` of the text and whether the id is null."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text", F.col("doc_id").isNull()))
    signed = reliable_checkpoint(texts.mapInArrow(_sign(size), _SIGNED), "signatures")
    classes = (signed.filter(F.col("n_shingles") > 0).groupBy("k1", "k2", "n_shingles")
               .agg(F.min("doc_id").alias("doc_id"),
                    F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"),
                    *[F.first(f"s{k}").alias(f"s{k}") for k in range(4)],
                    F.first("bands").alias("bands"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = reliable_checkpoint(classes, "classes")

    member = classes.select("node", F.explode("bands").alias("key"))
    buckets = (member.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"),
                                         F.bit_xor(F.xxhash64("node")).alias("x")).filter("n > 1"))
    buckets = buckets.groupBy("n", "first", "x").agg(F.min("key").alias("key")).select("key", "first")
    member = reliable_checkpoint(member.join(buckets, "key"), "buckets")
    wanted = classes.select("node", F.coalesce("doc_id", F.lit(0)).alias("_d"), "text_hash").join(
        member.select("node").distinct(), "node", "left_semi")
    of_node = (texts.withColumn("_d", F.coalesce("doc_id", F.lit(0))).join(wanted, ["_d", "text_hash"])
               .select("node", "text").dropDuplicates(["node"]))
    of_node = reliable_checkpoint(of_node, "class-texts")

    # First round: each class of a bucket with the first one.
    pairs = (member.filter(F.col("node") != F.col("first"))
             .select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    labels = reliable_checkpoint(components(_links(pairs, classes, of_node, size, similarity)), "labels")

    # Second round: what is left of a bucket with its first and last component.
    open_ = _open(member, labels)
    ends = open_.groupBy("key").agg(
        F.min("label").alias("low"), F.min_by("node", "label").alias("low_node"),
        F.max_by("node", "label").alias("high_node"))
    pairs = open_.join(ends, "key").select(
        F.col("node").alias("a"),
        F.when(F.col("label") == F.col("low"), F.col("high_node")).otherwise(F.col("low_node")).alias("b"))
    before, labels = labels, reliable_checkpoint(
        joined(labels, _links(pairs.distinct(), classes, of_node, size, similarity)), "labels")
    release(before)

    # Last round: every link between different components of a bucket.
    open_ = reliable_checkpoint(_open(member, labels), "open-buckets")
    pairs = reliable_checkpoint(_unlinked(open_, of_node, size, similarity), "last-pairs")
    before, labels = labels, reliable_checkpoint(
        joined(labels, _links(pairs, classes, of_node, size, similarity)), "labels")
    release(before, open_, of_node)

    named = labels.join(classes.select("node", "doc_id"), "node")
    least = named.groupBy("label").agg(F.min("doc_id").alias("_least"))
    named = named.select("node", "label").join(least, "label").select("node", "label", "_least")
    of_class = classes.join(named, "node", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("_least", "doc_id").alias("_c"),
        F.coalesce("label", "node").alias("group_id"))
    of_class = reliable_checkpoint(of_class, "class-components")
    return (signed.select("doc_id", "text_hash", "n_shingles", "k1", "k2")
            .join(of_class, ["k1", "k2", "n_shingles"], "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("_c"))
                        .otherwise(F.col("doc_id")))
            .select("doc_id", "text_hash", "n_shingles", "group_id", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def _open(member: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    rows = member.join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label"))
    mixed = (rows.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h"))
             .filter(F.col("_l") != F.col("_h")).select("key"))
    return rows.join(mixed, "key", "left_semi")


def op8_minmax_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns: four-word shingles, similarity 0.8."""
    return near_duplicates(docs, size=4, similarity=80).select(
        "doc_id", "n_shingles", "component_id", "kept")
