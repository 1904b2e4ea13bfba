"""Source divergence audit with a frequent-pattern tree of term rows.

Per language, every term found in at least ``LEAST_DOCS`` of its documents is
kept. Each (language, source) group, and each language, gives each of the V
kept terms a smoothed share in billionths, ``p``; two shares diverge by
``f = floor((p - q)^2 / (p + q))``. Reported are, per group, the sum of ``f``
against every other source of the language, and the terms that it uses more
than the language does.

The sum over all terms of a pair of sources (a, b) is taken apart: let p0 be a
source's share of a term that it does not use. Then

    sum f(p_a, p_b) = V f(p0_a, p0_b)
                    + over the terms of a:     f(p_a, p0_b) - f(p0_a, p0_b)
                    + over the terms of b:     f(p0_a, p_b) - f(p0_a, p0_b)
                    + over the terms of both:  f(p_a, p_b) - f(p_a, p0_b)
                                               - f(p0_a, p_b) + f(p0_a, p0_b)

The second and third line need the histogram of a source's shares only. The
last is a sum over pairs of nonzero counts of a term, and there the tree
works: a term's nonzero shares in source order are a path; equal paths are
aggregated with their multiplicity; paths that begin alike share nodes. A node
carries the number of terms that pass it, and its correction with each of its
ancestors is computed once, times that number.

The tree is spread by path: distinct paths are range-partitioned and sorted, so
that paths with a common beginning meet, whatever share of them one beginning
has. Each task inserts its sorted paths a batch at a time: a path's new nodes
are those behind the common prefix with its forerunner. A node that is cut by a
batch's end is two nodes, whose corrections add up to the same. A batch
answers with one sum for each pair of sources.

Counting is pre-aggregated in the scanning tasks (numpy over a few megabytes of
text at a time, terms told apart by a 64-bit hash inside such a piece), so that
no frequent term and no large source is a hot key. All arithmetic is on whole numbers: shares by
decimal division, ``f`` and sums in 64 bits (``f`` is at most a billion and one).

Defined results: null text, language and source are read as ''. A group
without kept terms has count 0 everywhere; a language without kept terms has
pairs of value 0 and no term rows. Repeated rows count as often as they occur.
Ties go by the item's UTF-8 bytes. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.session import reliable_checkpoint

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True
#: Text that is counted at once in a task.
PIECE_BYTES = 6 << 20
#: Node-ancestor combinations that are handled at once in a task.
COMBINATIONS = 1 << 20


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)); null without terms."""
    of = (total + 2 * terms).cast("decimal(20,0)")
    part = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    # ``div`` is the exact whole quotient.
    return F.when(of > 0, F.lit(1) + F.call_function("div", part, of))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _batch_counts(lang, source, text) -> pa.RecordBatch:
    """Counts of a batch's terms by language and source, and in how many of
    its documents they occur."""
    buf, offsets = A.utf8(text)
    buf = A.LOWER[buf]
    starts, ends, cuts = A.runs(LETTER[buf], offsets)
    hashed, row = A.hash_words(buf, starts, ends), np.repeat(np.arange(len(text)), np.diff(cuts))
    (lang, langs), (source, sources) = _codes(lang), _codes(source)
    group = (lang * (len(sources) + 1) + source)[row]
    order = np.lexsort((row, group, hashed))
    hashed, group, row = hashed[order], group[order], row[order]
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (group[1:] != group[:-1])][: len(order)]
    new_doc = new | np.r_[True, row[1:] != row[:-1]][: len(order)]
    first = np.flatnonzero(new)
    docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    a, z = starts[order[first]], ends[order[first]]
    which, i = A.expand(z - a)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(z - a)].astype(np.int32)),
                                        pa.py_buffer(buf[a[which] + i]))
    of = row[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()).take(pa.array(lang[of])), pa.array(sources, pa.string()).take(pa.array(source[of])),
         terms, pa.array(np.diff(np.r_[first, len(order)])), pa.array(docs)],
        names=["lang", "source", "term", "c", "docs"])


def _count(batches):
    for whole in batches:
        for batch in A.slices(whole, "text", PIECE_BYTES):
            yield _batch_counts(*(batch.column(c) for c in ("lang", "source", "text")))


def term_rows(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, row``: the kept terms with their count in the
    language, and their nonzero counts by source."""
    found = docs.mapInArrow(_count, "lang string, source string, term string, c long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("c").alias("total"), F.sum("docs").alias("docs"),
                                              F.collect_list(F.struct("source", "c")).alias("row"))
    return rows.filter(F.col("docs") >= least_docs).drop("docs")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_corrections(lang: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray,
                     offsets: np.ndarray, times: np.ndarray) -> dict[tuple[int, int, int], int]:
    """Sum of the corrections of each (language, ancestor's source, node's
    source), from sorted paths: the items of path i (``source``, ``p``, ``p0``)
    lie at ``offsets[i]`` to ``offsets[i + 1]``; it occurs ``times[i]`` times."""
    n, start, length = len(lang), offsets[:-1], np.diff(offsets)
    # Items that a path has in common with the one before it.
    least = np.zeros(n, np.int64)
    least[1:] = np.where(lang[1:] == lang[:-1], np.minimum(length[1:], length[:-1]), 0)
    row, k = A.expand(least)
    here, there = start[row] + k, start[np.maximum(row - 1, 0)] + k
    unlike = (source[here] != source[there]) | (p[here] != p[there])
    common = least.copy()
    np.minimum.at(common, row[unlike], k[unlike])
    out: dict[tuple[int, int, int], int] = {}
    for depth in range(1, int(length.max(initial=0))):
        # The nodes of this depth begin where paths part at or above it.
        first = np.flatnonzero(common <= depth)
        passing = np.add.reduceat(np.where(length > depth, times, 0), first)
        real = length[first] > depth
        first, passing = first[real], passing[real]
        for at in range(0, len(first), max(1, COMBINATIONS // depth)):
            rows = first[at: at + max(1, COMBINATIONS // depth)]
            node = (start[rows] + depth)[:, None]
            over = start[rows][:, None] + np.arange(depth)
            value = (_divergence(p[over], p[node]) - _divergence(p[over], p0[node])
                     - _divergence(p0[over], p[node]) + _divergence(p0[over], p0[node]))
            value *= passing[at: at + len(rows)][:, None]
            key = np.stack([np.broadcast_to(lang[rows][:, None], over.shape).ravel(), source[over].ravel(),
                            np.broadcast_to(source[node], over.shape).ravel()])
            order = np.lexsort(key)
            key, value = key[:, order], value.ravel()[order]
            edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            for pair, v in zip(key[:, edge].T.tolist(), np.add.reduceat(value, edge).tolist(), strict=True):
                out[tuple(pair)] = out.get(tuple(pair), 0) + v
    return out


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _insert(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path")
        items = path.flatten()
        offsets = np.cumsum(np.r_[0, path.value_lengths().to_numpy(zero_copy_only=False)])
        lang, langs = _codes(batch.column("lang"))
        source, sources = _codes(items.field("source"))
        p, p0 = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "p0"))
        found = tree_corrections(lang, source, p, p0, offsets, batch.column("times").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs[k[0]] for k in found], pa.string()), pa.array([sources[k[1]] for k in found], pa.string()),
             pa.array([sources[k[2]] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
            names=["lang", "source", "item", "value"])


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(order).cast("int"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of ``docs``."""
    read = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
            for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*read)
    rows = reliable_checkpoint(term_rows(docs, least_docs), "term-rows")
    flat = rows.select("lang", "term", "total", F.explode("row").alias("i")).select("lang", "term", "total", "i.*")
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    zero = F.lit(0).cast("long")
    groups = (docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "n_lang")])
              .withColumn("p0", share(zero, F.col("n"), F.col("v"))))
    groups = reliable_checkpoint(groups, "source-groups")
    items = (flat.join(groups, ["lang", "source"])
             .withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
             .withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v"))))

    # Node-ancestor corrections of the tree.
    path = F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("path")
    paths = items.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # Dealt by their first items: keys that the driver samples stay short. Paths
    # that begin alike may be split by their hash.
    paths = paths.repartitionByRange("lang", F.slice("path", 1, 2), F.xxhash64("path")).sortWithinPartitions(
        "lang", "path")
    both = paths.mapInArrow(_insert, "lang string, source string, item string, value long")

    # What depends on one of the two sources only, and the shares of unused terms.
    a = groups.select("lang", "source", "p0", "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    other = F.col("source") != F.col("item")
    unused = a.join(b, "lang").filter(other).select(
        "lang", "source", "item", F.coalesce(F.col("v") * divergence(F.col("p0"), F.col("q0")), zero).alias("value"))
    shares = items.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    one = shares.join(b, "lang").filter(other).select("lang", "source", "item", (F.col("times") * (
        divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("value"))
    # Both parts of the tree and of the histogram hold for the pair either way.
    either = one.unionByName(both)
    turned = either.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = (unused.unionByName(either).unionByName(turned).groupBy("lang", "source", "item")
             .agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")))
    terms = (items.filter((F.col("p") > F.col("q")) & (F.col("c") > 0))
             .select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")))
    terms = _ranked(terms).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return _ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_pattern_tree(documents: DataFrame) -> DataFrame:
    """The contract's columns: pairs of sources, all ranks, and the ten terms
    of each group that stand out most."""
    return audit(documents)
