"""Corpus pipeline: from raw documents to packed training windows.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; between stages the documents are written as Parquet in the
shared folder and read again. All stages but the last return the columns of
``documents``.

1. toxicity      documents that the classifier chain rejects go;
2. near_dedup    of each group of near copies (five-word shingles, similarity
                 0.8) the document with the smallest id stays;
3. substrings    sentences of repeated spans go from all but the first place;
                 a document of which nothing is left goes;
4. decontaminate documents that hold a window of a benchmark item of
                 LEAST_ITEM_WORDS words or more go (a shorter item, such as
                 "True", is common speech and tells nothing of where it is from);
5. packing       windows of 2048 ids in the sources' proportions.

Columns beyond the id, the text, the source and ``n_chars`` (which follows the
text) are handed on unread, whatever their names. Nulls, empty and repeated
rows are treated as the operators say; of rows that repeat both id and text,
one stays in stage 2 (all stay if the text has no words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.op4_mixture_packing import op4_mixture_packing
from wardflow.llm.op5_wu_manber import find_contamination
from wardflow.llm.op8_minmax_dedup import near_duplicates
from wardflow.llm.op9_sentence_spans import remove_repeated_spans
from wardflow.llm.op10_toxicity_chain import fit_toxicity, score_toxicity
from wardflow.session import release, reliable_checkpoint

SHINGLE = 5
SIMILARITY = 80
LEAST_ITEM_WORDS = 5
#: Words as the decontamination counts them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _named(docs: DataFrame) -> DataFrame:
    """Columns under places, so that no operator's result clashes with them;
    the id, the text and the source keep their names."""
    return docs.select(*[F.col(f"`{c}`").alias(_place(c, i)) for i, c in enumerate(docs.columns)])


def _place(column: str, i: int) -> str:
    return column if column in ("doc_id", "text", "source") else f"_c{i}"


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``df``, under their own names."""
    return df.select(*[F.col(_place(c, i)).cast(t).alias(c) for i, (c, t) in enumerate(docs.dtypes)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _named(docs)
    model = fit_toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(rows, model, keep=rows.columns)
    return _restored(scored.filter(~F.col("rejected")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _named(docs)
    groups = near_duplicates(rows, size=SHINGLE, similarity=SIMILARITY)
    # One (id, text) of each group; texts without words are their own groups.
    first = (groups.filter(F.col("kept") & F.col("group_id").isNotNull())
             .groupBy("group_id").agg(F.min("text_hash").alias("_t"), F.first("doc_id").alias("_i")))
    stay = first.select(F.coalesce("_i", F.lit(0)).alias("_i"), "_t", F.lit(True).alias("_grouped")).unionByName(
        groups.filter(F.col("group_id").isNull()).select(
            F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("text_hash").alias("_t"),
            F.lit(False).alias("_grouped")).distinct())
    ident = F.col("doc_id").cast("long")
    keyed = rows.withColumns({"_i": F.coalesce(ident, F.lit(0)), "_t": F.xxhash64("text", ident.isNull())})
    kept = keyed.join(stay, ["_i", "_t"])
    grouped = kept.filter("_grouped").dropDuplicates(["_i", "_t"])
    return _restored(grouped.unionByName(kept.filter("not _grouped")), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _named(docs)
    cut = remove_repeated_spans(rows, keep=rows.columns)
    whole = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = next((_place(c, i) for i, c in enumerate(docs.columns) if c == "n_chars"), None)
    if length:
        whole = whole.withColumn(length, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(length)))
    return _restored(whole, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _named(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    telling = items.filter(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))) >= LEAST_ITEM_WORDS)
    found = find_contamination(rows, telling, keep=rows.columns)
    return _restored(found.filter(F.col("n_hit") == 0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_mixture_packing(_named(docs))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("packing", packing),
]
#: The classifier chain has no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = reliable_checkpoint(kept, f"stage-{name}")
        # What the stage read of intermediate tables, its input included.
        release(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
