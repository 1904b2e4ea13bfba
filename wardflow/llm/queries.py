"""Registered queries of this subpackage: one per operator, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardflow.llm import oracles
from wardflow.llm.op1_best_fit_packing import op1_best_fit_packing
from wardflow.llm.op2_ball_tree import op2_ball_tree
from wardflow.llm.op3_ring_shards import op3_ring_shards
from wardflow.llm.op4_mixture_packing import op4_mixture_packing
from wardflow.llm.op5_wu_manber import op5_wu_manber
from wardflow.llm.op6_boosted_quality import op6_boosted_quality
from wardflow.llm.op7_centroid_language import op7_centroid_language
from wardflow.llm.op8_minmax_dedup import op8_minmax_dedup
from wardflow.llm.op9_sentence_spans import op9_sentence_spans
from wardflow.llm.op10_toxicity_chain import op10_toxicity_chain
from wardflow.llm.op11_pattern_tree import op11_pattern_tree
from wardflow.llm.op12_bond_negatives import op12_bond_negatives
from wardflow.llm.op13_column_bwt import op13_column_bwt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, *tables: str):
    """A query that applies ``operator`` to whole tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[_table(spark, sf_dir, t) for t in tables])
    return run


QUERIES = {
    "op1_best_fit_packing": _on(op1_best_fit_packing, "documents"),
    "op2_ball_tree": _on(op2_ball_tree, "embeddings"),
    "op3_ring_shards": _on(op3_ring_shards, "documents"),
    "op4_mixture_packing": _on(op4_mixture_packing, "documents"),
    "op5_wu_manber": _on(op5_wu_manber, "documents", "benchmark"),
    "op6_boosted_quality": _on(op6_boosted_quality, "documents", "labels"),
    "op7_centroid_language": _on(op7_centroid_language, "documents"),
    "op8_minmax_dedup": _on(op8_minmax_dedup, "documents"),
    "op9_sentence_spans": _on(op9_sentence_spans, "documents"),
    "op10_toxicity_chain": _on(op10_toxicity_chain, "documents", "labels"),
    "op11_pattern_tree": _on(op11_pattern_tree, "documents"),
    "op12_bond_negatives": _on(op12_bond_negatives, "embeddings"),
    "op13_column_bwt": _on(op13_column_bwt, "documents"),
}
#: The others have no SQL form; tests hold them against plain code.
ORACLE = {"op2_ball_tree": oracles.OP2, "op5_wu_manber": oracles.OP5, "op8_minmax_dedup": oracles.OP8,
          "op11_pattern_tree": oracles.OP11, "op12_bond_negatives": oracles.OP12,
          "op13_column_bwt": oracles.OP13}
