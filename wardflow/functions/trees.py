"""Boosted trees as one column expression (op G2).

A fitted ensemble is a few dozen small trees. Written as nested ``when``
expressions over the feature columns, the whole ensemble runs inside
whole-stage codegen: no vector is assembled, nothing leaves the JVM row, and a
plan reads only the features that the trees use. The same trees can be saved as
JSON text and scored by any engine that knows ``CASE WHEN``.

A row goes left when its value is at most the threshold; a NaN goes right. The
margin is the sum of weight times leaf value in tree order; the probability of
label 1 is ``1 / (1 + exp(-2 margin))`` (the logistic loss of ``pyspark.ml``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wardflow.session import delete_path


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    threshold: float
    left: Split | Leaf
    right: Split | Leaf


@dataclass(frozen=True)
class Ensemble:
    """Weighted trees over named features."""
    trees: tuple[tuple[float, Split | Leaf], ...]

    def splits(self) -> Iterator[Split]:
        todo = [root for _, root in self.trees]
        while todo:
            node = todo.pop()
            if isinstance(node, Split):
                yield node
                todo += [node.left, node.right]

    def features(self) -> list[str]:
        """The features that some split reads, sorted."""
        return sorted({s.feature for s in self.splits()})

    def moved(self, thresholds) -> Ensemble:
        """The same trees with ``thresholds(feature, threshold)``."""
        def walk(node):
            if isinstance(node, Leaf):
                return node
            return Split(node.feature, thresholds(node.feature, node.threshold), walk(node.left), walk(node.right))
        return Ensemble(tuple((w, walk(root)) for w, root in self.trees))


def from_spark(model, names: list[str]) -> Ensemble:
    """The trees of a fitted ``pyspark.ml`` ensemble over the features
    ``names``, in vector order. Only splits at a threshold are known."""
    def walk(node):
        if node.subtreeDepth() == 0:
            return Leaf(node.prediction())
        split = node.split()
        if not hasattr(split, "threshold") or "ContinuousSplit" not in split.getClass().getName():
            raise ValueError("categorical splits have no threshold")
        return Split(names[split.featureIndex()], split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return Ensemble(tuple((float(w), walk(t._java_obj.rootNode()))
                          for w, t in zip(model.treeWeights, model.trees, strict=True)))


def _plain(node) -> dict:
    if isinstance(node, Leaf):
        return {"value": node.value}
    return {"feature": node.feature, "threshold": node.threshold,
            "left": _plain(node.left), "right": _plain(node.right)}


def _node(d: dict) -> Split | Leaf:
    if "value" in d:
        return Leaf(float(d["value"]))
    return Split(str(d["feature"]), float(d["threshold"]), _node(d["left"]), _node(d["right"]))


def to_json(ensemble: Ensemble) -> str:
    return json.dumps({"trees": [{"weight": w, "root": _plain(root)} for w, root in ensemble.trees]}, indent=1)


def from_json(text: str) -> Ensemble:
    return Ensemble(tuple((float(t["weight"]), _node(t["root"])) for t in json.loads(text)["trees"]))


def save(spark: SparkSession, ensemble: Ensemble, path: str) -> None:
    """Write the trees as JSON text to a folder of any file system."""
    delete_path(spark, path)
    spark.createDataFrame([(to_json(ensemble),)], "value string").coalesce(1).write.text(path, lineSep="\0")


def load(spark: SparkSession, path: str) -> Ensemble:
    rows = spark.read.text(path, lineSep="\0").take(1)
    return from_json(rows[0].value)


def _expression(node: Split | Leaf, features: Mapping[str, Column]) -> Column:
    if isinstance(node, Leaf):
        return F.lit(node.value)
    goes_left = features[node.feature] <= F.lit(node.threshold)
    return F.when(goes_left, _expression(node.left, features)).otherwise(_expression(node.right, features))


def margin(ensemble: Ensemble, features: Mapping[str, Column]) -> Column:
    """Sum of weight times leaf; the features must be doubles without nulls."""
    total = F.lit(0.0)
    for weight, root in ensemble.trees:
        total = total + F.lit(weight) * _expression(root, features)
    return total


def probability(margin_: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin_))
