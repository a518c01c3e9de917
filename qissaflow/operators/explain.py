"""Shapley values of boosted trees, exact for each tree with the covers of its training rows as the background.

A leaf pays its value to a coalition of features by the product, over the features on its path, of whether the row goes its way (features in
the coalition) or the share of training rows that do (the others). A path has at most as many features as the tree is deep, so that
the Shapley sum over coalitions is written out, for all rows of a batch at once.

The values of a row and the mean score over the background add up to the row's score (log-odds).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qissaflow.sources.shared import shared_folder

#: A leaf: its value, and for each feature on its path the bounds that the row must keep and the share of rows that do.
Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def leaves(model, spark: SparkSession) -> list[Leaf]:
    """All leaves of a model of boosted trees (twice the trees' weights, as its score is log-odds halved), read from its saved form."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").selectExpr("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out: list[Leaf] = []
    for tree, nodes in trees.items():
        weight = 2 * model.treeWeights[tree]

        def walk(k: int, path: dict, nodes=nodes, weight=weight) -> None:
            node = nodes[k]
            if node["leftChild"] < 0:
                out.append((weight * node["prediction"], path))
                return
            feature, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            for child, low, high in ((node["leftChild"], -np.inf, cut), (node["rightChild"], cut, np.inf)):
                a, b, share = path.get(feature, (-np.inf, np.inf, 1.0))
                part = _count(nodes[child]) / max(_count(node), 1e-300)
                walk(child, path | {feature: (max(a, low), min(b, high), share * part)})

        walk(0, {})
    return out


def _count(node) -> float:
    return float(node["impurityStats"][0])


def shapley(own: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of each row and feature, and the mean score over the background."""
    out, base = np.zeros(x.shape), 0.0
    for value, path in own:
        features = list(path)
        d = len(features)
        one = [(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in features]
        share = [path[f][2] for f in features]
        base += value * float(np.prod(share))
        for i, f in enumerate(features):
            others = [k for k in range(d) if k != i]
            total = np.zeros(len(x))
            for size in range(d):
                scale = factorial(size) * factorial(d - size - 1) / factorial(d)
                for inside in combinations(others, size):
                    part = np.full(len(x), scale)
                    for k in others:
                        part = part * (one[k] if k in inside else share[k])
                    total += part
            out[:, f] += value * total * (one[i] - share[i])
    return out, base


def tree_shapley(model, rows: DataFrame, columns: list[str], id_column: str, most: int = 15) -> DataFrame:
    """For each row (with the vector x) its features that count most: rank, feature, value."""
    own = leaves(model, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(columns))
            values, _ = shapley(own, x)
            order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :most]
            ids = [i for i in batch.column(0).to_pylist() for _ in range(order.shape[1])]
            picked = np.take_along_axis(values, order, 1).ravel()
            names = [columns[k] for k in order.ravel()]
            ranks = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(ranks), pa.array(names), pa.array(picked)], ["id", "rank", "feature", "value"])

    plain = rows.select(F.col(id_column).alias("id"), vector_to_array("x").alias("x"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, rank int, feature string, value double").withColumnRenamed("id", id_column)
