"""Scores and attributions of boosted trees by the outcome of their split tests.

What a tree says of a row, its value and its Shapley terms, depends on nothing
but the outcomes of the tree's split tests. The outcomes, one bit a test, are
the row's signature; a lookup table holds value and summed terms for each
signature of each tree. A row meets as many lookup rows as its model has trees
and never a single leaf, and all models are met in one pass over the rows.

The tables are as large as the model parameters make them (trees times
2 ** splits); trees with more than ``MAX_SPLITS`` splits are left to
:mod:`tiercast.operators.attribution`, which meets leaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from tiercast.functions.vectors import value_at
from tiercast.operators.population import KEYS

#: Split tests of one tree; its part of the lookup has 2 ** splits rows.
MAX_SPLITS = 8


@dataclass(frozen=True)
class Signatures:
    """The split tests of every tree, and value and terms of every signature."""

    tests: DataFrame  # model, tree, feature0.., threshold0..
    lookup: DataFrame  # model, tree, signature, value, terms array<struct<idx, phi>>
    splits: int  # most tests of a tree


def _steps(nodes: dict[int, Row]) -> list[tuple[float, list[tuple[int, bool, float]]]]:
    """(prediction, [(splitting node, to the right, share of its cover)]) of every leaf."""
    leaves, pending = [], [(nodes[0], [])]
    while pending:
        node, path = pending.pop()
        if node.left < 0:
            leaves.append((node.prediction, path))
            continue
        for child, right in ((nodes[node.left], False), (nodes[node.right], True)):
            pending.append((child, [*path, (node.node, right, child.cover / node.cover)]))
    return leaves


def _of_tree(nodes: dict[int, Row], tests: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Value and, by feature, Shapley terms for every signature of a tree.

    A leaf's value is spread over the features of its path: each counts by
    inside - ratio, weighted over the coalitions of the others. The weights are an integral of a
    polynomial over [0, 1], which Gauss-Legendre quadrature gives exactly.
    """
    bit = {node: k for k, node in enumerate(tests)}
    signatures = np.arange(1 << len(tests))
    value, terms = np.zeros(len(signatures)), defaultdict(lambda: np.zeros(len(signatures)))
    scale = 2.0 * nodes[0].tree_weight  # a margin is half the log-odds
    for prediction, path in _steps(nodes):
        inside, ratio = {}, defaultdict(lambda: 1.0)
        for node, right, share in path:
            held = (signatures >> bit[node] & 1) == right
            feature = nodes[node].feature
            inside[feature] = inside.get(feature, True) & held
            ratio[feature] *= share
        reached = np.ones(len(signatures))
        for held in inside.values():
            reached = reached * held
        value += scale * prediction * reached
        points, weights = np.polynomial.legendre.leggauss(max(1, (len(inside) + 1) // 2))
        for feature, held in inside.items():
            others = np.zeros(len(signatures))
            for p, w in zip((points + 1) / 2, weights / 2):
                product = np.full(len(signatures), w)
                for other, at in inside.items():
                    if other != feature:
                        product = product * (p * at + (1 - p) * ratio[other])
                others += product
            terms[feature] += scale * prediction * (held - ratio[feature]) * others
    return value, terms


def signatures(nodes: DataFrame) -> Signatures | None:
    """The tables of all models in ``nodes``; None if some tree has too many splits.

    Reads the nodes on the driver; their number is fixed by the model parameters.
    """
    spark = nodes.sparkSession
    trees: dict[tuple[int, int], dict[int, Row]] = defaultdict(dict)
    for n in nodes.collect():
        trees[n.fold, n.tree][n.node] = n
    splitting = {key: sorted(n.node for n in tree.values() if n.left >= 0) for key, tree in trees.items()}
    splits = max(map(len, splitting.values()), default=0)
    if splits > MAX_SPLITS:
        return None
    tests, lookup = [], []
    for (model, number), tree in sorted(trees.items()):
        own = splitting[model, number]
        # Missing tests never hold: they leave their bit 0.
        features = [tree[k].feature for k in own] + [0] * (splits - len(own))
        thresholds = [tree[k].threshold for k in own] + [float("inf")] * (splits - len(own))
        tests.append((model, number, *features, *thresholds))
        value, terms = _of_tree(tree, own)
        by_feature = sorted(terms.items())
        for s in range(1 << len(own)):
            cells = [(f, float(phi[s])) for f, phi in by_feature if phi[s] != 0.0]
            lookup.append((model, number, s, float(value[s]), cells))
    columns = [f"feature{k} int" for k in range(splits)] + [f"threshold{k} double" for k in range(splits)]
    return Signatures(
        spark.createDataFrame(tests, ", ".join(["model int", "tree int", *columns])),
        spark.createDataFrame(lookup, "model int, tree int, signature int, value double, terms array<struct<idx: int, phi: double>>"),
        splits,
    )


def _signature(rows: DataFrame, splits: int) -> Column:
    bits = [
        F.shiftleft((value_at(rows, F.col(f"feature{k}")) > F.col(f"threshold{k}")).cast("int"), k) for k in range(splits)]
    return sum(bits, F.lit(0))


def _met(rows: DataFrame, tables: Signatures) -> DataFrame:
    """Rows times the trees of their model, with what the lookup says of the row's signature."""
    signed = rows.join(F.broadcast(tables.tests), "model").withColumn("signature", _signature(rows, tables.splits))
    return signed.join(F.broadcast(tables.lookup), ["model", "tree", "signature"])


def score(rows: DataFrame, tables: Signatures, name: str = "score") -> DataFrame:
    """Probability of the positive class for ``rows`` (…, model, x), by the model each row names.

    All columns but x stay and tell rows apart; the trees' values are summed where the rows are, before the shuffle.
    """
    kept = [c for c in rows.columns if c != "x"]
    margins = _met(rows, tables).groupBy(*kept).agg(F.sum("value").alias("_log_odds"))
    return margins.select(*kept, (1 / (1 + F.exp(-F.col("_log_odds")))).alias(name))


def out_of_fold(folded: DataFrame, tables: Signatures) -> DataFrame:
    """Every row scored by the model that never saw its user."""
    return score(folded.withColumn("model", F.col("fold")), tables).drop("model")


def in_sample(folded: DataFrame, tables: Signatures, n_folds: int) -> DataFrame:
    """Every row scored by the models fitted on it, in one pass; ``fold`` names the model."""
    others = F.filter(F.array(*[F.lit(k) for k in range(n_folds)]), lambda k: k != F.col("fold"))
    met = folded.withColumn("model", F.explode(others)).drop("fold")
    return score(met, tables).withColumnRenamed("model", "fold")


def attribute(rows: DataFrame, tables: Signatures, features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, sub_feature, value, phi) of ``rows`` (keys, fold, x); absent pairs are 0.

    Each row meets the trees of its own fold's model. Terms are summed per (row, feature) before the shuffle.
    """
    met = _met(rows.select(*keys, F.col("fold").alias("model"), "x"), tables)
    cells = met.select(*keys, "x", F.explode("terms").alias("t")).select(
        *keys, F.col("t.idx").alias("idx"), value_at(rows, F.col("t.idx")).alias("value"), F.col("t.phi").alias("phi"))
    return (
        cells.groupBy(*keys, "idx")
        .agg(F.max("value").alias("value"), F.sum("phi").alias("phi"))
        # No hint: the list is as long as the feature dictionary.
        .join(features, "idx")
        .select(*keys, "sub_feature", "value", "phi")
    )
