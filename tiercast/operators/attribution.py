"""Shapley attributions of boosted trees as a join with the model's leaves.

A leaf is reached when every feature on its path lies in an interval. Taking
the features outside a coalition at their training cover, the leaf pays

    value * prod(inside[j] for j in coalition) * prod(ratio[j] for the others)

where ``inside`` is 0 or 1 for the row and ``ratio`` is the share of the
training weight that stays on the path at that feature's splits. The Shapley
weights of such a product are an integral over [0, 1] of a polynomial of degree
(features - 1), so Gauss-Legendre quadrature with few nodes is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from operator import mul

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from tiercast.functions.vectors import value_at
from tiercast.operators.population import KEYS

# Leaves in one broadcast; larger models are handled in several passes.
MAX_LEAVES = 100_000


def _leaves_of_tree(nodes: dict[int, Row]) -> list[tuple[float, dict]]:
    """(prediction, {feature: (lo, hi, ratio)}) per leaf; conditions on one feature merge."""
    leaves, pending = [], [(nodes[0], {})]
    while pending:
        node, path = pending.pop()
        if node.left < 0:
            leaves.append((node.prediction, path))
            continue
        lo, hi, ratio = path.get(node.feature, (float("-inf"), float("inf"), 1.0))
        for child, interval in (
            (nodes[node.left], (lo, min(hi, node.threshold))),
            (nodes[node.right], (max(lo, node.threshold), hi)),
        ):
            step = (*interval, ratio * child.cover / node.cover)
            pending.append((child, {**path, node.feature: step}))
    return leaves


def leaf_table(nodes: DataFrame) -> DataFrame:
    """One row per leaf: fold, value on the log-odds scale, and its path intervals.

    Reads the model's nodes on the driver; their number is fixed by the model
    parameters. A margin of Spark's trees is half the log-odds.
    """
    trees: dict[tuple[int, int], dict[int, Row]] = defaultdict(dict)
    for n in nodes.collect():
        trees[n.fold, n.tree][n.node] = n
    rows = [
        (fold, tree, 2.0 * tree_nodes[0].tree_weight * prediction,
         [(f, lo, hi, ratio) for f, (lo, hi, ratio) in sorted(path.items())])
        for (fold, tree), tree_nodes in sorted(trees.items())
        for prediction, path in _leaves_of_tree(tree_nodes)
    ]
    return nodes.sparkSession.createDataFrame(
        rows,
        "fold int, tree int, value double, "
        "path array<struct<feature: int, lo: double, hi: double, ratio: double>>",
    )


def base_values(leaves: DataFrame) -> DataFrame:
    """Expected log-odds per fold model, the value attributions start from."""
    reach = F.aggregate("path", F.lit(1.0), lambda acc, s: acc * s["ratio"])
    return leaves.groupBy("fold").agg(F.sum(F.col("value") * reach).alias("base"))


def _contributions(rows: DataFrame, leaves: DataFrame, slots: int, keys: Sequence[str]) -> DataFrame:
    """Per row and leaf, what each feature on the path adds."""
    # Paths of equal length: an empty slot is always inside with ratio 1 and adds nothing.
    empty = F.struct(
        F.lit(0).alias("feature"), F.lit(float("-inf")).alias("lo"),
        F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("ratio"),
    )
    step = [F.coalesce(F.get("path", i), empty) for i in range(slots)]
    flat = leaves.select(
        "fold", "value", *[step[i][c].alias(f"{c}{i}") for i in range(slots) for c in ("feature", "lo", "hi", "ratio")]
    )
    x = [value_at(rows, F.col(f"feature{i}")) for i in range(slots)]
    joined = rows.select(*keys, "fold", "x").join(F.broadcast(flat), "fold").select(
        *keys,
        "value",
        *[F.col(f"feature{i}") for i in range(slots)],
        *[F.col(f"ratio{i}") for i in range(slots)],
        *[x[i].alias(f"x{i}") for i in range(slots)],
        *[
            ((x[i] > F.col(f"lo{i}")) & (x[i] <= F.col(f"hi{i}"))).cast("double").alias(f"inside{i}")
            for i in range(slots)
        ],
    )
    points, weights = np.polynomial.legendre.leggauss((slots + 1) // 2)
    nodes = [(float((p + 1) / 2), float(w / 2)) for p, w in zip(points, weights)]

    def mixed(i: int, t: float) -> Column:
        return F.lit(t) * F.col(f"inside{i}") + F.lit(1 - t) * F.col(f"ratio{i}")

    def share(j: int) -> Column:
        others = [k for k in range(slots) if k != j]
        return sum(
            (reduce(mul, [mixed(k, t) for k in others], F.lit(w)) for t, w in nodes[1:]),
            reduce(mul, [mixed(k, nodes[0][0]) for k in others], F.lit(nodes[0][1])),
        )

    cells = [
        F.struct(
            F.col(f"feature{j}").alias("idx"),
            F.col(f"x{j}").alias("value"),
            (F.col("value") * (F.col(f"inside{j}") - F.col(f"ratio{j}")) * share(j)).alias("phi"),
        )
        for j in range(slots)
    ]
    return joined.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").filter(
        F.col("phi") != 0
    )


def attribute(
    rows: DataFrame, leaves: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, sub_feature, value, phi) of ``rows`` (keys, fold, x); absent pairs are 0.

    Each row meets the leaves of its own fold's model. Contributions are summed
    per (row, feature) where they arise, before the shuffle.
    """
    size = leaves.agg(
        F.count("*").alias("n"),
        F.max("tree").alias("last_tree"),
        F.max(F.size("path")).alias("slots"),
    ).first()
    slots = max(size.slots or 0, 1)
    passes = -(-size.n // MAX_LEAVES) or 1
    per_pass = -(-((size.last_tree or 0) + 1) // passes)
    parts = [
        _contributions(
            rows, leaves.filter(F.floor(F.col("tree") / per_pass) == i) if passes > 1 else leaves, slots, keys
        )
        for i in range(passes)
    ]
    cells = reduce(DataFrame.unionByName, parts)
    return (
        cells.groupBy(*keys, "idx")
        .agg(F.max("value").alias("value"), F.sum("phi").alias("phi"))
        # No hint: the list is as long as the feature dictionary.
        .join(features, "idx")
        .select(*keys, "sub_feature", "value", "phi")
    )
