"""A model that is written down instead of fitted, so that SQL can score and explain with it.

Complete trees of depth 3, three to each fold; features, thresholds, shares and
predictions follow from the numbers of fold, tree and node. On some paths a
feature is tested twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOLDS, TREES = 5, 3
_SPLITS = 7
_FEATURES = 20  # of the first features in name order
_SCHEMA = (
    "fold int, tree int, tree_weight double, node int, prediction double, cover double, gain double, "
    "`left` int, `right` int, feature int, threshold double")


def rows() -> list[tuple]:
    """One tuple per node, in the order of ``_SCHEMA``; children of node k are 2k + 1 and 2k + 2."""
    out = []
    for fold in range(FOLDS):
        for tree in range(TREES):
            first, cover = 4 * fold + 5 * tree, {0: 1024.0}
            for node in range(2 * _SPLITS + 1):
                prediction = ((37 * node + 11 * tree + 7 * fold) % 19 - 9) / 7
                if node >= _SPLITS:
                    out.append((fold, tree, 1.0 / (tree + 1), node, prediction, cover[node], -1.0, -1, -1, -1, None))
                    continue
                cover[2 * node + 1] = cover[node] * (0.5 + 0.0625 * ((node + tree + fold) % 5))
                cover[2 * node + 2] = cover[node] - cover[2 * node + 1]
                feature = (first + (0, 1, 0, 2, 3, 1, 4)[node]) % _FEATURES
                threshold = (0.5, 0.5, 0.9, 0.5, 1.2, 0.9, 0.5)[node]
                gain = (node + 1) * (tree + 2) / (fold + 1)
                out.append((fold, tree, 1.0 / (tree + 1), node, prediction, cover[node], gain, 2 * node + 1, 2 * node + 2, feature, threshold))
    return out


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), _SCHEMA)


def values_sql() -> str:
    """The same nodes as a SQL list of values."""
    return ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in row) + ")" for row in rows())
