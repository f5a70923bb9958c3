"""Reproducible splits that never part a user's rows, and label permutation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tiercast.functions.columns import seeded_hash
from tiercast.operators.population import KEYS
from tiercast.operators.ranks import rank_by_hash
from tiercast.sources.storage import spread


def group_holdout(rows: DataFrame, share: float, seed: int, user: str = "user_id") -> DataFrame:
    """Add ``is_test`` by user, from a seeded hash alone: no shuffle."""
    cut = round(share * 10_000)
    return rows.withColumn("is_test", seeded_hash(seed, F.col(user)) % 10_000 < cut)


def fold_of_user(
    rows: DataFrame, k: int, seed: int, user: str = "user_id", label: str = "engaged"
) -> DataFrame:
    """(user, fold): users dealt round-robin within strata of equal row and positive counts.

    The running position continues from stratum to stratum, so small strata do
    not all start on the same fold. There are at most as many strata as pairs
    of (rows, positives) a user can have, i.e. few; a stratum may hold most
    users and is therefore ranked in hash buckets.
    """
    users = (
        rows.groupBy(user)
        .agg(F.count("*").alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_pos"))
        .withColumn("_h", seeded_hash(seed, F.col(user)))
    )
    strata = users.groupBy("n_rows", "n_pos").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("n_rows", "n_pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = strata.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = rank_by_hash(users, "_h", [user], "_rank", within=["n_rows", "n_pos"])
    return ranked.join(offsets, ["n_rows", "n_pos"]).select(
        user, ((F.col("_rank") + F.col("_earlier")) % k).cast("int").alias("fold")
    )


def group_folds(
    rows: DataFrame, k: int, seed: int, user: str = "user_id", label: str = "engaged"
) -> DataFrame:
    return rows.join(spread(fold_of_user(rows, k, seed, user, label)), user)


def permute_labels(
    rows: DataFrame, seed: int, keys: Sequence[str] = KEYS, label: str = "engaged"
) -> DataFrame:
    """Deal the labels out anew: each row takes the label of a random other row.

    Two seeded orders of the rows are joined on the rank, so every label is
    used exactly once and the class counts stay as they are. Only the keys and
    labels are ranked; the other columns join the result by key.
    """
    key_cols = [F.col(k) for k in keys]
    taker = rank_by_hash(
        rows.select(*keys).withColumn("_h", seeded_hash(f"{seed}-rows", *key_cols)), "_h", keys, "_rank"
    ).drop("_h")
    giver = rank_by_hash(
        rows.select(*keys, label).withColumn("_h", seeded_hash(f"{seed}-labels", *key_cols)),
        "_h", keys, "_rank",
    )
    dealt = taker.join(spread(giver.select("_rank", label)), "_rank").drop("_rank")
    return rows.drop(label).join(spread(dealt), list(keys)).select(*rows.columns)
