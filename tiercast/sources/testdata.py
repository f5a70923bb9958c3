"""Stand-in domain tables derived from the order-style test tables.

Orders play usage, customers play users and accounts, order status plays the
account state. Nothing here is part of the panel engine itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tiercast.config import ModelParams, PanelConfig
from tiercast.sources.storage import side_by_side, spread, stage
from tiercast.sources.tables import scan

# Scope used with these tables. Few small trees: the data has no planted signal.
TEST_CONFIG = PanelConfig(
    training_months=None,
    products=("Alpha", "Beta"),
    denied_features=("SMALL - Brand#1", "LARGE - Brand#2"),
    denied_prefix="PROMO",
    exclude_features=("STANDARD - Brand#1",),
    model=ModelParams(trees=5),
)

# The test tables read here.
INPUTS = ("orders", "lineitem", "part")

LOOK_BACK = 29


@dataclass(frozen=True)
class DomainTables:
    usage: DataFrame
    catalog: DataFrame
    personas: DataFrame
    account_state: DataFrame


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    lines = scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_returnflag"])
    parts = scan(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_brand", "p_type"])
    product = F.when(F.col("l_returnflag") == "N", "Alpha").when(F.col("l_returnflag") == "A", "Beta")
    named = F.when(F.col("p_brand") == "Brand#25", F.lit(None)).otherwise(
        F.concat("p_type", F.lit(" - "), "p_brand")
    )
    return (
        # Hashed, as a part has many lines: they need no sort.
        lines.join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .join(spread(orders), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("time_period"),
            product.otherwise("Gamma").alias("product"),
            F.col("o_orderpriority").alias("feature"),
            named.alias("sub_feature"),
        )
        .agg(F.count("*").alias("event_count"))
    )


def usage_catalog(usage: DataFrame) -> DataFrame:
    unsure = (F.col("feature") == "4-NOT SPECIFIED") & (F.col("product") == "Beta")
    return usage.select(
        "product", "feature", F.coalesce("sub_feature", F.lit("")).alias("sub_feature"),
        F.when(F.col("feature") == "5-LOW", False).when(unsure, None).otherwise(True).alias("is_counted"),
    ).distinct()


def probe_days(usage: DataFrame) -> DataFrame:
    """Month ends within the usage dates, and the day 30 days after each; a few hundred rows."""
    span = usage.agg(F.min("time_period").alias("lo"), F.max("time_period").alias("hi"))
    ends = span.select(
        "hi", F.explode(F.sequence(F.trunc("lo", "MM"), F.col("hi"), F.expr("interval 1 month"))).alias("m")
    ).select("hi", F.last_day("m").alias("t")).filter(F.col("t") <= F.col("hi"))
    return ends.select(F.explode(F.array("t", F.date_add("t", LOOK_BACK + 1))).alias("d")).distinct()


def _pinned(probes: DataFrame) -> DataFrame:
    """The probe days as local rows, so that each use does not scan the usage again."""
    return probes.sparkSession.createDataFrame(probes.collect(), "d date")


def _days(probes: DataFrame) -> Column:
    return probes.agg(F.array_sort(F.collect_list("d"))).scalar()


def personas(usage: DataFrame) -> DataFrame:
    """Daily tier history on the probe days: tier by the events of the last 30 days.

    Events meet their user once, summed by day; all else is made where the user is.
    """
    probes = _pinned(probe_days(usage))
    act = usage.groupBy("user_id", "time_period").agg(F.sum("event_count").alias("n")).repartition("user_id")
    # Calendar days with the probe days that look back on them: 30 rows per probe day.
    covered = probes.select("d", F.explode(F.sequence(F.date_sub("d", LOOK_BACK), F.col("d"))).alias("time_period"))
    by_day = covered.groupBy("time_period").agg(F.collect_list("d").alias("_seen_on"))
    own = F.array(F.struct(F.col("time_period").alias("d"), F.lit(True).alias("own")))
    seen = F.transform("_seen_on", lambda d: F.struct(d.alias("d"), F.lit(False).alias("own")))
    entries = act.join(F.broadcast(by_day), "time_period", "left").select(
        "user_id", "n", F.inline(F.concat(own, F.coalesce(seen, F.array().cast("array<struct<d: date, own: boolean>>")))))
    items = entries.groupBy("user_id", "d").agg(
        F.sum(F.when(F.col("own"), F.col("n"))).alias("n"), F.bool_or("own").alias("own"),
        F.sum(F.when(~F.col("own"), F.col("n"))).alias("items"), F.bool_or(~F.col("own")).alias("probe"))
    # At most one entry per probe day and user: the days are made after this, so none is shuffled or sorted.
    dates = items.groupBy("user_id").agg(
        F.min(F.when(F.col("own") & F.col("d").isNotNull(), F.struct("d", "n"))).alias("_first"),
        F.map_from_entries(F.collect_list(F.when(F.col("probe"), F.struct("d", "items")))).alias("_items"),
    ).withColumn("joined", F.col("_first.d")).withColumn("_probes", _days(probes)).select(
        "user_id", "joined", "_items", "_first",
        F.explode(
            F.array_union(F.array("joined"), F.filter("_probes", lambda d: d >= F.col("joined")))
        ).alias("d"),
    )
    # The first day need not be a probe day. Nothing is known of a user without an id.
    known = F.coalesce(F.try_element_at("_items", "d"), F.when(F.col("d") == F.col("joined"), F.col("_first.n")))
    n = F.coalesce(F.when(F.col("user_id").isNotNull(), known), F.lit(0))
    tier = (
        F.when(n == 0, "Inactive")
        .when(F.col("d") < F.date_add("joined", LOOK_BACK), "New")
        .when(n <= 2, "Casual")
        .when(n <= 5, "Core")
        .when(n <= 8, "Power User")
        .otherwise("Elite Power User")
    )
    return dates.select(
        "user_id",
        F.col("user_id").alias("acct_id"),
        F.col("d").alias("score_date"),
        tier.alias("user_category_persona"),
        ((F.col("user_id") % 50 == 7) & (F.month("d") == 1)).alias("is_test_a"),
        (F.col("user_id") % 97 == 3).alias("is_test_b"),
    )


def account_state_daily(spark: SparkSession, sf_dir: str, usage: DataFrame) -> DataFrame:
    """Per account and probe day: paid unless the latest order so far is finished.

    Orders first collapse to the newest per (account, next probe day); the gaps
    up to the account's following one are then filled from the probe calendar.
    """
    probes = _pinned(probe_days(usage))
    orders = scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    day = F.to_date("o_orderdate")
    start = orders.agg(F.min(day)).scalar()
    previous = F.lag("d").over(Window.orderBy("d"))  # a few hundred probe days
    # Calendar days up to each probe day: one row per day of the history.
    begun = F.coalesce(F.date_add(previous, 1), F.least(start, "d"))
    numbered = probes.withColumn("_from", begun).withColumn("k", F.row_number().over(Window.orderBy("d")))
    calendar = numbered.select("k", F.explode(F.sequence("_from", "d")).alias("day"))
    newest = (
        orders.filter(F.col("o_custkey") % 11 != 5)
        .withColumn("day", day)
        .join(F.broadcast(calendar), "day")
        .groupBy(F.col("o_custkey").alias("acct_id"), "k")
        .agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("last"))
    )
    # At most one row per probe day and account.
    following = F.lead("k").over(Window.partitionBy("acct_id").orderBy("k"))
    spans = newest.withColumn("until", following).withColumn("_probes", _days(probes))
    covered = F.slice("_probes", F.col("k"), F.coalesce("until", F.size("_probes") + 1) - F.col("k"))
    return spans.select(
        "acct_id", F.explode(covered).alias("date"), (F.col("last.o_orderstatus") != "F").alias("paid")
    )


def domain_tables(spark: SparkSession, sf_dir: str, version: str) -> DomainTables:
    """The four domain tables, written once per application and input version."""
    key = f"{sf_dir}/{version}"
    usage = stage(spark, "usage", key, lambda: usage_daily(spark, sf_dir))
    catalog, tiers, state = side_by_side(
        spark,
        lambda: stage(spark, "catalog", key, lambda: usage_catalog(usage)),
        lambda: stage(spark, "personas", key, lambda: personas(usage)),
        lambda: stage(spark, "account_state", key, lambda: account_state_daily(spark, sf_dir, usage)),
    )
    return DomainTables(usage=usage, catalog=catalog, personas=tiers, account_state=state)
