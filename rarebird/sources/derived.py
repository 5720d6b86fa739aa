"""Observation tables derived from the order, customer and embedding tables.

They stand in for a table of company years: a customer's year of orders is one
observation, and the label looks one year ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.hashing import below_share, key_hash

KEY = ("emis_id", "year")
FORMULAS = ("s1_mixed", "s2_count", "s3_revenue", "s4_balance")
SPLIT_AT = 1997  # last train year of the temporal split on this data


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def company_years(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and year, 1999 the last with a full label year.

    Orders are reduced to customer-years before anything else moves. The label
    comes from a window over a customer's few years instead of a self-join, and
    the window's partitioning by customer serves the customer join as well.
    """
    price = F.col("o_totalprice")
    yearly = (
        table(spark, folder, "orders")
        # Later orders neither belong to an observation nor label one.
        .where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
        .groupBy(F.col("o_custkey").alias("emis_id"), F.year("o_orderdate").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum(price).alias("revenue"),
            F.avg(price).alias("order_avg"),
            F.min(price).alias("order_min"),
            F.max(price).alias("order_max"),
            F.stddev_samp(price).alias("order_sd"),
            F.avg(F.when(F.col("o_orderstatus") == "P", price)).alias("pending_avg"),
            F.max(F.when(price > 480000, price)).alias("large_max"),
            F.max(F.when(price > 498000, price)).alias("near_null_max"),
        )
    )
    by_customer = W.partitionBy("emis_id").orderBy("year")
    following = F.lead("year").over(by_customer) == F.col("year") + 1
    busy = F.lead("n_orders").over(by_customer) >= 5
    ahead = yearly.withColumn(
        "main_label", F.when(following & busy, 1).otherwise(0)
    ).where("year <= 1999")
    customer = table(spark, folder, "customer")
    return ahead.join(customer, ahead.emis_id == customer.c_custkey).select(
        "emis_id",
        F.col("c_name").alias("company"),
        F.col("c_mktsegment").alias("industry"),
        (F.col("c_nationkey") % 4).cast("int").alias("country"),
        (F.col("emis_id") % 6 + 1).cast("int").alias("sector_1"),
        "year",
        "n_orders",
        "revenue",
        "order_avg",
        "order_min",
        "order_max",
        F.when(F.col("n_orders") >= 2, F.col("order_sd")).alias("order_sd"),
        "pending_avg",
        "large_max",
        "near_null_max",
        F.col("c_acctbal").alias("acctbal"),
        (F.col("revenue") > 400000).alias("is_large"),
        "main_label",
    )


def is_train() -> Column:
    return below_share(key_hash(KEY), 0.8)


def split_name(train: Column) -> Column:
    return F.when(train, "train").otherwise("test")


def formula_scores() -> dict[str, tuple[Column, float]]:
    """Four score formulas with their decision thresholds.

    They take the place of four fitted models where results must be exact.
    Scores are rounded so that many rows tie.
    """
    n, revenue = F.col("n_orders"), F.col("revenue")
    pending = F.coalesce(F.col("pending_avg"), F.lit(0.0))
    scores = [
        (F.round(0.7 * n + revenue / 1000000.0 + pending / 1000000.0, 2), 3.0),
        (n.cast("double"), 4.0),
        (F.round(revenue / 100000.0, 1), 9.0),
        (F.round(F.col("acctbal") / 100.0, 0), 80.0),
    ]
    return dict(zip(FORMULAS, scores))


def scored(observations: DataFrame, split: Column | None = None) -> DataFrame:
    """Long table (experiment, split, label, prediction, score), from one scan.

    Every observation is turned into one row per formula; the table is read
    once, however many formulas there are.
    """
    split = split_name(is_train()) if split is None else split
    results = F.array(
        *[
            F.struct(
                F.lit(name).alias("experiment"),
                (score >= at).cast("int").alias("prediction"),
                score.alias("score"),
            )
            for name, (score, at) in formula_scores().items()
        ]
    )
    return observations.select(
        split.alias("split"), F.col("main_label").alias("label"), F.inline(results)
    ).select("experiment", "split", "label", "prediction", "score")


def wide_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as feature vectors of length 64, class 0 the rare one."""
    from pyspark.ml.functions import array_to_vector

    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("label") == 0).cast("int").alias("label_bin"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
