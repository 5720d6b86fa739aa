"""Row counts and distributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.columns import code_name, named
from rarebird.settings import COUNTRY_NAMES, LABEL_NAMES, SECTOR_NAMES, Roles


def row_counts(df: DataFrame) -> DataFrame:
    """Total, train and test rows of a split table."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )


def distribution(df: DataFrame, column: str, names: Mapping[int, str]) -> DataFrame:
    """Rows and per cent of all rows for each code, with its name, in code order.

    The shares come from a window over the handful of groups, not from a second
    pass over the rows.
    """
    everything = F.sum("n").over(W.partitionBy())
    return (
        df.groupBy(named(column).cast("int").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "key",
            code_name(F.col("key"), names).alias("name"),
            "n",
            (F.col("n") * 100.0 / everything).alias("pct"),
        )
        .orderBy("key")
    )


def label_distribution(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return distribution(df, roles.label, LABEL_NAMES)


def country_distribution(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return distribution(df, roles.country, COUNTRY_NAMES)


def sector_distribution(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return distribution(df, roles.sector, SECTOR_NAMES)


def profile(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Label, country and sector distribution from one scan, by grouping sets."""
    dimensions = [roles.label, roles.country, roles.sector]
    codes = df.select([named(c).cast("int").alias(c) for c in dimensions])
    sets = [[F.col(c)] for c in dimensions]
    dimension: Column = F.lit(None).cast("string")
    for c in dimensions:
        dimension = F.when(F.grouping(c) == 0, c).otherwise(dimension)
    counted = codes.groupingSets(sets, *dimensions).agg(
        dimension.alias("dimension"),
        F.count(F.lit(1)).alias("n"),
    )
    in_dimension = F.sum("n").over(W.partitionBy("dimension"))
    # Only the grouped column is filled in a row of its set.
    return counted.select(
        "dimension",
        F.coalesce(*dimensions).alias("key"),
        "n",
        (F.col("n") * 100.0 / in_dimension).alias("pct"),
    )
