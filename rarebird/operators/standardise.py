"""Zero mean and unit deviation per feature, on plain columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.functions.long import long_values, per_feature


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, deviation), deviation with n - 1, from one pass."""
    return (
        long_values(df, features)
        .groupBy("feature")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
        .select(per_feature(features).alias("feature"), "mean", "deviation")
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {r.feature: (r.mean, r.deviation) for r in scaler_stats(df, features).collect()}


def standardise(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Apply fitted means and deviations; a constant feature becomes 0."""
    columns = []
    for name in df.columns:
        column = named(name)
        if name in stats:
            mean, deviation = stats[name]
            if deviation:
                column = (column - mean) / deviation
            else:
                column = F.when(column.isNotNull(), 0.0)
            column = column.alias(name)
        columns.append(column)
    return df.select(columns)
