"""Many feature columns as rows, for aggregating wide tables.

Hundreds of aggregates side by side are too much for generated code, and their
partial results all meet in one task. One row per feature and value, aggregated
by feature before anything moves, is faster and spreads over as many tasks as
there are features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.functions.columns import named


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) for every row and feature, features by their position.

    The array is made in a step of its own: there it is generated code, inside
    the explode it would be interpreted.
    """
    values = df.select(F.array(*[named(f).cast("double") for f in features]).alias("values"))
    return values.select(F.posexplode("values").alias("feature", "value"))


def present() -> Column:
    """Whether a value is there: neither null nor NaN."""
    return F.col("value").isNotNull() & ~F.isnan("value")


def long_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The long form without missing values."""
    return long_form(df, features).where(present())


def per_feature(values: Sequence) -> Column:
    """The entry that belongs to a row's feature, from one constant per feature."""
    return F.array(*[F.lit(v) for v in values])[F.col("feature")]
