"""Mergeable quantile sketches of feature values, kept by year or any other column.

A sketch holds a bounded number of values of a feature, whatever the rows it stands
for, and sketches of parts merge to one of the whole. Stored once by year, they give
medians, or borders between equally many rows, of any set of years without reading
the observations again; a further year's rows add their own sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.functions.long import per_feature, present

#: Size parameter of a sketch: larger ones are more exact.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Bound of a quantile's rank error, as a share of all rows: three times what one query in a hundred exceeds."""
    return 3 * 2.296 / size**0.9021


def value_sketches(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``by``, feature, n and sketch: one row per group and feature with any value, from one pass.

    Null and NaN are missing and in no sketch. A null in ``by`` is a group of its own.
    """
    values = F.array(*[named(f).cast("double") for f in features])
    long = df.select(*map(named, by), values.alias("values")).select(*map(named, by), F.posexplode("values").alias("feature", "value"))
    counted = long.where(present()).groupBy(*map(named, by), "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch")
    )
    return counted.withColumn("feature", per_feature(features))


def merged(sketches: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Sketches of groups put together: those alike in ``by`` and feature become one."""
    return sketches.groupBy(*map(named, by), "feature").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch")
    )


def quantiles(sketches: DataFrame, share: float | Sequence[float]) -> DataFrame:
    """All columns but the sketch, and ``value``: the value below which the share of the rows lies, a list for a list of shares."""
    asked: Column = F.lit(float(share)) if isinstance(share, (int, float)) else F.array(*[F.lit(float(s)) for s in share])
    return sketches.withColumn("value", F.kll_sketch_get_quantile_double("sketch", asked)).drop("sketch")
