"""How much of each feature is present, and which features to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions.long import long_form, per_feature, present
from rarebird.settings import MIN_COVERAGE


def coverage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, present values and their share for every feature, from one pass.

    An empty table has no rows here either.
    """
    return (
        long_form(df, features)
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(present()).alias("non_null"))
        .select(
            per_feature(features).alias("feature"),
            "n",
            "non_null",
            (F.col("non_null") / F.col("n").cast("double")).alias("share"),
        )
    )


def well_covered(
    df: DataFrame, features: Sequence[str], min_share: float = MIN_COVERAGE
) -> DataFrame:
    """Features present in at least ``min_share`` of the rows."""
    return coverage(df, features).where(F.col("share") >= min_share)


def poorly_covered(
    df: DataFrame, features: Sequence[str], min_share: float = MIN_COVERAGE
) -> DataFrame:
    """The features left out, with the share of rows that lack them."""
    dropped = coverage(df, features).where(F.col("share") < min_share)
    missing = (F.col("n") - F.col("non_null")) / F.col("n").cast("double")
    return dropped.select("feature", "n", "non_null", missing.alias("missing_share"))


def fit_features(
    train: DataFrame, features: Sequence[str], min_share: float = MIN_COVERAGE
) -> list[str]:
    """Names of the features worth using, in table order, judged on train rows.

    Without any rows there is nothing to judge by, and all features stay.
    """
    shares = {r.feature: r.share for r in coverage(train, features).collect()}
    return [f for f in features if not shares or shares[f] >= min_share]
