"""Train/test splits, each as one column instead of two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.functions.hashing import below_share, key_hash
from rarebird.settings import SPLIT_YEAR, TRAIN_SHARE


def hash_split(
    df: DataFrame, keys: Sequence[str], train_share: float = TRAIN_SHARE, salt: str = ""
) -> DataFrame:
    """Random split by key hash: independent of partitioning, order and retries."""
    train = below_share(key_hash(keys, salt), train_share)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def temporal_split(df: DataFrame, year: str = "year", last_train: int = SPLIT_YEAR) -> DataFrame:
    """Train up to and including a year, test after it; the year is then dropped.

    Rows without a year belong to neither side. Both sides come from one scan;
    to read only one of them, take ``temporal_side``.
    """
    when = named(year)
    split = F.when(when <= last_train, "train").otherwise("test")
    return df.where(when.isNotNull()).withColumn("split", split).drop(year)


def temporal_side(
    df: DataFrame, which: str, year: str = "year", last_train: int = SPLIT_YEAR
) -> DataFrame:
    """One side of the temporal split, without the year.

    The condition on the year reaches the scan: it skips row groups, and whole
    folders of a table partitioned by year.
    """
    when = named(year)
    chosen = {"train": when <= last_train, "test": when > last_train}[which]
    return df.where(chosen).withColumn("split", F.lit(which)).drop(year)


def split_profile(df: DataFrame, year: str = "year", last_train: int = SPLIT_YEAR) -> DataFrame:
    """Rows per year with the side of the temporal split, in year order."""
    split = F.when(F.col("year") <= last_train, "train").otherwise("test")
    return (
        df.where(named(year).isNotNull())
        .groupBy(named(year).cast("int").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("year", split.alias("split"), "n")
        .orderBy("year")
    )


def side(df: DataFrame, split: str) -> DataFrame:
    """One side of a split table."""
    return df.where(F.col("split") == split)


def split_policies(df: DataFrame, policies: Mapping[str, Column]) -> DataFrame:
    """Every row once per split policy, in the columns policy and split.

    Compares ways of splitting from one scan. A row whose split is null under a
    policy is left out there.
    """
    choices = F.array(
        *[F.struct(F.lit(p).alias("policy"), s.alias("split")) for p, s in policies.items()]
    )
    return df.select("*", F.inline(choices)).where("split IS NOT NULL")
