"""Running sums over blocks of rows, however many blocks there are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks that one window runs over at most; more are put into groups first.
FAN = 1_000


def alike(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether columns are pairwise alike; null is a value like any other."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def sums_before(
    blocks: DataFrame, by: Sequence[str], block: str, values: Sequence[str], count: int, fan: int = FAN
) -> DataFrame:
    """``by``, ``block``, and per value its sum over the group's blocks before, and over all of the group.

    ``blocks`` has a row for each group and block, numbered from 0 to below ``count``;
    the sums are named ``<value>_before`` and ``all_<value>``. Up to ``fan`` blocks
    are summed in a window. More of them are put into groups of ``fan``, whose sums are
    found in the same way, so no window holds more than ``fan`` rows.
    """
    if count <= fan:
        whole = W.partitionBy(*by)
        before = whole.orderBy(block).rowsBetween(W.unboundedPreceding, -1)
        return blocks.select(
            *by,
            block,
            *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values],
            *[F.sum(v).over(whole).alias(f"all_{v}") for v in values],
        )
    upper = f"{block}_of"
    grouped = blocks.withColumn(upper, F.floor(F.col(block) / fan).cast("int"))
    groups = grouped.groupBy(*by, upper).agg(*[F.sum(v).alias(v) for v in values])
    above = sums_before(groups, by, upper, values, -(-count // fan), fan)
    keys = [*by, upper]
    above = above.select(
        *[F.col(k).alias(f"at_{k}") for k in keys],
        *[F.col(f"{v}_before").alias(f"{v}_ahead") for v in values],
        *[f"all_{v}" for v in values],
    )
    within = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    local = grouped.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"{v}_local") for v in values])
    return local.join(above, alike(keys, [f"at_{k}" for k in keys])).select(
        *by,
        block,
        *[(F.col(f"{v}_ahead") + F.col(f"{v}_local")).alias(f"{v}_before") for v in values],
        *[f"all_{v}" for v in values],
    )
