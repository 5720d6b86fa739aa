"""Running totals over any number of rows, no window holding more than a bounded part.

Rows lie in numbered buckets of a group. Bucket totals are run up in two steps, over
parts of 2**(bits // 2) buckets and over the parts, so that neither step's window
holds more than about the square root of a group's buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_bits(rows: int, bucket_rows: int) -> int:
    """Bits of a bucket number, so that ``rows`` spread evenly put about ``bucket_rows`` in each."""
    return min(40, max(0, ceil(rows / bucket_rows) - 1).bit_length())


def hash_bucket(digest: Column, bits: int) -> Column:
    """The first ``bits`` bits, at most 40, of a hexadecimal digest as a number."""
    first = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")
    return F.shiftright(first, 40 - bits)


def run_before(value: Column, window) -> Column:
    """The sum of ``value`` over the rows before this one."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether columns are alike pairwise, nulls being alike too."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def totals_ahead(rows: DataFrame, group: str, bucket: str, value: str, bits: int) -> DataFrame:
    """of, nr, ahead, whole: per group and bucket the sum of the buckets before it, and of the whole group."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("held")).withColumn("part", F.shiftright(bucket, bits // 2))
    parts = sums.groupBy(F.col(group).alias("of"), F.col("part").alias("p")).agg(F.sum("held").alias("part_held"))
    parts = parts.select(
        "of",
        "p",
        run_before(F.col("part_held"), W.partitionBy("of").orderBy("p")).alias("before"),
        F.sum("part_held").over(W.partitionBy("of")).alias("whole"),
    )
    within = run_before(F.col("held"), W.partitionBy(group, "part").orderBy(bucket))
    return (
        sums.withColumn("within", within)
        .join(parts, same([group, "part"], ["of", "p"]))
        .select("of", F.col(bucket).alias("nr"), (F.col("before") + F.col("within")).alias("ahead"), "whole")
    )


def running_before(rows: DataFrame, group: str, bucket: str, order: Sequence[str], value: str, bits: int) -> DataFrame:
    """The rows with ``before``, the sum of ``value`` over the group's rows before each, and ``whole``, over all of them.

    Rows follow ``bucket``, then ``order``. A bucket's rows are put in order by one
    task: buckets must be small.
    """
    totals = totals_ahead(rows, group, bucket, value, bits)
    inside = run_before(F.col(value), W.partitionBy(group, bucket).orderBy(*order))
    return (
        rows.withColumn("inside", inside)
        .join(totals, same([group, bucket], ["of", "nr"]))
        .withColumn("before", F.col("ahead") + F.col("inside"))
        .drop("of", "nr", "ahead", "inside")
    )
