"""All quality metrics of all experiments and splits from one aggregation.

Input is a long table of scored rows: the columns of ``by`` (experiment, split),
label and prediction (0 or 1) and score. It is reduced to counts per distinct
score, the histogram; every metric is an expression over that.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.columns import ratio
from rarebird.functions.metrics import confusion_metrics
from rarebird.operators.prefix_sums import alike, sums_before
from rarebird.settings import Costs
from rarebird.sources.staging import stage

BY = ("experiment", "split")
AREAS = ("auc_roc", "auc_pr", "average_precision")
COUNTS = ("tp", "tn", "fp", "fn")
#: Scored rows of a score range, at most about.
RANGE_ROWS = 50_000


def countable(scored: DataFrame) -> Column:
    """Whether a row counts: label and prediction are 0 or 1, and a score, if there is one, is known."""
    known = F.col("label").isin(0, 1) & F.col("prediction").isin(0, 1)
    known = known & F.col("score").isNotNull() if "score" in scored.columns else known
    return F.coalesce(known, F.lit(False))


def left_out(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per group: rows that count in no metric, and all rows."""
    return scored.groupBy(*by).agg(
        F.count_if(~countable(scored)).alias("left_out"), F.count(F.lit(1)).alias("rows")
    )


def confusion(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """tp, tn, fp and fn per group, in one pass; a few counters leave each task."""
    scored = scored.where(countable(scored))
    positive, predicted = F.col("label") == 1, F.col("prediction") == 1
    negative, rejected = F.col("label") == 0, F.col("prediction") == 0
    return scored.groupBy(*by).agg(
        F.count_if(positive & predicted).alias("tp"),
        F.count_if(negative & rejected).alias("tn"),
        F.count_if(negative & predicted).alias("fp"),
        F.count_if(positive & rejected).alias("fn"),
    )


def with_metrics(counts: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Add n and every metric that follows from tp, tn, fp and fn."""
    n = (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n")
    metrics = [m.alias(name) for name, m in confusion_metrics(costs).items()]
    return counts.select("*", n, *metrics)


def histogram(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Positives and negatives per distinct score, and how many were predicted.

    Rows are counted where they are before anything moves, so a score that very
    many rows share costs no more than any other.
    """
    positive, negative = F.col("label") == 1, F.col("label") == 0
    predicted = F.col("prediction") == 1
    return scored.groupBy(*by, "score").agg(
        F.count_if(positive).alias("pos"),
        F.count_if(negative).alias("neg"),
        F.count_if(positive & predicted).alias("tp"),
        F.count_if(negative & ~predicted).alias("tn"),
        F.count_if(negative & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"),
    )


def score_ranges(scored: DataFrame, by: Sequence[str] = BY, ranges: int | None = None) -> tuple[DataFrame, int]:
    """The histogram with ``range``, numbered from the top score of each group down; staged. And the number of ranges.

    Ranges hold about ``RANGE_ROWS`` rows by Spark's own range partitioning; their
    number follows from the rows of ``scored``. Where their borders lie has no
    effect on any result.
    """
    if ranges is None:
        ranges = max(1, ceil(scored.count() / RANGE_ROWS))
    counted = histogram(scored.where(countable(scored)), by)
    # NaN ranks above all numbers, as it does in a sort.
    dealt = counted.repartitionByRange(ranges, *by, F.desc("score"))
    return stage(dealt.withColumn("range", F.spark_partition_id()), "score-ranges"), ranges


def _running_counts(scored: DataFrame, by: Sequence[str], ranges: int | None) -> DataFrame:
    """Histogram with TP and FP as if all scores from the top down were predicted.

    A running sum over all scores of a group would sort them in one task. Here
    each score range is summed by itself, starting from the totals of the ranges
    before it, which are summed in groups if there are many of them.
    """
    counted, n = score_ranges(scored, by, ranges)
    keys = [*by, "range"]
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    starts = sums_before(totals, by, "range", ["pos", "neg"], n)
    starts = starts.withColumnsRenamed({k: f"start_{k}" for k in keys})
    downwards = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    # The totals have one row per group and range. Whether that is little enough
    # to broadcast is left to Spark; partitioning both sides by the join's keys
    # is no loss, as the running sums need the histogram that way.
    joined = counted.join(starts, alike(keys, [f"start_{k}" for k in keys]))
    return joined.select(
        *by,
        *[F.col(c).cast("double") for c in ("pos", "neg", "all_pos", "all_neg")],
        *COUNTS,
        (F.col("pos_before") + F.sum("pos").over(downwards)).cast("double").alias("pos_so_far"),
        (F.col("neg_before") + F.sum("neg").over(downwards)).cast("double").alias("neg_so_far"),
    )


def _areas() -> list:
    """Areas as sums over the scores of a group, highest score first."""
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("pos_so_far"), F.col("neg_so_far")
    tp_before, fp_before = tp - pos, fp - neg
    precision = tp / (tp + fp)
    start = (tp_before + fp_before) == 0
    precision_before = F.when(start, precision).otherwise(
        tp_before / F.when(~start, tp_before + fp_before)
    )
    all_pos, all_neg = F.first("all_pos"), F.first("all_neg")
    return [
        ratio(F.sum(neg * (tp + tp_before)), 2.0 * all_pos * all_neg).alias("auc_roc"),
        ratio(F.sum(pos * (precision + precision_before)), 2.0 * all_pos).alias("auc_pr"),
        ratio(F.sum(pos * precision), all_pos).alias("average_precision"),
    ]


def evaluate(
    scored: DataFrame,
    by: Sequence[str] = BY,
    costs: Costs = Costs(),
    ranges: int | None = None,
) -> DataFrame:
    """Counts, threshold metrics and areas for every group; areas are exact.

    One narrow pass over the scored rows builds the histogram; all else reads that.
    Rows that ``countable`` refuses are left out here as they are by ``confusion``,
    and ``left_out`` counts them.
    """
    curve = _running_counts(scored, by, ranges)
    totals = curve.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        *_areas(),
    )
    return with_metrics(totals, costs)


def areas(scored: DataFrame, by: Sequence[str] = BY, ranges: int | None = None) -> DataFrame:
    """The three areas alone, in the columns auc_roc, auc_pr, average_precision."""
    return evaluate(scored, by, ranges=ranges).select(*by, *AREAS)


def utility_baseline(
    scored: DataFrame, by: Sequence[str] = BY, costs: Costs = Costs()
) -> DataFrame:
    """Utility of calling every row negative, the least a model must beat."""
    positives, negatives = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    worth = costs.fn * positives.cast("double") + costs.tn * negatives.cast("double")
    return scored.groupBy(*by).agg(
        (positives + negatives).alias("n"),
        positives.alias("positives"),
        ratio(worth, positives + negatives).alias("utility"),
    )


def with_lift(evaluated: DataFrame) -> DataFrame:
    """Add the share of positives and how far the PR area lies above it."""
    prevalence = ratio(F.col("tp") + F.col("fn"), F.col("n"))
    return evaluated.withColumn("prevalence", prevalence).withColumn(
        "lift", ratio(F.col("auc_pr"), F.col("prevalence"))
    )
