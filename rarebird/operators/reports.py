"""Comparison tables over evaluated experiments.

Their input has a row per experiment and split. Two experiments are set side by
side by conditional aggregation, so the evaluation behind them runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.functions.metrics import METRICS
from rarebird.operators.evaluation import AREAS, COUNTS
from rarebird.sources.results import CELLS, RESULT_METRICS, RESULT_SCHEMA

SPLITS = ("train", "test")
# Metric definitions of the two published result files.
CLUSTER_DEFINITIONS = {"f1": "f1_weighted", "pr_auc": "auc_pr"}
LOCAL_DEFINITIONS = {"f1": "f1_positive", "pr_auc": "average_precision"}


def _pick(condition: Column, value: str) -> Column:
    """The value of the one row of a group that meets the condition."""
    return F.max(F.when(condition, F.col(value)))


def experiment_table(evaluated: DataFrame, digits: int = 4) -> DataFrame:
    """A row per experiment: rounded metrics of both splits, test counts."""
    split = F.col("split")
    columns = [
        F.round(_pick(split == s, m), digits).alias(f"{s}_{m}")
        for m in (*METRICS, *AREAS)
        for s in SPLITS
    ]
    cells = [_pick(split == "test", c).alias(c) for c in COUNTS]
    return evaluated.groupBy("experiment").agg(*columns, *cells).orderBy("experiment")


def metrics_long(
    evaluated: DataFrame, by: Sequence[str] = ("experiment", "split"),
    metrics: Sequence[str] = (*METRICS, *AREAS),
) -> DataFrame:
    """(…, metric, value): a row per group and metric."""
    values = evaluated.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot(list(by), list(metrics), "metric", "value")


def compare(long: DataFrame, dimension: str, left: str, right: str) -> DataFrame:
    """(metric, left, right, delta): right minus left along one dimension."""
    at = F.col(dimension)
    return (
        long.groupBy("metric")
        .agg(_pick(at == left, "value").alias("left"), _pick(at == right, "value").alias("right"))
        .withColumn("delta", F.col("right") - F.col("left"))
    )


def ablation(evaluated: DataFrame, left: str, right: str, split: str = "test") -> DataFrame:
    """Change of every metric from one experiment to another, on one split."""
    return compare(metrics_long(evaluated.where(F.col("split") == split)), "experiment", left, right)


def confusion_change(counts: DataFrame, left: str, right: str, split: str = "test") -> DataFrame:
    """Change of tp, tn, fp and fn from one experiment to another."""
    rows = counts.where(F.col("split") == split)
    cells = rows.unpivot(["experiment"], list(COUNTS), "cell", "n")
    at = F.col("experiment")
    return (
        cells.groupBy("cell")
        .agg(_pick(at == left, "n").alias("left"), _pick(at == right, "n").alias("right"))
        .withColumn("change", F.col("right") - F.col("left"))
    )


def confusion_shares(counts: DataFrame) -> DataFrame:
    """Every confusion cell with its share of the rows, in per cent."""
    total = (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("total")
    cells = counts.select("experiment", "split", total, *COUNTS).unpivot(
        ["experiment", "split", "total"], list(COUNTS), "cell", "n"
    )
    share = F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total"))
    return cells.select("experiment", "split", "cell", "n", share.alias("pct"))


def best_experiment(evaluated: DataFrame, metric: str = "auc_pr", split: str = "test") -> DataFrame:
    """The experiment with the highest metric on a split; ties go by name."""
    return (
        evaluated.where(F.col("split") == split)
        .select("experiment", "split", F.lit(metric).alias("metric"), F.col(metric).alias("value"))
        .orderBy(F.desc("value"), "experiment")
        .limit(1)
    )


def metric_extremes(evaluated: DataFrame) -> DataFrame:
    """(split, metric, lowest, highest) over the experiments."""
    return (
        metrics_long(evaluated)
        .groupBy("split", "metric")
        .agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    )


def headline(evaluated: DataFrame, plain: str, reduced: str, split: str = "test") -> DataFrame:
    """One row: the best recall, MCC and PR area, and what PR area reduction costs."""
    at = F.col("experiment")
    return evaluated.where(F.col("split") == split).agg(
        F.max("recall").alias("best_recall"),
        F.max("mcc").alias("best_mcc"),
        F.max("auc_pr").alias("best_auc_pr"),
        (_pick(at == plain, "auc_pr") - _pick(at == reduced, "auc_pr")).alias("pca_drop"),
    )


def result_table(
    evaluated: DataFrame,
    times: dict[str, float],
    definitions: dict[str, str] = CLUSTER_DEFINITIONS,
    digits: int | None = 4,
) -> DataFrame:
    """The result file's layout, with the training time of each experiment.

    Experiments come in the order of ``times``.
    """
    split = F.col("split")

    def shown(metric: str, side: str) -> Column:
        value = _pick(split == side.lower(), definitions.get(metric, metric))
        return value if digits is None else F.round(value, digits)

    def by_name(values: dict) -> Column:
        table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        return F.try_element_at(table, F.col("Experiment"))

    metrics = [
        shown(metric, side).alias(side + short)
        for short, metric in RESULT_METRICS.items()
        for side in ("Train", "Test")
    ]
    cells = [_pick(split == "test", c.lower()).alias("Test_" + c) for c in CELLS]
    table = evaluated.groupBy(F.col("experiment").alias("Experiment")).agg(*metrics, *cells)
    ordered = table.orderBy(by_name({name: i for i, name in enumerate(times)}))
    return ordered.withColumn("TrainTime_s", F.round(by_name(times), 1)).select(
        RESULT_SCHEMA.names
    )
