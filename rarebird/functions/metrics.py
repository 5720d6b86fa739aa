"""Quality figures of a binary classifier as expressions over its four counts.

All arithmetic is in double: the Matthews product overflows a bigint from about
a million rows on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rarebird.functions.columns import ratio
from rarebird.settings import Costs

METRICS = (
    "accuracy", "precision", "recall", "f1_weighted", "f1_positive", "f2", "mcc", "utility",
)


def f_score(hit: Column, false_alarm: Column, miss: Column, beta: float = 1.0) -> Column:
    """F-beta of one class from its hits, false alarms and misses."""
    weight = F.lit(float(beta * beta))
    gain = (weight + 1.0) * hit
    return ratio(gain, gain + weight * miss + false_alarm)


def confusion_metrics(costs: Costs = Costs()) -> dict[str, Column]:
    """Metric name to expression over the columns tp, tn, fp and fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    f1_positive = f_score(tp, fp, fn)
    f1_negative = f_score(tn, fn, fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    worth = costs.tp * tp + costs.tn * tn + costs.fp * fp + costs.fn * fn
    return {
        "accuracy": ratio(tp + tn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_weighted": ratio(f1_positive * (tp + fn) + f1_negative * (tn + fp), n),
        "f1_positive": f1_positive,
        "f2": f_score(tp, fp, fn, beta=2.0),
        "mcc": ratio(tp * tn - fp * fn, spread),
        "utility": ratio(worth, n),
    }
