"""Metrics: published figures, Spark's own evaluators, edge cases."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from rarebird.operators import evaluation as ev
from rarebird.operators.prefix_sums import sums_before
from rarebird.operators import reports
from rarebird.settings import Costs

# Published test counts and the metrics that belong to them.
PUBLISHED = [
    ("baseline", 674, 196519, 3296, 1,
     dict(accuracy=0.9836, precision=0.1698, recall=0.9985, f1_weighted=0.9893,
          f2=0.5052, mcc=0.4083, utility=-0.0131)),
    ("scaler", 674, 196767, 3048, 1,
     dict(accuracy=0.9848, precision=0.1811, recall=0.9985, f1_weighted=0.99,
          f2=0.5248, mcc=0.422, utility=-0.0119)),
    ("pca", 637, 187402, 12413, 38,
     dict(accuracy=0.9379, precision=0.0488, recall=0.9437, f1_weighted=0.9649,
          f2=0.2022, mcc=0.207, utility=-0.0606)),
    ("scaler and pca", 637, 187402, 12413, 38,
     dict(accuracy=0.9379, precision=0.0488, recall=0.9437, f1_weighted=0.9649,
          f2=0.2022, mcc=0.207, utility=-0.0606)),
]


def counts(spark, rows):
    schema = "experiment string, split string, tp bigint, tn bigint, fp bigint, fn bigint"
    return spark.createDataFrame(rows, schema)


def scored(spark, rows, experiment="e", split="test"):
    schema = "experiment string, split string, label int, prediction int, score double"
    return spark.createDataFrame([(experiment, split, *r) for r in rows], schema)


def test_published_figures(spark):
    rows = [(name, "test", tp, tn, fp, fn) for name, tp, tn, fp, fn, _ in PUBLISHED]
    got = {r.experiment: r for r in ev.with_metrics(counts(spark, rows)).collect()}
    checked = 0
    for name, *_, figures in PUBLISHED:
        assert got[name].n == 200_490
        for metric, value in figures.items():
            assert round(got[name][metric], 4) == value, (name, metric)
            checked += 1
    assert checked == 28


def test_large_counts_do_not_overflow(spark):
    big = 10**13
    row = ev.with_metrics(counts(spark, [("e", "test", big, big, big, big)])).first()
    assert row.mcc == 0.0 and row.accuracy == 0.5
    row = ev.with_metrics(counts(spark, [("e", "test", big, 9 * big, 0, 0)])).first()
    assert row.mcc == pytest.approx(1.0)


def test_nothing_predicted_and_nothing_there(spark):
    row = ev.with_metrics(counts(spark, [("e", "test", 0, 90, 0, 10)])).first()
    assert (row.precision, row.recall, row.f2, row.mcc, row.f1_positive) == (0, 0, 0, 0, 0)
    assert row.utility == pytest.approx(-1.0)
    row = ev.with_metrics(counts(spark, [("e", "test", 0, 0, 0, 0)])).first()
    assert [row[m] for m in ("accuracy", "f1_weighted", "utility")] == [0, 0, 0]


def test_costs_are_a_parameter(spark):
    frame = counts(spark, [("e", "test", 1, 1, 1, 1)])
    row = ev.with_metrics(frame, Costs(tp=2, tn=1, fp=-3, fn=-8)).first()
    assert row.utility == pytest.approx(-2.0)


def random_rows(n, seed, ties):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        label = int(pick.random() < 0.15)
        score = pick.random() * 0.7 + 0.3 * label * pick.random()
        score = round(score, 2) if ties else score
        rows.append((label, int(score >= 0.5), score))
    return rows


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("ranges", [1, 7, 10_000])
def test_agrees_with_spark_evaluators(spark, ties, ranges):
    table = scored(spark, random_rows(3000, 5, ties))
    got = ev.evaluate(table, ranges=ranges).first()
    typed = table.select(
        F.col("label").cast("double").alias("label"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("score").alias("rawPrediction"),
    )
    for metric, column in [("areaUnderROC", "auc_roc"), ("areaUnderPR", "auc_pr")]:
        own = BinaryClassificationEvaluator(metricName=metric, numBins=0).evaluate(typed)
        assert got[column] == pytest.approx(own, abs=1e-9)
    for metric, column in [("accuracy", "accuracy"), ("f1", "f1_weighted")]:
        own = MulticlassClassificationEvaluator(metricName=metric).evaluate(typed)
        assert got[column] == pytest.approx(own, abs=1e-12)
    own = MulticlassClassificationEvaluator(
        metricName="fMeasureByLabel", beta=2.0, metricLabel=1.0
    ).evaluate(typed)
    assert got.f2 == pytest.approx(own, abs=1e-12)


def average_precision_by_hand(rows):
    """Step-wise sum over distinct scores, straight from the definition."""
    total = sum(label for label, _, _ in rows)
    area, found_before = 0.0, 0
    for cut in sorted({s for _, _, s in rows}, reverse=True):
        taken = [label for label, _, s in rows if s >= cut]
        area += (sum(taken) - found_before) / total * sum(taken) / len(taken)
        found_before = sum(taken)
    return area


@pytest.mark.parametrize("ranges", [None, 1, 5, 100])
def test_average_precision(spark, ranges):
    rows = random_rows(400, 9, ties=True)
    got = ev.evaluate(scored(spark, rows), ranges=ranges).first()
    assert got.average_precision == pytest.approx(average_precision_by_hand(rows), abs=1e-12)


def test_one_class_only(spark):
    negatives = ev.evaluate(scored(spark, [(0, 0, 0.1), (0, 1, 0.9)])).first()
    assert (negatives.auc_roc, negatives.auc_pr, negatives.average_precision) == (0, 0, 0)
    positives = ev.evaluate(scored(spark, [(1, 0, 0.1), (1, 1, 0.9)])).first()
    assert positives.auc_roc == 0.0 and positives.tp == 1 and positives.fn == 1


def test_one_score_for_all(spark):
    got = ev.evaluate(scored(spark, [(1, 1, 0.5)] * 3 + [(0, 1, 0.5)] * 9)).first()
    assert got.auc_roc == pytest.approx(0.5)
    assert got.auc_pr == pytest.approx(0.25)


def test_unusual_scores(spark):
    inf = float("inf")
    rows = [(1, 1, inf), (0, 0, -inf), (1, 1, 0.7), (0, 0, 0.2), (1, 1, float("nan"))]
    got = ev.evaluate(scored(spark, rows)).first()
    assert got.auc_roc == pytest.approx(1.0)
    assert (got.tp, got.tn, got.fp, got.fn) == (3, 2, 0, 0)


def test_unlabelled_rows_count_nowhere(spark):
    got = ev.evaluate(scored(spark, [(1, 1, 0.9), (0, 0, 0.1), (None, 1, 0.5)])).first()
    assert got.n == 2 and got.auc_roc == 1.0


def test_hot_score_and_partitioning_change_nothing(spark):
    rows = random_rows(1500, 3, ties=False) + [(0, 0, 0.25)] * 3000 + [(1, 0, 0.25)] * 30
    table = scored(spark, rows)
    results = [
        [round(v, 12) if isinstance(v, float) else v for v in ev.evaluate(t, ranges=b).first()]
        for t in (table, table.repartition(1), table.repartition(8, "score"))
        for b in (3, 400)
    ]
    assert all(r == results[0] for r in results)


def test_sums_before_in_any_number_of_levels(spark):
    rows = [(g, b, (b * 7 + len(g or "")) % 5, b % 3) for g in ("a", "bb", None) for b in range(0, 40, 1 if g else 3)]
    table = spark.createDataFrame(rows, "g string, block int, p int, q int")
    want = {
        (g, b): (
            sum(x[2] for x in rows if x[0] == g and x[1] < b),
            sum(x[3] for x in rows if x[0] == g and x[1] < b),
            sum(x[2] for x in rows if x[0] == g),
        )
        for g, b, *_ in rows
    }
    for fan in (2, 3, 7, 100):
        got = sums_before(table, ["g"], "block", ["p", "q"], 40, fan).collect()
        assert {(r.g, r.block): (r.p_before, r.q_before, r.all_p) for r in got} == want and len(got) == len(rows)


def test_ranges_hold_a_bounded_number_of_scores(spark, monkeypatch):
    monkeypatch.setattr(ev, "RANGE_ROWS", 500)
    rows = random_rows(6000, 5, ties=False) + [(0, 0, 0.25)] * 3000
    counted, n = ev.score_ranges(scored(spark, rows))
    held = [r["count"] for r in counted.groupBy("range").count().collect()]
    assert n == 18 and len(held) > 9 and max(held) < 3 * 500
    # Ranges are in order of score, so no other rows belong between theirs.
    ends = counted.groupBy("range").agg({"score": "max"}).orderBy("range").collect()
    assert [r[1] for r in ends] == sorted((r[1] for r in ends), reverse=True)


def test_groups_are_independent(spark):
    one, two = random_rows(300, 1, True), random_rows(200, 2, True)
    both = scored(spark, one, "a").unionByName(scored(spark, two, "b", "train"))
    together = {(r.experiment, r.split): r for r in ev.evaluate(both, ranges=10).collect()}
    for rows, e, s in [(one, "a", "test"), (two, "b", "train")]:
        alone = ev.evaluate(scored(spark, rows, e, s)).first()
        assert together[e, s].auc_pr == pytest.approx(alone.auc_pr, abs=1e-12)
        assert together[e, s].n == len(rows)


def test_confusion_and_evaluation_agree_on_nulls(spark):
    rows = [
        ("a", 1, 1, 0.9), ("a", 0, 0, 0.1), ("a", 0, None, 0.2), ("a", 1, 1, None), ("a", None, 1, 0.5),
        (None, 1, 0, 0.4), (None, 0, 1, 0.6),
    ]
    table = spark.createDataFrame(
        [(e, "test", *r) for e, *r in rows], "experiment string, split string, label int, prediction int, score double"
    )
    cells = lambda df: {r.experiment: (r.tp, r.tn, r.fp, r.fn) for r in df.collect()}
    expected = {"a": (1, 1, 0, 0), None: (0, 0, 1, 1)}
    assert cells(ev.confusion(table)) == cells(ev.evaluate(table)) == expected
    assert {r.experiment: (r.left_out, r.rows) for r in ev.left_out(table).collect()} == {"a": (3, 5), None: (0, 2)}


def test_reports(spark):
    base = random_rows(300, 1, True)
    shifted = [(label, int(s >= 0.4), s) for label, _, s in base]
    table = scored(spark, base, "a").unionByName(scored(spark, shifted, "b"))
    table = table.unionByName(scored(spark, base, "a", "train"))
    evaluated = ev.evaluate(table)
    rows = {r.experiment: r for r in evaluated.where("split = 'test'").collect()}
    delta = {r.metric: r for r in reports.ablation(evaluated, "a", "b").collect()}
    assert delta["recall"].delta == pytest.approx(rows["b"].recall - rows["a"].recall)
    assert delta["auc_roc"].delta == pytest.approx(0.0, abs=1e-12)
    change = {r.cell: r.change for r in reports.confusion_change(evaluated, "a", "b").collect()}
    assert change["tp"] == -change["fn"] and change["fp"] == -change["tn"]
    assert reports.best_experiment(evaluated, "recall").first().experiment == "b"
    assert reports.best_experiment(evaluated, "auc_roc").first().experiment == "a"
    shares = reports.confusion_shares(evaluated).groupBy("experiment", "split").sum("pct")
    assert all(r[2] == pytest.approx(100.0) for r in shares.collect())
    wide = {r.experiment: r for r in reports.experiment_table(evaluated).collect()}
    assert wide["a"].train_recall == wide["a"].test_recall
    assert wide["b"].train_recall is None
