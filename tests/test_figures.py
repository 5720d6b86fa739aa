"""The derived observations have the figures that the SQL twins give for them in DuckDB at sf0.01."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rarebird.operators import coverage, medians, split
from rarebird.operators import evaluation as ev
from rarebird.sources import derived, observations, staging


@pytest.fixture(scope="module")
def table(spark):
    return staging.stage(derived.company_years(spark, f"{DATA}/sf0.01"), "observations")


def test_rows_and_labels(table):
    row = table.agg(F.count(F.lit(1)), F.sum("main_label"), F.count_distinct(*derived.KEY)).first()
    assert tuple(row) == (5845, 107, 5845)


def test_sides_of_both_splits(table):
    by_hash = split.hash_split(table, derived.KEY).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in by_hash} == {"train": 4655, "test": 1190}
    sides = split.temporal_split(table, last_train=1997).groupBy("split")
    got = {r.split: (r.n, r.p) for r in sides.agg(
        F.count(F.lit(1)).alias("n"), F.sum("main_label").alias("p")).collect()}
    assert got == {"train": (3519, 62), "test": (2326, 45)}


def test_train_coverage(table):
    train = split.side(split.hash_split(table, derived.KEY), "train")
    features = observations.feature_columns(train)
    shares = {r.feature: round(r.share, 4) for r in coverage.coverage(train, features).collect()}
    assert shares["order_sd"] == 0.5736 and shares["pending_avg"] == 0.5147
    assert shares["large_max"] == 0.0771 and shares["near_null_max"] == 0.0060
    kept = coverage.fit_features(train, features)
    assert "large_max" in kept and "near_null_max" not in kept
    assert medians.fit_exact_medians(train, ["order_sd"])["order_sd"] == pytest.approx(
        121536.6827, abs=0.0001
    )


def test_score_over_all_rows(table):
    scored = derived.scored(table).where("experiment = 's1_mixed'")
    got = ev.evaluate(scored, by=("experiment",)).first()
    assert (got.tp, got.fp, got.tn, got.fn) == (14, 968, 4770, 93)
    assert got.auc_roc == pytest.approx(0.49014359, abs=1e-8)
    assert got.auc_pr == pytest.approx(0.01776642, abs=1e-8)
