"""What the physical plans must not contain, and what must reach the scans."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rarebird.functions import long
from rarebird.functions.ordering import with_place
from rarebird.operators import coverage, evaluation, medians, sample, split
from rarebird.plans.queries import REGISTRY
from rarebird.sources import derived, layout, observations, staging

FOLDER = f"{DATA}/sf0.001"


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_products_and_no_python(spark, name):
    text = plan(REGISTRY[name](spark, FOLDER))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas",
                   "InArrow"):
        assert banned not in text, banned


@pytest.fixture(scope="module")
def table(spark):
    return staging.stage(derived.company_years(spark, FOLDER), "observations")


def test_year_condition_reaches_the_scan(table):
    both = split.temporal_split(table, last_train=1997)
    for which, pushed in [("train", "LessThanOrEqual(year,1997)"), ("test", "GreaterThan(year,1997)")]:
        chosen = split.temporal_side(table, which, last_train=1997)
        assert pushed in plan(chosen.select("n_orders"))
        assert chosen.exceptAll(split.side(both, which)).isEmpty()
        assert chosen.count() == split.side(both, which).count()


def test_layout_reads_only_the_folders_asked_for(spark, table):
    laid = layout.lay_out(table, staging.new_path(spark, "laid"), derived.KEY)
    every = laid.rows(spark)
    assert every.columns == table.columns
    assert every.exceptAll(table).isEmpty() and table.exceptAll(every).isEmpty()
    for fraction in (0.1, 0.5, 1.0):
        got, want = laid.sample(spark, fraction), sample.hash_sample(table, derived.KEY, fraction)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    for which in ("train", "test"):
        got, want = laid.side(spark, which, 1997), split.temporal_side(table, which, last_train=1997)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        for chosen, wanted in [
            (laid.sample(spark, 0.1), ["(folder_place <= 1)"]),
            (laid.side(spark, "test", 1997, 0.1), ["(folder_place <= 1)", "(folder_year > 1997)"]),
        ]:
            filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(chosen)).group(1)
            assert all(w in filters for w in wanted), filters
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_layout_of_awkward_rows(spark):
    rows = [(1, 1997, "x"), (1, 1997, "x"), (2, None, "y"), (None, 1998, None)]
    table = spark.createDataFrame(rows, "id int, year int, place string")
    laid = layout.lay_out(table, staging.new_path(spark, "laid"), ["id", "year"])
    assert laid.rows(spark).exceptAll(table).isEmpty() and laid.rows(spark).count() == 4
    assert [tuple(r) for r in laid.side(spark, "test", 1997).collect()] == [(None, None, "test")]
    assert laid.side(spark, "train", 1997).count() == 2
    empty = layout.lay_out(table.limit(0), staging.new_path(spark, "laid"), ["id"])
    assert empty.rows(spark).isEmpty() and empty.sample(spark, 0.5).isEmpty()
    with pytest.raises(ValueError, match="whole number"):
        layout.lay_out(table, staging.new_path(spark, "laid"), ["id"], year="place")


def test_only_wanted_columns_are_read(table):
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan(table.groupBy("country").count()))
    assert scan.group(1) == "country:int"
    cleaned = observations.clean(table)
    text = plan(coverage.coverage(cleaned, ["order_sd", "acctbal"]))
    assert re.search(r"ReadSchema: struct<([^>]*)>", text).group(1) == (
        "order_sd:double,acctbal:double"
    )


def test_coverage_moves_only_counts(table):
    text = plan(coverage.coverage(table, ["order_sd", "acctbal"]))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("partial_count") < text.index("Generate")


def test_split_and_cleaning_do_not_shuffle(table):
    divided = observations.clean(split.hash_split(table, derived.KEY), keep=("split",))
    assert "Exchange" not in plan(divided)


def test_orders_are_reduced_before_they_move(spark):
    text = plan(derived.company_years(spark, FOLDER))
    assert "partial_sum(o_totalprice)" in text
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate," in text


def test_scores_are_counted_before_they_move(spark):
    scored = staging.stage(derived.scored(derived.company_years(spark, FOLDER)), "scored")
    assert "partial_count" in plan(evaluation.histogram(scored))
    text = plan(evaluation.evaluate(scored))
    # Range totals (two steps), running sums, result.
    assert text.count("Exchange hashpartitioning") == 4
    assert "SinglePartition" not in text


def test_digits_are_counted_before_they_move(table):
    values = long.long_values(table, ["order_sd", "acctbal"])
    placed = with_place(values, "value", "place")
    text = plan(medians._count_digits(placed, F.shiftright("place", 52)))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning(feature, _groupingexpression")
    assert re.search(r"ReadSchema: struct<([^>]*)>", text).group(1) == (
        "order_sd:double,acctbal:double"
    )
