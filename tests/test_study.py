"""The whole study, its result file, and the staged tables behind it."""

import random

import pytest
from conftest import DATA
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rarebird import __main__ as command
from rarebird.operators import coverage, forest, profile, reports, tally, weights
from rarebird.operators import evaluation as ev
from rarebird.operators.split import hash_split, side
from rarebird.plans import experiments
from rarebird.plans.experiments import fit_all, prepare, run_study, score_all
from rarebird.settings import EXPERIMENTS, ForestSettings
from rarebird.sources import derived, results, staging
from rarebird.sources.observations import clean, feature_columns, labelled

TINY = ForestSettings(trees=6, depth=4, min_rows_per_leaf=3)
NAMES = [e.name for e in EXPERIMENTS]


@pytest.fixture(scope="module")
def observations(spark):
    return staging.stage(derived.company_years(spark, f"{DATA}/sf0.01"), "observations")


@pytest.fixture(scope="module")
def study(observations):
    return run_study(observations, derived.KEY, settings=TINY)


def test_study_scores_every_row_once_per_experiment(study, observations):
    counts = study.scored.groupBy("experiment").count().collect()
    assert {r.experiment for r in counts} == set(NAMES)
    assert {r["count"] for r in counts} == {observations.count()}
    bounds = study.scored.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= bounds[0] <= bounds[1] <= 1.0


def test_study_features(study):
    assert "near_null_max" not in study.features  # hardly ever present
    assert "year" in study.features and "is_large" in study.features
    assert not {"emis_id", "company", "industry", "main_label", "split"} & set(study.features)


def test_study_reports_components_unlabelled_rows_and_time(study, observations):
    assert study.components == len(study.features) < 50 and study.unlabelled == 0
    assert study.total_seconds > max(study.seconds.values())
    some = observations.withColumn("main_label", F.when(F.col("n_orders") != 2, F.col("main_label")))
    missing = observations.where("n_orders = 2").count()
    again = run_study(some, derived.KEY, experiments=EXPERIMENTS[:1], settings=TINY)
    assert missing > 0 and again.unlabelled == missing
    assert again.evaluated.agg(F.sum("n")).first()[0] == observations.count() - missing


def test_equal_experiments_share_a_model(study):
    rows = {(r.experiment, r.split): r for r in study.evaluated.collect()}
    for s in ("train", "test"):
        third, fourth = rows[NAMES[2], s], rows[NAMES[3], s]
        assert [third[m] for m in ev.AREAS] == [fourth[m] for m in ev.AREAS]
    assert study.seconds[NAMES[2]] == study.seconds[NAMES[3]]
    assert all(s > 0 for s in study.seconds.values())


def test_study_learns(study):
    rows = {(r.experiment, r.split): r for r in study.evaluated.collect()}
    assert rows[NAMES[0], "train"].auc_roc > 0.6
    assert rows[NAMES[0], "train"].n + rows[NAMES[0], "test"].n == 5845


def test_temporal_study(observations):
    study = run_study(
        observations, derived.KEY, split="temporal", settings=TINY, last_train_year=1997,
        experiments=EXPERIMENTS[:1],
    )
    assert "year" not in study.features
    rows = {r.split: r for r in study.evaluated.collect()}
    assert (rows["train"].n, rows["test"].n) == (3519, 2326)
    shown = study.results.first()
    assert shown.TestF1 == round(rows["test"].f1_positive, 4)
    assert shown.TestPRAUC == round(rows["test"].average_precision, 4)


def test_sampled_study(observations):
    study = run_study(
        observations, derived.KEY, fraction=0.3, settings=TINY, experiments=EXPERIMENTS[:1]
    )
    total = sum(r.n for r in study.evaluated.collect())
    assert 0.25 * 5845 < total < 0.35 * 5845


def test_unknown_split_is_refused(observations):
    with pytest.raises(ValueError):
        run_study(observations, derived.KEY, split="stratified")


def test_prepared_rows_train_a_forest(spark, observations):
    """Both splits are prepared, evaluated, and fit for a forest of their own."""
    prepared, features = prepare(hash_split(observations, derived.KEY))
    assert prepared.select("split").distinct().count() == 2
    fitted = fit_all(prepared, len(features), EXPERIMENTS[:1], TINY)
    shared = ev.evaluate(score_all(prepared, len(features), fitted, EXPERIMENTS[:1]))
    train = side(prepared, "train").withColumnRenamed("label", "main_label")
    model = forest.forest("features", settings=TINY).fit(staging.dealt(train, 8, "deal"))
    assert model.getNumTrees == TINY.trees
    assert {r.split for r in shared.collect()} == {"train", "test"}


@pytest.mark.parametrize("scale,pca", [(False, False), (True, False), (False, True), (True, True)])
def test_pipeline_stages(spark, scale, pca):
    stages = [type(s).__name__ for s in forest.forest_pipeline(list("ab"), scale, pca).getStages()]
    middle = (["StandardScaler"] if scale or pca else []) + (["PCA"] if pca else [])
    assert stages == ["Imputer", "VectorAssembler", *middle, "RandomForestClassifier"]


def test_pipelines_of_all_flags_run(spark, observations):
    """From cleaned columns to predictions; components standardise, asked for or not."""
    cleaned = clean(hash_split(observations, derived.KEY), keep=("split",))
    train = side(labelled(cleaned), "train")
    features = coverage.fit_features(train, feature_columns(cleaned, exclude=("split",)))
    rows = staging.dealt(weights.fit_class_weights(train).apply(train).withColumn("deal", F.xxhash64(*features)), 8, "deal").persist()
    shares = {}
    for scale, pca in [(False, False), (True, False), (False, True), (True, True)]:
        fitted = forest.forest_pipeline(features, scale, pca, TINY, k=5).fit(rows)
        shares[scale, pca] = [tuple(r) for r in fitted.transform(rows).groupBy("prediction").count().orderBy("prediction").collect()]
        assert fitted.stages[-1].numFeatures == (5 if pca else len(features))
    rows.unpersist()
    assert all(sum(n for _, n in found) == train.count() for found in shares.values())
    assert shares[False, True] == shares[True, True]


def test_an_experiment_is_a_model_of_its_own(spark, observations, tmp_path):
    """Each experiment's pipeline, saved and loaded, gives the study's scores."""
    prepared, features = prepare(hash_split(observations, derived.KEY), keys=derived.KEY)
    fitted = fit_all(prepared, len(features), EXPERIMENTS, TINY)
    scored = score_all(prepared, len(features), fitted, EXPERIMENTS)
    for e, stages in zip(EXPERIMENTS, (1, 2, 3, 3)):
        path = str(tmp_path / e.short_name)
        fitted.pipeline(e).write().save(path)
        model = PipelineModel.load(path)
        assert len(model.stages) == stages
        vector = model.stages[-1].getFeaturesCol()
        own = model.transform(prepared).select(
            "split", F.col("label").cast("int"), F.col("prediction_" + vector).cast("int").alias("prediction"),
            vector_to_array("probability_" + vector)[1].alias("score"),
        )
        study = scored.where(F.col("experiment") == e.name).select(own.columns)
        assert own.exceptAll(study).isEmpty() and study.exceptAll(own).isEmpty(), e.name


def test_forests_score_even_parts_one_at_a_time(spark, observations, monkeypatch):
    """From one file of all rows, every forest's part has the rows in about equal files."""
    prepared, features = prepare(hash_split(observations, derived.KEY).coalesce(1), keys=derived.KEY)
    fitted = fit_all(prepared, len(features), EXPERIMENTS, TINY)
    monkeypatch.setattr(staging, "SCORED_ROWS", 500)
    scored = score_all(prepared, len(features), fitted, EXPERIMENTS)
    files = scored.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("experiment").alias("experiments")
    ).collect()
    n = prepared.count()
    parts = -(-n // 500)
    assert len(files) == 3 * parts and sum(r.n for r in files) == 4 * n
    assert all(r.n <= 1.1 * n / parts * len(r.experiments) for r in files)
    assert {frozenset(r.experiments) for r in files} == {frozenset(NAMES[:1]), frozenset(NAMES[1:2]), frozenset(NAMES[2:])}


def test_forest_settings(spark):
    made = forest.forest("features")
    got = {p.name: v for p, v in made.extractParamMap().items()}
    assert (got["numTrees"], got["maxDepth"], got["minInstancesPerNode"]) == (100, 10, 10)
    assert (got["featureSubsetStrategy"], got["seed"]) == ("sqrt", 42)


def test_result_file(spark, study, tmp_path):
    path = str(tmp_path / "results")
    results.write_results(study.results, path)
    rows = results.read_results(spark, path).collect()
    assert [r.Experiment for r in rows] == NAMES  # in order, commas and all
    back = {r.Experiment: r for r in rows}
    assert back[NAMES[0]].short_name == "Baseline"
    for r in study.results.drop("TrainTime_s").collect():
        for column, value in r.asDict().items():
            assert back[r.Experiment][column] == value


def test_a_failed_run_leaves_the_one_before(spark, study, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    results.write_run(study.results, study.record(), path)
    broken = study.results.withColumn("TestAcc", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        results.write_run(broken, {"total_seconds": 1.0}, path)
    assert results.read_run(spark, path)[1].first().total_seconds == study.total_seconds
    results.write_run(study.results, {"total_seconds": 2.0}, path)
    table, record = results.read_run(spark, path)
    assert [r.Experiment for r in table.collect()] == NAMES and record.first().total_seconds == 2.0
    assert [p.name for p in tmp_path.iterdir()] == ["run"]


def test_partitions_follow_from_the_rows(spark):
    made = ForestSettings()
    assert [made.partitions(n) for n in (0, 1, 400_000, 400_001, 10**9)] == [8, 8, 8, 9, 20_000]


def test_train_rows_are_dealt_once(spark, observations):
    """All fits read the kept rows, which are let go behind them."""
    prepared, features = prepare(hash_split(observations, derived.KEY), keys=derived.KEY)
    seen = []
    kept = experiments.kept

    def watched(df):
        seen.append(df)
        return kept(df)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(experiments, "kept", watched)
        fitted = fit_all(prepared, len(features), EXPERIMENTS, TINY)
    assert len(seen) == 1 and not seen[0].is_cached
    assert fitted.partitions == seen[0].rdd.getNumPartitions() == 8
    assert fitted.rows == side(prepared, "train").count() and set(fitted.forests) == {"features", "scaled", "components"}


def test_published_result_layout(spark, tmp_path):
    """A file with TP.. columns, names without commas and a trailing line of text."""
    metrics = ["Acc", "AUC", "PRAUC", "Prec", "Recall", "F1", "F2", "MCC", "Utility"]
    head = ["Experiment", *[s + m for m in metrics for s in ("Train", "Test")]]
    head += ["TP", "TN", "FP", "FN", "TrainTime_s"]
    row = ["Baseline (no scaling  no PCA)", *["0.5"] * 18, "674", "196519", "3296", "1", "100.1"]
    text = [",".join(head), ",".join(row), "," * 23, "Total wall-clock time: 895.7 s" + "," * 23]
    file = tmp_path / "published.csv"
    file.write_text("\n".join(text))
    rows = results.read_results(spark, str(file)).collect()
    assert len(rows) == 1
    assert (rows[0].Test_TP, rows[0].Test_FN, rows[0].TrainTime_s) == (674, 1, 100.1)
    assert rows[0].short_name == "Baseline"


def test_result_table_definitions(study):
    cluster = study.results.where(F.col("Experiment") == NAMES[0]).first()
    local = reports.result_table(
        study.evaluated, study.seconds, reports.LOCAL_DEFINITIONS, digits=None
    )
    local = local.where(F.col("Experiment") == NAMES[0]).first()
    row = study.evaluated.where((F.col("experiment") == NAMES[0]) & (F.col("split") == "test"))
    exact = row.first()
    assert cluster.TestF1 == round(exact.f1_weighted, 4)
    assert local.TestF1 == exact.f1_positive
    assert local.TestPRAUC == exact.average_precision


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or staging.shared_folder(spark) == before
    table = staging.stage(spark.range(10).selectExpr("id", "id % 2 AS side"), "t", "side")
    assert table.where("side = 1").count() == 5


def test_dealing_depends_on_the_rows_alone(spark):
    def dealt(parts):
        table = spark.range(0, 1000, 1, parts).selectExpr("id", "xxhash64(id) AS deal")
        return staging.dealt(table, 4, "deal").rdd.glom().collect()

    assert dealt(2) == dealt(4) == dealt(8)


def test_command_line(spark, observations, tmp_path, capsys, monkeypatch):
    small = str(tmp_path / "small")
    observations.write.parquet(small)
    monkeypatch.setattr(
        command, "run_study", lambda *a, **k: run_study(*a, **k, settings=TINY)
    )
    options = command.arguments(
        [small, "--split", "temporal", "--last-train-year", "1997", "--output", f"{tmp_path}/out"]
    )
    command.run(spark, options)
    assert "features kept" in capsys.readouterr().out
    table, record = results.read_run(spark, f"{tmp_path}/out")
    assert table.count() == 4
    run = record.first()
    assert run.total_seconds >= max(run.training_seconds.values()) > 0 and run.train_rows == 3519
    assert run.train_partitions == TINY.partitions(run.train_rows) == 8


def test_tally_agrees_with_separate_counts(spark, observations):
    """Missing and unknown labels, NaN, features that are hardly there; no feature; no row."""
    label = F.when(F.col("n_orders") == 2, None).when(F.col("n_orders") == 3, 7).otherwise(F.col("main_label"))
    some = observations.withColumn("main_label", label).withColumn("gaps", F.when(F.col("n_orders") == 4, F.lit("NaN").cast("double")))
    cleaned = clean(hash_split(some, derived.KEY), keep=("split",))
    names = feature_columns(cleaned, exclude=("split",))
    got = tally.take_tally(cleaned, names)
    train = labelled(side(cleaned, "train"))
    counts = profile.row_counts(labelled(cleaned)).first()
    assert (got.count("train"), got.count("test")) == (counts.train, counts.test) and counts.train > counts.test > 0
    assert got.unlabelled == cleaned.where("main_label IS NULL").count() > 0
    assert got.rows["train", tally.OTHER] == train.where("main_label = 7").count() > 0
    shares = {r.feature: r.share for r in coverage.coverage(train, names).collect()}
    assert {f: got.coverage(f) for f in names} == shares and shares["gaps"] == 0
    assert got.features(names) == coverage.fit_features(train, names) != names
    assert got.weights() == weights.fit_class_weights(train)
    none = tally.take_tally(cleaned, [])
    assert none.rows == got.rows and none.present == {}
    empty = tally.take_tally(cleaned.limit(0), names)
    assert empty.rows == {} and empty.features(names) == names and empty.count("train") == empty.unlabelled == 0


@pytest.mark.parametrize("medians,passes", [("approximate", 3), ("exact", 1)])
def test_preparing_reads_the_input_a_known_number_of_times(spark, observations, medians, passes):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    # The pandas function stands for the input: it counts the rows that pass.
    watched = hash_split(observations, derived.KEY).mapInPandas(counted, hash_split(observations, derived.KEY).schema)
    made = experiments.prepare_counted(watched, medians=medians, keys=derived.KEY)
    assert read.value == passes * observations.count()
    assert made.counts.count("train") == side(made.table, "train").count()


def test_rows_that_change_between_the_passes_are_noticed(spark, observations):
    def some(frames):
        r = random.SystemRandom()
        for frame in frames:
            yield frame[[r.random() < 0.5 for _ in range(len(frame))]]

    divided = hash_split(observations, derived.KEY)
    with pytest.raises(ValueError, match="have changed"):
        prepare(divided.mapInPandas(some, divided.schema), keys=derived.KEY)
