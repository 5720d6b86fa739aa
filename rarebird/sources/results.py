"""The result table of a study, one row per experiment, written as real CSV, and its run record."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarebird.settings import EXPERIMENTS

# Column names of the published result file, with the metric each
# one shows. Train and test stand side by side.
RESULT_METRICS = {
    "Acc": "accuracy",
    "AUC": "auc_roc",
    "PRAUC": "pr_auc",
    "Prec": "precision",
    "Recall": "recall",
    "F1": "f1",
    "F2": "f2",
    "MCC": "mcc",
    "Utility": "utility",
}
CELLS = ("TP", "TN", "FP", "FN")

RESULT_SCHEMA = T.StructType(
    [T.StructField("Experiment", T.StringType())]
    + [
        T.StructField(side + short, T.DoubleType())
        for short in RESULT_METRICS
        for side in ("Train", "Test")
    ]
    + [T.StructField("Test_" + cell, T.LongType()) for cell in CELLS]
    + [T.StructField("TrainTime_s", T.DoubleType())]
)

#: One row for a run: what the result table does not say.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("total_seconds", T.DoubleType()),
        T.StructField("training_seconds", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("components", T.IntegerType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("train_partitions", T.IntegerType()),
        T.StructField("unlabelled", T.LongType()),
    ]
)


def write_results(results: DataFrame, path: str) -> None:
    """Write a result table as one CSV file with a header, in its row order.

    One output file is right here only because there is a row per experiment.
    """
    results.select(RESULT_SCHEMA.names).coalesce(1).write.mode("overwrite").csv(
        path, header=True
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Read a result table, with the short experiment names added.

    Takes files with ``TP`` as well as ``Test_TP`` column names, and skips rows
    that hold no metrics (blank lines, a trailing line with the total time).
    """
    raw = spark.read.csv(path, header=True)
    for cell in CELLS:
        if cell in raw.columns:
            raw = raw.withColumnRenamed(cell, "Test_" + cell)
    typed = raw.select(
        [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields]
    )
    # Some files lost the comma inside an experiment name; compare without it.
    bare = F.regexp_replace("Experiment", "[, ]+", " ")
    short = F.lit(None).cast("string")
    for e in EXPERIMENTS:
        short = F.when(bare == e.name.replace(",", ""), e.short_name).otherwise(short)
    return typed.where(F.col("TestAcc").isNotNull()).withColumn("short_name", short)


def write_run(results: DataFrame, record: Mapping, path: str) -> None:
    """Write the folders ``results`` (CSV) and ``run`` (the record, JSON) of ``path``, both or neither.

    They are written beside ``path`` and renamed when complete: a run that fails
    leaves what was there before.
    """
    spark = results.sparkSession
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    row = tuple(record.get(name) for name in RECORD_SCHEMA.names)
    try:
        write_results(results, f"{made}/results")
        spark.createDataFrame([row], RECORD_SCHEMA).coalesce(1).write.json(f"{made}/run")
        _publish(spark, made, path)
    finally:
        # Nothing is left under this name if the run was published.
        files, folder = _files(spark, made)
        files.delete(folder, True)


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The result table, as ``read_results`` gives it, and the record of a written run."""
    return read_results(spark, f"{path}/results"), spark.read.schema(RECORD_SCHEMA).json(f"{path}/run")


def _publish(spark: SparkSession, made: str, path: str) -> None:
    """Put a complete folder in the place of another; put that one back if this fails."""
    files, target = _files(spark, path)
    new, old = (_files(spark, p)[1] for p in (made, made + ".old"))
    replaced = files.exists(target)
    if replaced and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(new, target):
        if replaced:
            files.rename(old, target)
        raise OSError(f"cannot move {made} to {path}")
    if replaced:
        files.delete(old, True)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system a path lies in, and the path there."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found
