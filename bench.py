"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores.
Every query runs to completion into a no-op sink. Sessions and code paths are
warmed up on the smallest tables first, so compile time is not what is measured.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rarebird.plans.experiments import run_study  # noqa: E402
from rarebird.plans.queries import REGISTRY  # noqa: E402
from rarebird.sources import derived, staging  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "clean_features",
    "profile_all",
    "hash_split",
    "exact_sample",
    "feature_coverage",
    "weighted_rows",
    "feature_medians",
    "impute_exact",
    "standardise",
    "covariance_pairs",
    "pca_project",
    "metrics_all",
    "auc_pr",
    "experiment_table",
    "split_comparison",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(FOLDER), "sf0.001")
    warm = warm if os.path.isdir(warm) else FOLDER
    for name in HEADLINE:
        run(REGISTRY[name](spark, warm))
    run_study(staging.stage(derived.company_years(spark, warm), "warm"), derived.KEY)

    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(REGISTRY[name](spark, FOLDER))
        seconds[name] = time.perf_counter() - began

    # The four experiments at full size: 100 trees of depth 10 each.
    observations = staging.stage(derived.company_years(spark, FOLDER), "observations")
    began = time.perf_counter()
    study = run_study(observations, derived.KEY, parallelism=3)
    evaluated = study.evaluated.collect()
    seconds["full_study"] = time.perf_counter() - began
    rows = sum(r.n for r in evaluated if r.experiment == evaluated[0].experiment)

    scale = re.search(r"sf([\d.]+)$", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries and the full study",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": float(scale.group(1)) if scale else None,
                "cpus": CPUS,
                "study_rows": rows,
                "study_training_sec": {k: round(v, 2) for k, v in study.seconds.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
