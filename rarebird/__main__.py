"""Run a study from the command line or with spark-submit.

    spark-submit rarebird/__main__.py PATH [--sample F] [--output DIR] [--split temporal]

Prints profile, per-year split and result table; writes the result table as CSV
and a record of the run, both in place of an earlier run's or neither.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from rarebird.operators import profile, reports, split
from rarebird.plans.experiments import run_study
from rarebird.settings import EXPERIMENTS, SPLIT_YEAR, Roles
from rarebird.sources.observations import load_observations
from rarebird.sources.results import write_run
from rarebird.sources.staging import drop_staged


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="rarebird")
    parser.add_argument("path", help="Parquet table of observations")
    parser.add_argument("--sample", type=float, default=1.0, help="share of the rows to use")
    parser.add_argument("--output", help="folder for the result table and the run record")
    parser.add_argument("--split", choices=("random", "temporal"), default="random")
    parser.add_argument("--last-train-year", type=int, default=SPLIT_YEAR)
    parser.add_argument(
        "--key", nargs="+", default=["emis_id", "year"], help="columns that identify a row"
    )
    return parser.parse_args(given)


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    began = time.perf_counter()
    roles = Roles()
    table = load_observations(spark, options.path)
    profile.profile(table, roles).orderBy("dimension", "key").show(100, truncate=False)
    if options.split == "temporal":
        split.split_profile(table, roles.year, options.last_train_year).show(100)
    study = run_study(
        table,
        options.key,
        split=options.split,
        fraction=options.sample,
        roles=roles,
        last_train_year=options.last_train_year,
    )
    print(f"{len(study.features)} features kept, {study.components} components, {study.unlabelled} rows without label left out")
    evaluated = study.evaluated.persist()
    reports.experiment_table(evaluated).show(truncate=False)
    names = [e.name for e in EXPERIMENTS]
    for title, left, right in [("scaling", 0, 1), ("principal components", 1, 3)]:
        print(f"What {title} changes, from {names[left]} to {names[right]}")
        reports.ablation(evaluated, names[left], names[right]).show(truncate=False)
    if options.output:
        write_run(study.results, study.record() | {"total_seconds": time.perf_counter() - began}, options.output)
    evaluated.unpersist()
    print(f"took {time.perf_counter() - began:.1f} s in all")


if __name__ == "__main__":
    session = SparkSession.builder.appName("rarebird").getOrCreate()
    try:
        run(session, arguments())
    finally:
        drop_staged(session)
        session.stop()
