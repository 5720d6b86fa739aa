"""The corpus pipeline on a small table, stage by stage."""

import os

import corpus_pipeline
from conftest import DATA

from rarebird.llm import dart_minhash, secret_scan, shared_prefix
from rarebird.sources.staging import shared_folder, stage


def test_stages_do_what_they_say(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], folder), f"test-{name}"))
    raw, good, single, masked, mixed, encoded = tables
    assert all(t.columns == columns for t in tables[:-1])
    assert good.exceptAll(raw).count() == 0 and 0 < good.count() < raw.count()
    classes = dart_minhash.near_duplicates(good)
    assert single.count() == classes.select("class_id").distinct().count()
    assert secret_scan.secret_report(masked).filter("n_assign + n_access > 0").count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0
    assert mixed.select("doc_id").distinct().join(masked, "doc_id", "left_anti").count() == 0
    decoded = shared_prefix.decode(encoded).select("doc_id", "text")
    assert decoded.exceptAll(mixed.select("doc_id", "text")).count() == 0 and decoded.count() == mixed.count()


def test_only_the_last_table_stays(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    (left,) = set(os.listdir(folder)) - before
    assert os.listdir(f"{folder}/{left}") == ["pipeline-sentencepiece"]
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and got.count() > 0
