"""One query per operator, over its whole table, and the same in SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rarebird.llm import (
    backoff_scores,
    bit_sliced,
    conversation_trie,
    curriculum,
    dart_minhash,
    html_wrappers,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    shared_prefix,
    spelling_variants,
    token_counts,
)
from rarebird.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents do the base rules and the learned decision list keep?"""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely is each document under the pairs of words of all documents?"""
    return backoff_scores.backoff_scores(table(spark, sf_dir, "documents"))


def op2_backoff_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely is each document under the triples of words of all documents?"""
    return backoff_scores.ngram_scores(table(spark, sf_dir, "documents"), order=3)


def op3_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ten vectors have the largest inner product with every hundredth?"""
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is the main text of each page?"""
    return html_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good is each document, from 0 to 1?"""
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words does the mix take of each document, and when in training?"""
    mixed = curriculum.mix(table(spark, sf_dir, "documents")).drop("positions")
    return mixed.orderBy("position", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens has each document?"""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which secrets stand where in each document?"""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How does each document encode, and does it decode to itself?"""
    return shared_prefix.encoded_report(table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class of near-duplicates is each document in?"""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which beginnings do the rebuilt conversations share?"""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), splice=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all documents are spelling variants of which?"""
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shard, and which place in it, does each document get?"""
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the corpus that training gets, encoded, in training order."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


REGISTRY: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_rules,
        op2_backoff_scores,
        op2_backoff_scores_order3,
        op3_bit_sliced_topk,
        op4_html_extraction,
        op5_quality_classifier,
        op6_curriculum_mix,
        op7_token_counts,
        op8_secret_scan,
        op9_sentencepiece,
        op10_dart_minhash,
        op11_conversation_trie,
        op12_spelling_variants,
        op13_stratified_shards,
        pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op2_backoff_scores": backoff_scores.ORACLE,
    "op2_backoff_scores_order3": backoff_scores.ORACLE_OF_THREE,
    "op3_bit_sliced_topk": bit_sliced.ORACLE,
    "op6_curriculum_mix": curriculum.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_stratified_shards": sharding.ORACLE,
}
