"""Sharding by proportional stratified interleaving, in DataFrame operations only.

The rows of each source are shuffled by a seeded hash and ranked; a rank divided by
the source's number of rows is a fractional rank, with which every source spreads
evenly over 0 to 1. Rows of all sources are sorted by it, and the order is cut into
shards of equal row counts, so that each shard holds every source in the share it
has in the whole, up to a row or two.

Neither ranking sorts a source or the table in one task. Ranks are running counts
over buckets of a uniform hash, and places in the whole order are running counts over
ranges of the fractional rank, which are as uniform. Rows alike in all that is ranked
are counted and ranked as one, so that copies of one row fill no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.functions.hashing import told
from rarebird.llm.common import free_name
from rarebird.llm.running import bucket_bits, hash_bucket, running_before, same
from rarebird.sources.staging import stage

SHARDS = 24
SEED = "shard-"
#: Bytes a document takes in a shard besides its text.
OVERHEAD = 8
#: Rows of a bucket, about.
BUCKET_ROWS = 1_000
#: Copies of a row that one task makes at a time.
COPIES = 1_000


def _share(text: Column) -> Column:
    """A number from 0 to below 1 that a text decides."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def ranked_in_source(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """source, key and other columns of ``rows``, each distinct row once, with n, rank and source_rows.

    ``key`` is a hexadecimal hash of the row. The ``n`` rows alike take the ranks from ``rank`` on.
    """
    bits = bucket_bits(rows.count(), bucket_rows)
    # Alike rows are counted where they are read, before anything moves.
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    bucketed = distinct.withColumn("bucket", hash_bucket(F.col("key"), bits))
    ranked = running_before(bucketed, "source", "bucket", ["key"], "n", bits)
    return ranked.withColumnRenamed("before", "rank").withColumnRenamed("whole", "source_rows").drop("bucket")


def copied(ranked: DataFrame, copies: int = COPIES) -> DataFrame:
    """A row for each of the ``n`` copies, with its own rank.

    A row with many copies is first cut into lots, which are dealt to all tasks.
    """
    many = ranked.filter(F.col("n") > copies)
    lots = many.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies))))
    lots = (
        lots.withColumn("rank", F.col("rank") + F.col("lot") * copies)
        .withColumn("n", F.least(F.lit(copies), F.col("n") - F.col("lot") * copies))
        .repartition("key", "lot")
        .drop("lot")
    )
    few = ranked.filter(F.col("n") <= copies).unionByName(lots)
    each = few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.withColumn("rank", F.col("rank") + F.col("copy")).drop("copy", "n")


def shard_rows(
    rows: DataFrame, shards: int = SHARDS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``rows`` (source, key and others) with fraction, shard and slot, shards of equal counts up to one.

    Each source's first row starts at a seeded offset below one rank, so that many
    small sources do not all fall on one place. Ties go by source, nulls last, then rank.
    """
    ranked = stage(ranked_in_source(rows, bucket_rows), "shard-ranks")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    bits = bucket_bits(total, bucket_rows)
    offset = _share(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    fraction = (F.col("rank") + offset) / F.col("source_rows")
    each = copied(ranked).withColumn("fraction", fraction)
    placed = running_before(
        each.select(
            "*",
            F.least(F.floor(F.col("fraction") * 2**bits), F.lit(2**bits - 1)).cast("long").alias("range"),
            F.lit(0).alias("all"),
            F.lit(1).alias("one"),
        ),
        "all",
        "range",
        ["fraction", F.col("source").asc_nulls_last(), "rank"],
        "one",
        bits,
    )
    place, whole = F.col("before"), F.col("whole")
    shard = F.expr(f"(before * {int(shards)}) div whole")
    first = F.expr(f"(shard * whole + {int(shards) - 1}) div {int(shards)}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", place - first)
        .drop("before", "whole", "range", "all", "one", "rank", "source_rows")
    )


def _sized(docs: DataFrame, text: str, id_column: str, source: str, seed: str, key: Column) -> DataFrame:
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    return docs.select(
        named(id_column).alias("id"),
        named(source).cast("string").alias("source"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed), key)).alias("key"),
    )


def shard_table(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per row: the id, size, text_crc32, law, shard, slot, grown_shard, source and fraction.

    The law is ``rows``: shards hold equal counts, at most one apart, whatever the
    texts' lengths. A null text is an empty one; a null source is a source, a null id
    an id like others. Rows are shuffled by a hash of id, source and text; rows alike
    in these three are interchangeable and lie side by side in the shuffle, spread
    over shards like other rows. Other columns, whatever their names, play no part.
    An empty table has an empty result; fewer rows than shards leave shards empty.
    """
    key = told([id_column, source, text])
    rows = stage(_sized(docs, text, id_column, source, seed, key), "shard-rows")
    return shard_rows(rows, shards, seed, bucket_rows).select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source").alias("source"),
        "fraction",
    )


def sharded_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    seed: str = SEED,
) -> DataFrame:
    """All columns of ``docs``, ``shard`` and ``slot``; these get another name where ``docs`` has theirs.

    Rows alike in all columns are interchangeable. Texts move once, to meet the row's
    places; other rules are those of ``shard_table``.
    """
    row, shard, slot = (free_name(docs, n) for n in ("row_key", "shard", "slot"))
    keyed = docs.withColumn(row, F.md5(F.concat(F.lit(seed), told(docs.columns))))
    rows = stage(keyed.select(named(source).cast("string").alias("source"), F.col(row).alias("key")), "shard-rows")
    placed = shard_rows(rows, shards, seed).select(
        F.col("key").alias("of"), F.col("shard").alias(shard), F.col("slot").alias(slot)
    )
    whole: Sequence[str] = docs.columns
    return keyed.dropDuplicates([row]).join(placed, same([row], ["of"])).select(*map(named, [*whole, shard, slot]))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **columns: str) -> None:
    """Write ``docs`` as a folder per shard, rows of a shard in the order of their slots in each file."""
    placed = sharded_documents(docs, shards, **columns)
    shard, slot = placed.columns[-2:]
    placed.repartition(shards, shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot).write.partitionBy(
        shard
    ).parquet(path)


#: What ``shard_table`` gives for the table documents, for DuckDB.
ORACLE = r"""
WITH polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), rows_ AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
    md5('shard-' || coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS key
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n,
    ('0x' || substr(md5('shard-' || coalesce('=' || source, '-')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
  FROM rows_
), placed AS (
  SELECT *, (rank + u) / n AS fraction, count(*) OVER () AS whole,
    row_number() OVER (ORDER BY (rank + u) / n, source NULLS LAST, rank) - 1 AS place
  FROM ranked
), cut AS (
  SELECT *, CAST(place * 24 // whole AS INTEGER) AS shard FROM placed
)
SELECT doc_id, CAST(octet_length(encode(body)) + 8 AS BIGINT) AS size,
  CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(body)), '..')]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  'rows' AS law, shard, CAST(place - (shard * whole + 23) // 24 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, source, fraction
FROM cut, polynomial
"""
