"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Sources get weights in the order of their names and share a budget of words. Over
the training run each source's weight moves along a line, so its cumulative
demand of words is the line's integral. A copy of a document covers an interval of
its source's demand; inverting the demand at the interval's start gives the copy's
position in training, between 0 and 1, and documents are range-sorted by position.

Within a source, documents are laid out in the order of a hash of their id and text. The
running total of words over that order is found without sorting a source in one
task: hash buckets of some thousand rows are summed, bucket totals are run up per
source, and only rows of a bucket are put in order together.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.hashing import told
from rarebird.llm.common import WORD, free_name
from rarebird.sources.staging import stage

# Weights in the order of the sources, repeating; the budget as a
# share of all words; the most that a source's words are repeated.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_REPEAT = 2
# End of the fixed values.
#: A source's weight at the start and at the end of training, as multiples of its
#: mean, repeating like the weights: first sources fade, second ones grow.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows of a hash bucket, about.
BUCKET_ROWS = 1_000


def _cycle(values: Sequence[float], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """source, source_size, target, number of each source, from rows of source and size.

    Weighted shares that exceed ``max_repeat`` times the source's size stop there
    and the excess is shared again. The fixed point is found in one pass: with
    sources by ascending cap per weight, the first that can take its share of
    what the ones before it leave sets the level for all after it. One row per
    source, some of which may be empty; windows run over the sources only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "number")
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cycle(weights, F.col("number")))
        .withColumn("cap", max_repeat * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, W.unboundedFollowing)
    left = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    return (
        sources.withColumn("share", left / F.sum("weight").over(onwards))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "number", "share"))).over(everything)["share"])
        .select(
            "source",
            "source_size",
            "number",
            F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double"))
            .otherwise(F.col("level") * F.col("weight"))
            .alias("target"),
        )
    )


def position(done: Column, start: Column, end: Column) -> Column:
    """When a share ``done`` of a source's demand has been met, if its weight goes from ``start`` to ``end``.

    The inverse of u -> (start * u + (end - start) * u**2 / 2) / ((start + end) / 2).
    """
    total = start + end
    return done * total / (start + F.sqrt(start * start + (end - start) * total * done))


def lay_out(sizes: DataFrame, order: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``sizes`` (source, size, key and others) with ``begin``: the source's words before the row.

    ``key`` is a hexadecimal hash; rows of a source follow ``key``, then ``order``.
    """
    rows = sizes.count()
    bits = min(31, max(0, ceil(rows / bucket_rows) - 1).bit_length())
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucketed = sizes.withColumn("bucket", F.shiftright(prefix, 32 - bits))
    # Running totals in two steps, so that no window holds more than about the
    # square root of a source's buckets.
    coarse = F.shiftright("bucket", bits // 2)
    sums = bucketed.groupBy("source", "bucket", coarse.alias("part")).agg(F.sum("size").alias("words"))
    up_to = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    run = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    parts = (
        sums.groupBy(F.col("source").alias("from"), F.col("part").alias("p"))
        .agg(F.sum("words").alias("part_words"))
        .withColumn("before", run("part_words", up_to("from", "p")))
    )
    totals = (
        sums.withColumn("within", run("words", up_to("source", "part", "bucket")))
        .join(parts, F.col("source").eqNullSafe(F.col("from")) & (F.col("part") == F.col("p")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("nr"), (F.col("before") + F.col("within")).alias("ahead"))
    )
    inside = W.partitionBy("source", "bucket").orderBy("key", *order).rowsBetween(W.unboundedPreceding, -1)
    return (
        bucketed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("nr")))
        .withColumn("begin", F.col("ahead") + F.col("inside"))
        .drop("of", "nr", "ahead", "inside", "bucket")
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_repeat: int = MAX_REPEAT,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: the id, size, source_size, target, taken, copies, positions (of each copy taken), position (of the first), and columns ``keep``.

    Each source takes whole words up to the floor of its target, exactly: all of
    its documents in hash order, then again from the first; the last copy may be
    taken in part. Null texts have no words; a null source is one source; rows
    without words take no part (taken 0, no position). Rows follow a hash of id and
    text: those of one id are mixed each, like others. Rerunning gives the same.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source).cast("string").alias("source"),
            size.alias("size"),
            F.md5(F.concat(told([id_column]), F.md5(told([text])))).alias("key"),
            F.struct(*(F.col(c) for c in keep)).alias("kept") if keep else F.lit(0).alias("kept"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, budget, max_repeat).withColumnRenamed("source", "of")
    laid = lay_out(sizes, ["size"]).join(targets, F.col("source").eqNullSafe(F.col("of")))
    whole = F.floor("target")
    start, end = (_cycle([s[k] for s in schedules], F.col("number")) for k in (0, 1))

    def starts(n: int) -> Column:
        return n * F.col("source_size") + F.col("begin")

    none = F.lit(0).cast("long")
    taken = sum((F.greatest(none, F.least(F.col("size"), whole - starts(n))) for n in range(max_repeat)), none)
    places = [
        F.when((F.col("size") > 0) & (whole > starts(n)), position(starts(n) / F.col("target"), start, end))
        for n in range(max_repeat)
    ]
    mixed = laid.select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.filter(F.array(*places), lambda p: p.isNotNull()).alias("positions"),
        *(F.col(f"kept.{c}").alias(c) for c in keep),
    )
    return mixed.withColumn("copies", F.size("positions")).withColumn("position", F.get("positions", F.lit(0)))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The rows in training order: a row for each copy taken, whole, sorted by position.

    The columns are those of ``docs``. Documents that the mix does not take are
    left out; of the one that is taken in part the last copy stays whole.
    """
    place, row = free_name(docs, "place"), free_name(docs, "row_key")
    keyed = docs.withColumn(row, F.md5(told(docs.columns)))
    placed = mix(keyed, text, source, id_column, keep=[row]).select(row, F.explode("positions").alias(place))
    # Texts move once to meet their places: rows alike in all columns are one row here.
    return keyed.dropDuplicates([row]).join(placed, row).orderBy(place, row).select(*docs.columns)


#: What ``mix`` gives for the table documents, for DuckDB.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || md5(coalesce(length(text) || ':' || text, '-'))) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][number % 3 + 1] AS weight,
    [1.5::DOUBLE, 0.5, 1.0][number % 3 + 1] AS a, [0.5::DOUBLE, 1.5, 1.0][number % 3 + 1] AS b,
    2 * source_size AS cap
  FROM sources
), shares AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighted
), level AS (
  SELECT share AS level FROM shares WHERE ratio >= share ORDER BY ratio, number LIMIT 1
), targets AS (
  SELECT source, source_size, a, b,
    CASE WHEN ratio < level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target
  FROM shares, level
), laid AS (
  SELECT doc_id, size, source_size, target, a, b, CAST(floor(target) AS BIGINT) AS whole,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, whole - begin_)) + greatest(0, least(size, whole - source_size - begin_)) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 AND whole > begin_ THEN 1 ELSE 0 END
    + CASE WHEN size > 0 AND whole > source_size + begin_ THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CASE WHEN size > 0 AND whole > begin_
    THEN begin_ / target * (a + b) / (a + sqrt(a * a + (b - a) * (a + b) * (begin_ / target))) END AS position
FROM laid
"""
