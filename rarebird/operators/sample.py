"""Samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions.hashing import below_share, key_hash, told
from rarebird.sources.staging import stage

SAMPLE_SALT = "sample-"
#: Hexadecimal digits that a round of the selection counts by: 4,096 prefixes at most.
DIGITS = 3
#: Distinct hashes that the last round may list.
LISTED = 10_000
#: Copies of a row that one task makes at a time.
COPIES = 10_000


def hash_sample(
    df: DataFrame, keys: Sequence[str], fraction: float = 1.0, salt: str = SAMPLE_SALT
) -> DataFrame:
    """About the given share of the rows; a fraction outside (0, 1) means all."""
    if not 0.0 < fraction < 1.0:
        return df
    return df.where(below_share(key_hash(keys, salt), fraction))


@dataclass(frozen=True)
class Cut:
    """The hash a selection ends in, the rows that have it, and how many of them are taken."""

    place: str
    held: int
    room: int


def select_place(places: DataFrame, n: int, digits: int = DIGITS, listed: int = LISTED) -> Cut | None:
    """Where the ``n`` least of the column ``place``, hashes of one length, end; None if there are fewer.

    Rows are counted by their first digits, those that share the prefix in which the
    selection ends by the digits after it, and so on, until the prefix holds few
    rows or has all digits. A round moves a count per prefix, whatever the rows.
    """
    prefix, room, held, width = "", n, None, None
    while width is None or len(prefix) < width:
        inside = places.where(F.col("place").startswith(prefix)) if prefix else places
        last = held is not None and held <= listed
        step = F.col("place") if last else F.substring("place", 1, len(prefix) + digits)
        counted = inside.groupBy(step.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.length("place")).alias("width")
        )
        for row in sorted(counted.collect(), key=lambda r: r["step"]):
            if row.n >= room:
                prefix, held, width = row["step"], row.n, row.width
                break
            room -= row.n
        else:
            return None
    return Cut(prefix, held, room)


def _copies(row: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the one row, made by as many tasks as needed."""
    lots = row.select(
        F.struct("*").alias("row"), F.explode(F.sequence(F.lit(0), F.lit((n - 1) // COPIES))).alias("lot")
    )
    many = F.least(F.lit(COPIES).cast("long"), F.lit(n) - F.col("lot").cast("long") * COPIES)
    dealt = lots.repartition("lot").select("row", F.explode(F.sequence(F.lit(1).cast("long"), many)))
    return dealt.select("row.*")


def exact_sample(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    digits: int = DIGITS,
    listed: int = LISTED,
    salt: str = SAMPLE_SALT,
) -> DataFrame:
    """Exactly ``n`` rows, those with the smallest key hashes (all if fewer).

    Rows that share a key follow a hash of all their columns, and rows alike in
    every column are interchangeable. The rows' key hashes are staged as the one
    narrow column in which the sample's end is selected by radix; the sample is then
    a filter on ``df``, which is read twice. Only if the end falls among rows of one
    key are these read once more, to select among the hashes of whole rows.
    """
    if n <= 0:
        return df.where(F.lit(False))
    key = key_hash(keys, salt)
    cut = select_place(stage(df.select(key.alias("place")), "sample-keys"), n, digits, listed)
    if cut is None:
        return df
    if cut.room == cut.held:
        return df.where(key <= cut.place)
    row, tied = F.md5(told(df.columns)), key == cut.place
    rows = stage(df.where(tied).select(row.alias("place")), "sample-rows")
    last = select_place(rows, cut.room, digits, listed)
    below = df.where((key < cut.place) | (tied & (row < last.place)))
    alike = df.where(tied & (row == last.place))
    return below.unionByName(alike if last.room == last.held else _copies(alike.limit(1), last.room))
