"""Observations laid out by year and key hash, so that one sample or split side reads only its files.

Files are put into folders by year and by the first digits of the hash that samples
go by. A sample is the rows whose hash lies below a bound, so all folders behind the
bound's are left alone; of the bound's own, Spark filters the rows. The columns of
the observations stay as they are; those of the folders are hidden from readers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarebird.functions.columns import named
from rarebird.functions.hashing import key_hash, share_bound
from rarebird.operators.sample import SAMPLE_SALT, hash_sample
from rarebird.operators.split import temporal_side
from rarebird.settings import SPLIT_YEAR

FOLDER_YEAR = "folder_year"
FOLDER_PLACE = "folder_place"
#: Hexadecimal digits of the hash a folder stands for: 16 folders a year.
DIGITS = 1


@dataclass(frozen=True)
class Layout:
    """A table of observations written by ``lay_out``, and how it was."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    year: str
    digits: int

    def _read(self, spark: SparkSession) -> DataFrame:
        folders = T.StructType(
            [T.StructField(FOLDER_YEAR, T.LongType()), T.StructField(FOLDER_PLACE, T.StringType())]
        )
        return spark.read.schema(T.StructType([*self.schema.fields, *folders.fields])).parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows."""
        return self._read(spark).drop(FOLDER_YEAR, FOLDER_PLACE)

    def sample(self, spark: SparkSession, fraction: float) -> DataFrame:
        """The rows of ``hash_sample``, from the folders that can hold any of them."""
        table = self._read(spark)
        if 0.0 < fraction < 1.0:
            table = table.where(F.col(FOLDER_PLACE) <= share_bound(fraction)[: self.digits])
        return hash_sample(table.drop(FOLDER_YEAR, FOLDER_PLACE), self.keys, fraction)

    def side(self, spark: SparkSession, which: str, last_train: int = SPLIT_YEAR, fraction: float = 1.0) -> DataFrame:
        """The rows of ``temporal_side``, of a sample if one is asked for, from the folders of its years."""
        table, year = self._read(spark), F.col(FOLDER_YEAR)
        if 0.0 < fraction < 1.0:
            table = table.where(F.col(FOLDER_PLACE) <= share_bound(fraction)[: self.digits])
        chosen = table.where({"train": year <= last_train, "test": year > last_train}[which])
        sampled = hash_sample(chosen.drop(FOLDER_YEAR, FOLDER_PLACE), self.keys, fraction)
        return temporal_side(sampled, which, self.year, last_train)


def lay_out(
    df: DataFrame, path: str, keys: Sequence[str], year: str = "year", digits: int = DIGITS
) -> Layout:
    """Write ``df`` to ``path``, a folder that does not exist yet.

    Rows meet by folder in one exchange that Spark evens out: folders of many rows
    are split among tasks and get several files. The year must be a whole number;
    rows without one have a folder of their own. An empty table has no folders.
    """
    if not isinstance(df.schema[year].dataType, T.IntegralType):
        raise ValueError(f"{year} must be a whole number to name folders")
    taken = {c.lower() for c in df.columns} & {FOLDER_YEAR, FOLDER_PLACE}
    if taken:
        raise ValueError(f"columns are named like folders: {sorted(taken)}")
    place = F.substring(key_hash(keys, SAMPLE_SALT), 1, digits)
    marked = df.withColumns({FOLDER_YEAR: named(year).cast("long"), FOLDER_PLACE: place})
    even = marked.hint("rebalance", F.col(FOLDER_YEAR), F.col(FOLDER_PLACE))
    even.write.partitionBy(FOLDER_YEAR, FOLDER_PLACE).parquet(path)
    return Layout(path, df.schema, tuple(keys), year, digits)
