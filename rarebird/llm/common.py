"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
#: ``bytes.split()`` cuts UTF-8 at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries a worker's word cache may hold before it starts anew.
CACHE_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text, in order; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A name like ``wanted`` that no column of ``df`` bears, in either case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def tokenizer_path(path: str) -> str:
    """A path as given, or the installed public file of that name."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class Hashes(dict):
    """CRC-32 of a word, remembered within a bound."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return value
