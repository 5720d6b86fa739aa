"""Row choice by key hash: the same rows however the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rarebird.functions.columns import named


def told(columns: Sequence[str]) -> Column:
    """The values as one text that differs wherever they do.

    Each value follows its length and a colon; a null is a dash.
    """
    parts = [named(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def key_hash(keys: Sequence[str], salt: str = "") -> Column:
    """MD5 of the key columns as text, 32 hex digits, uniform over the keys.

    Different salts give independent choices. Sampling and splitting must not
    share one, or a 10 % sample would fall into the train split as a whole.
    """
    if not keys:
        raise ValueError("a key is needed to choose rows reproducibly")
    text = told(keys)
    return F.md5(F.concat(F.lit(salt), text) if salt else text)


def share_bound(share: float) -> str:
    """The first eight digits of the least hash outside the given share of all hashes."""
    if not 0.0 < share < 1.0:
        raise ValueError(f"share must lie between 0 and 1, not {share}")
    return f"{int(share * 2**32):08x}"


def below_share(digest: Column, share: float) -> Column:
    """True for the given share of all hashes (resolution 2**-32)."""
    return F.substring(digest, 1, 8) < F.lit(share_bound(share))
