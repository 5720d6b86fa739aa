"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text is cut into words and runs of marks. Features are hashes of words, pairs
of words, and runs of three word shapes (letters' case, digits, marks, "same as
the word before"), so that looks generalise to words never seen. A feature's
value is its share among the text's n-grams; a score is a sparse dot product.

Training follows the regularised leader per coordinate (FTRL-proximal). Shards of
the training rows are passed over one after another within a shard and side by
side across shards; after each pass the shards' states are averaged per
coordinate by an aggregation, and the next pass starts from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import CACHE_WORDS, Hashes

#: Labelled rows trained on at most: those with the smallest MD5 of their id.
MAX_TRAINING_ROWS = 30_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_BITS = 18
_DIM = 1 << _BITS


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 12.0
    passes: int = 3
    shards: int = 8


def _shape(word: str) -> str:
    if word.isalpha():
        return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    return "0" if word.isdigit() else word[:3]


class _Shapes(dict):
    def __init__(self, hashes: Hashes):
        self.hashes = hashes

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.hashes["\x01" + _shape(word)]
        return value


_hashes = Hashes()
_shapes = _Shapes(_hashes)
_SAME = np.uint32(0x5BD1E995)


def feature_ids(text: str | None) -> np.ndarray:
    """Ids of all n-grams of a text, repeats included; none for a text without words."""
    found = _TOKEN.findall(text) if text else []
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint32, n)
    s = np.fromiter(map(_shapes.__getitem__, found), np.uint32, n)
    s[1:][w[1:] == w[:-1]] ^= _SAME
    mix = lambda x: x ^ (x >> np.uint32(15))
    pairs = mix(w[:-1] * np.uint32(0x9E3779B1) + w[1:] * np.uint32(0x85EBCA77))
    shape = mix(s * np.uint32(0xC2B2AE3D))
    runs = mix((s[:-2] * np.uint32(0x27D4EB2F) + s[1:-1]) * np.uint32(0x165667B1) + s[2:])
    ids = np.concatenate([mix(w), pairs, shape, runs])
    return ((ids * np.uint32(0x2545F491)) >> np.uint32(32 - _BITS)).astype(np.int64)


def _values(text: str | None, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features; the bias has the id past the last hash."""
    ids, counts = np.unique(feature_ids(text), return_counts=True)
    values = counts * (scale / max(1, counts.sum()))
    return np.append(ids, _DIM), np.append(values, 1.0)


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    small = np.abs(z) <= s.l1
    return np.where(small, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def ftrl_pass(texts: list, labels: list, z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass over the rows, in order; changes z and n."""
    for text, y in zip(texts, labels):
        ids, x = _values(text, s.scale)
        w = _weights(z[ids], n[ids], s)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / s.alpha
        z[ids] += g - sigma * w
        n[ids] += g * g


def train(rows: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from rows of text, label and key; the order of rows doesn't matter.

    A model has 2**18 + 1 weights, whatever is trained on. Without rows all are 0.
    """
    s = settings
    context = rows.sparkSession.sparkContext
    z, n = np.zeros(_DIM + 1), np.zeros(_DIM + 1)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(s.shards)).cast("int"))
    for _ in range(s.passes):
        sent = context.broadcast((z, n))
        shards = sharded.groupBy("shard").applyInPandas(_shard_pass(sent, s), "shard int, z binary, n binary").collect()
        # A coordinate is averaged over the shards that have met it; at most
        # ``shards`` states of 4 MB come to the driver.
        z, n, met = np.zeros(_DIM + 1), np.zeros(_DIM + 1), np.zeros(_DIM + 1)
        for row in sorted(shards, key=lambda r: r["shard"]):
            zs, ns = np.frombuffer(row["z"]), np.frombuffer(row["n"])
            z, n, met = z + zs, n + ns, met + (ns > 0)
        z, n = z / np.maximum(met, 1), n / np.maximum(met, 1)
        sent.unpersist()
    return _weights(z, n, s)


def _shard_pass(sent, s: Settings):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in sent.value)
        frame = frame.sort_values(["key", "text"])
        ftrl_pass(frame["text"].tolist(), frame["label"].tolist(), z, n, s)
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "z": [z.tobytes()], "n": [n.tobytes()]})

    return one


def scorer(df: DataFrame, weights: np.ndarray, settings: Settings = Settings()) -> Column:
    """A function of a text column: the chance of label 1. The weights (2 MB) are broadcast."""
    sent, scale = df.sparkSession.sparkContext.broadcast(weights), settings.scale

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for texts in batches:
            out = np.empty(len(texts))
            for k, text in enumerate(texts.tolist()):
                ids = feature_ids(text)
                out[k] = w[ids].sum() * (scale / max(1, len(ids))) + w[_DIM]
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return score


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learned from; those without id are among them."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(True))


def training_rows(
    docs: DataFrame, labels: DataFrame, text: str, id_column: str, label: str, max_rows: int = MAX_TRAINING_ROWS
) -> DataFrame:
    known = (
        labels.filter(F.col(label).isin(0, 1) & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.min(label).cast("double").alias("label"))
        .withColumn("key", F.md5(F.col("id").cast("string")))
    )
    some = known.orderBy("key").limit(max_rows)
    return docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).join(some, "id")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    label: str = "quality",
    settings: Settings = Settings(),
    max_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """Per row: the id, held_out, score and predicted.

    Null and empty texts get the score of the bias alone. Labels other than 0 and
    1 and labels of held-out ids are not read; without any label all scores are
    0.5. Repeated rows are scored each.
    """
    from rarebird.sources.staging import stage

    rows = stage(training_rows(docs, labels, text, id_column, label, max_rows), "quality-training")
    weights = train(rows, settings)
    score = scorer(docs, weights, settings)(F.col(text).cast("string"))
    return docs.select(F.col(id_column), held_out(id_column).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
