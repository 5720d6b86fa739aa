"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and stored in blocks of rows. In a block each
attribute is kept as bitmaps, one a binary digit of its distance from the block's
least value, with a bit for each row. A query's scores are summed for all rows of
a block at once: multiplying by a query component shifts bitmaps, a negative one
takes their complements, and carry-save adders turn the bitmaps into the binary
digits of the scores. From the most significant digit downwards the rows that
belong to the top k are told apart; rows that share the boundary score are taken
by ascending id. The few rows left of each block are ranked together.

The index is built where the rows are and written once. Queries are joined to it
in blocks: the query set against all rows, which is the work asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.sources.staging import stage

SCALE = 1024
#: Rows of an index block, and queries of a query block, at most.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 64
#: Quantised components below this in size are handled as 64-bit integers, others as integers of any size.
_LARGEST = 2**61
_SCHEMA = "width int, n int, ids binary, low binary, bits binary, slices binary"


def quantise(vectors: list, scale: int = SCALE) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for those that take no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype=np.float64)
        if x is None or not np.all(np.isfinite(x)):
            out.append(None)
        elif np.all(np.abs(x) < _LARGEST / scale):
            out.append(np.floor(x * scale).astype(np.int64))
        else:
            out.append(np.array([floor(Fraction(c) * scale) for c in x.tolist()], dtype=object))
    return out


def packed_integers(rows: np.ndarray) -> bytes:
    """Integers of any size, in order."""
    return json.dumps(rows.tolist()).encode()


def unpacked_integers(packed: bytes) -> np.ndarray:
    rows = np.array(json.loads(packed), dtype=object)
    small = all(abs(c) < _LARGEST for c in rows.ravel().tolist())
    return rows.astype(np.int64) if small else rows


def slice_block(ids: np.ndarray, rows: np.ndarray) -> dict:
    """The index block of some rows: bitmaps per attribute, rows by ascending id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low = rows.min(axis=0) if rows.shape[1] else np.empty(0, np.int64)
    above = rows - low
    bits = np.array([int(m).bit_length() for m in above.max(axis=0)], dtype=np.int64)
    padded = np.zeros((-(-len(ids) // 64) * 64, rows.shape[1]), dtype=rows.dtype)
    padded[: len(ids)] = above
    maps = [
        np.packbits((padded[:, d] >> i & 1).astype(np.uint8), bitorder="little").view(np.uint64)
        for d, b in enumerate(bits)
        for i in range(b)
    ]
    slices = np.stack(maps) if maps else np.empty((0, len(padded) // 64), np.uint64)
    return {
        "width": rows.shape[1],
        "n": len(ids),
        "ids": ids.tobytes(),
        "low": packed_integers(low),
        "bits": bits.tobytes(),
        "slices": slices.tobytes(),
    }


def _total(by_weight: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Binary digits, least first, of the weighted sum of bitmaps, by carry-save adders."""
    digits: list[np.ndarray] = []
    weight = 0
    while by_weight:
        stack = by_weight.pop(weight, [])
        maps = np.concatenate(stack) if stack else np.empty((0, words), np.uint64)
        while len(maps) > 1:
            k = len(maps) // 3
            if k:
                a, b, c = maps[:k], maps[k : 2 * k], maps[2 * k : 3 * k]
                half = a ^ b
                carry = (a & b) | (half & c)
                maps = np.concatenate([half ^ c, maps[3 * k :]])
            else:
                carry = (maps[0] & maps[1])[None]
                maps = (maps[0] ^ maps[1])[None]
            by_weight.setdefault(weight + 1, []).append(carry)
        digits.append(maps[0] if len(maps) else np.zeros(words, np.uint64))
        weight += 1
    return digits


def scores(block: dict, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The binary digits, least first, of all rows' scores above a constant, and the constant."""
    words = -(-block["n"] // 64)
    bits = np.frombuffer(block["bits"], np.int64)
    low = json.loads(block["low"])
    slices = np.frombuffer(block["slices"], np.uint64).reshape(-1, words)
    first = np.concatenate([[0], np.cumsum(bits)])
    constant = 0
    by_weight: dict[int, list[np.ndarray]] = {}
    for d, q in enumerate(query.tolist()):
        constant += q * int(low[d])
        maps = slices[first[d] : first[d + 1]]
        if q < 0:  # -|q| * u is |q| * (m - u) - |q| * m, and m - u has the complements as digits
            constant += q * ((1 << int(bits[d])) - 1)
            q, maps = -q, ~maps
        for j in range(q.bit_length()):
            if q >> j & 1:
                for i in range(len(maps)):
                    by_weight.setdefault(i + j, []).append(maps[i : i + 1])
    return _total(by_weight, words), constant


def top_rows(digits: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k allowed rows with the largest scores; of those at the boundary the first."""
    sure, open_ = np.zeros_like(allowed), allowed
    for digit in reversed(digits):
        ones = open_ & digit
        n = int(np.bitwise_count(sure | ones).sum())
        if n <= k:
            sure, open_ = sure | ones, open_ & ~digit
            if n == k:
                break
        else:
            open_ = ones
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    chosen = places(sure)
    return np.concatenate([chosen, places(open_)[: k - len(chosen)]])


def search_block(block: dict, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """Ids and scores of the block's top k rows other than the query's own."""
    n, ids = block["n"], np.frombuffer(block["ids"], np.int64)
    allowed = np.zeros(-(-n // 64) * 64, dtype=np.uint8)
    allowed[:n] = ids != query_id
    allowed = np.packbits(allowed, bitorder="little").view(np.uint64)
    digits, constant = scores(block, query)
    places = top_rows(digits, allowed, k)
    found = np.zeros(len(places), dtype=object)
    for i, digit in enumerate(digits):
        found += (digit[places // 64] >> (places % 64).astype(np.uint64) & np.uint64(1)).astype(object) << i
    return ids[places], [int(f) + constant for f in found]


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Index blocks of rows of id and vector, written to the shared folder."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        for frame in frames:
            for i, x in zip(frame["id"].tolist(), quantise(frame["vector"].tolist())):
                if x is not None:
                    rows = waiting.setdefault(len(x), [])
                    rows.append((i, x))
                    if len(rows) >= block_rows:
                        yield made(waiting.pop(len(x)))
        for rows in waiting.values():
            yield made(rows)

    def made(rows: list) -> pd.DataFrame:
        return pd.DataFrame([slice_block(np.array([i for i, _ in rows], np.int64), np.stack([x for _, x in rows]))])

    # Full blocks make the bitmaps long; rows go around the partitions evenly.
    rows = vectors.filter("id is not null and vector is not null")
    return stage(rows.repartition(max(1, ceil(rows.count() / block_rows))).mapInPandas(build, _SCHEMA), "bit-slices")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query, ties to the smaller id.

    Both tables have an id and a vector. Rows without id, null vectors and those
    with null or non-finite components take no part. A score among a query's best
    that does not fit a long is an error. Vectors meet vectors of their length only. A row
    with the query's id is the query's own. Rows repeated in ``vectors`` are
    ranked each; a query repeated as a whole counts once.
    """
    chosen = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    index = build_index(chosen(vectors), block_rows)
    asked = chosen(queries).filter("id is not null and vector is not null").dropDuplicates(["id", "vector"])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        for frame in frames:
            for i, x in zip(frame["id"].tolist(), quantise(frame["vector"].tolist())):
                if x is not None:
                    rows = waiting.setdefault(len(x), [])
                    rows.append((i, x))
                    if len(rows) >= BLOCK_QUERIES:
                        yield packed(waiting.pop(len(x)))
        for rows in waiting.values():
            yield packed(rows)

    def packed(rows: list) -> pd.DataFrame:
        ids = np.array([i for i, _ in rows], np.int64)
        return pd.DataFrame(
            {"of": [len(rows[0][1])], "asked": [ids.tobytes()], "wanted": [packed_integers(np.stack([x for _, x in rows]))]}
        )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame.to_dict("records"):
                ids = np.frombuffer(block["asked"], np.int64)
                wanted = unpacked_integers(block["wanted"]).reshape(len(ids), -1)
                for i, q in zip(ids.tolist(), wanted):
                    near, points = search_block(block, i, q, k)
                    yield pd.DataFrame({"query_id": i, "query": packed_integers(q), "vec_id": near, "score": points})

    query_blocks = stage(
        asked.repartition(max(1, ceil(asked.count() / BLOCK_QUERIES))).mapInPandas(
            pack, "of int, asked binary, wanted binary"
        ),
        "bit-queries",
    )
    # Each index block gets a slot, each query block goes to all slots: blocks of
    # queries against blocks of rows, dealt evenly.
    slots = max(1, index.count())
    slot = F.pmod(F.xxhash64("ids"), F.lit(slots)).alias("slot")
    pairs = index.select("*", slot).join(
        query_blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))),
        (F.col("slot") == F.col("at")) & (F.col("width") == F.col("of")),
    )
    found = pairs.repartition("slot", F.xxhash64("asked")).mapInPandas(
        search, "query_id long, query binary, vec_id long, score long"
    )
    best = W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: What ``top_k`` gives for the table embeddings, for DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
