"""The prefix trie of conversations, from sorted sequences and range minima.

A turn is a fixed number of bytes: a fingerprint of role and text, and the text's
length. A conversation is the bytes of its turns, so sorting bytes sorts sequences of
turns, and conversations that share a prefix lie side by side. Conversations alike in
all turns are one class; classes are sorted once over the cluster, in blocks.

Within a block the lengths of common prefixes of neighbours (LCPs) are put into a
sparse table of range minima. Each candidate prefix, the LCP at a place or the whole
of a class, searches its left and its right extent by itself: the farthest places up
to which no LCP is less than its depth. The extents are its members, and what is
asked of a node follows from running sums over them. Depths between an extent's
bordering LCPs and the candidate's own are nodes with the same members.

A prefix whose members run over a border of blocks is found in each of them with its
part of the members. All its figures are sums or minima, so its parts, and no other
rows, meet in one more aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.llm.running import same
from rarebird.sources.staging import stage

#: Turns of a conversation group, of whose first one each takes its beginning, and the most it takes.
FAMILY = 100
SHARED = 5
#: Turns of a block, about.
BLOCK_TURNS = 200_000
#: Ids joined in one text.
PIECE_IDS = 4_096
#: Bytes of a turn: a fingerprint and, most significant first, the text's length.
_PRINT, _UNIT = 16, 24
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = (
    "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends string"
)
_FIGURES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def sequences(
    turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id and turns, an array of hexadecimal units in turn order, of every conversation.

    A null turn number comes first; turns of one number follow their fingerprints. A
    null role or text is an empty one. Rows without an id belong to no conversation.
    """
    who, said = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (role, text))
    unit = F.concat(
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)), F.lpad(F.hex(F.length(said)), 16, "0")
    )
    rows = turns.filter(named(id_column).isNotNull()).select(
        named(id_column).cast("long").alias("conv_id"), named(turn).alias("turn"), unit.alias("unit")
    )
    listed = F.sort_array(F.collect_list(F.struct("turn", "unit")))
    return rows.groupBy("conv_id").agg(F.transform(listed, lambda t: t["unit"]).alias("turns"))


def rebuilt(own: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """The conversations, each with its first turns taken from the first of its family.

    Conversation c takes the first h turns of conversation c - c % family (all if it has
    fewer, none if there is none), then its own from the turn after its first h on, with
    h the CRC-32 of c in decimal, modulo ``shared`` + 1.
    """
    head = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, shared).alias("first")
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % (shared + 1)).cast("int")
    first = F.coalesce("first", F.array().cast("array<string>"))
    spliced = F.concat(F.slice(first, F.lit(1), taken), F.slice("turns", taken + 1, F.size("turns")))
    joined = own.join(head, F.col("conv_id") - F.col("conv_id") % family == F.col("head"), "left")
    return joined.select("conv_id", spliced.alias("turns"))


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ascending ids of one class, joined to texts of a bounded number of ids."""
    for frame in frames:
        digests, ids = frame["digest"].to_numpy(), frame["conv_id"].to_numpy()
        starts = np.flatnonzero(np.append(True, digests[1:] != digests[:-1])) if len(ids) else []
        rows = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            for i in range(a, b, PIECE_IDS):
                some = ids[i : min(b, i + PIECE_IDS)].tolist()
                rows.append((digests[i], some[0], len(some), ",".join(map(str, some))))
        yield pd.DataFrame(rows, columns=["digest", "first", "n", "ids"])


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class, from its pieces in order: the least id, the number of ids, the hash of all, one piece held at a time."""
    digest, first, n, state = None, 0, 0, None
    for frame in frames:
        rows = []
        for this, least, held, ids in frame.itertuples(index=False):
            if this != digest:
                if state:
                    rows.append((digest, first, n, state.hexdigest()))
                digest, first, n, state = this, least, 0, hashlib.sha256()
            elif n:
                state.update(b",")
            n += held
            state.update(ids.encode())
        yield pd.DataFrame(rows, columns=["digest", "first", "n", "ends"])
    if state:
        yield pd.DataFrame([(digest, first, n, state.hexdigest())], columns=["digest", "first", "n", "ends"])


def classes(keyed: DataFrame) -> DataFrame:
    """first, n, ends: the least id, the number and the hash of ids of each class, from rows of conv_id and key.

    A class of any size is spread by id while its ids are joined to texts; only
    these texts meet in one task, one after another.
    """
    rows = keyed.select(F.md5("key").alias("digest"), "conv_id")
    pieces = (
        rows.repartitionByRange("digest", "conv_id")
        .sortWithinPartitions("digest", "conv_id")
        .mapInPandas(_pieces, "digest string, first long, n long, ids string")
    )
    return (
        pieces.repartition("digest")
        .sortWithinPartitions("digest", "first")
        .mapInPandas(_joined, "digest string, first long, n long, ends string")
        .select("first", "n", "ends")
    )


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s[:n], np.uint64).reshape(-1, _UNIT // 8) for s in (a, b))
    other = (x != y).any(axis=1)
    return int(other.argmax()) if other.any() else len(other)


class RangeMinima:
    """A sparse table: the least of any 2**k neighbours, for all k."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum over first to last, both included."""
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), np.int64)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[first[at]], table[last[at] + 1 - 2**level])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The farthest place up to which no value after ``at`` is less than ``depth``, by halving steps."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            table = self.levels[k]
            start = np.minimum(at + 1, len(table) - 1)
            at += np.where((at + 1 < len(table)) & (table[start] >= depth), 2**k, 0)
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The farthest place back to which no value after it, up to ``at``, is less than ``depth``."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            start = at - 2**k + 1
            at -= np.where((start >= 1) & (self.levels[k][np.maximum(start, 0)] >= depth), 2**k, 0)
        return at


def block_nodes(keys: list[bytes], firsts: np.ndarray, n: np.ndarray, ends: list[str], left: int, right: int) -> pd.DataFrame:
    """The nodes of one block of sorted classes; those that cross its borders as parts.

    ``left`` and ``right`` are the turns its first and last class share with the
    neighbouring blocks' classes, -1 where there is none. Nodes that cross a border,
    and the root, have their prefix's digest as ``node``; children of such have it
    as ``parent``, others the parent's id.
    """
    m = len(keys)
    depths = np.array([len(k) // _UNIT for k in keys], np.int64)
    lcp = np.array([left, *map(common_turns, keys, keys[1:]), right], np.int64)
    minima = RangeMinima(lcp[:m])
    least_id = RangeMinima(firsts)
    # Characters up to each depth of each class, one after another.
    offsets = np.concatenate([[0], np.cumsum(depths + 1)])
    upto = np.zeros(offsets[-1], np.int64)
    for at, key in zip(offsets, keys):
        lengths = np.frombuffer(key, ">u8").reshape(-1, _UNIT // 8)[:, _PRINT // 8]
        upto[at + 1 : at + 1 + len(lengths)] = np.cumsum(lengths.astype(np.int64))
    whole = upto[offsets[1:] - 1]
    fresh = whole - upto[offsets[:-1] + np.clip(lcp[:m], 0, None)]
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    members, weighted, fresh_run, leaves = run(n), run(n * whole), run(fresh), run(lcp[1:] < depths)
    by_depth = np.sort(lcp[:m] * (m + 1) + np.arange(m))

    def crosses(l, r, d):  # noqa: E741
        return (d == 0) | ((l == 0) & (d <= left)) | ((r == m - 1) & (d <= right))

    def digest(l, d):  # noqa: E741
        # A crossing prefix is one of the first class if it begins there, or else of the last.
        return hashlib.md5(keys[0 if l == 0 else m - 1][: d * _UNIT]).digest()

    # Candidates: each place's LCP, each class as a whole.
    rows = np.arange(m)
    at = np.concatenate([rows[1:], rows])
    depth = np.concatenate([lcp[1:m], depths])
    l, r = minima.left(at, depth), minima.right(at, depth)  # noqa: E741
    found = np.unique(np.stack([l, r, depth], axis=1), axis=0)
    l, r, depth = found.T  # noqa: E741
    above = np.maximum(lcp[l], lcp[r + 1])
    closed = (depth > above) & (depth > 0)
    l, r, depth, above = l[closed], r[closed], depth[closed], above[closed]  # noqa: E741
    # Where its members' next other prefix ends, one turn up, a node's parent has other members.
    parent_depth = np.maximum(above, 0)
    parent_l, parent_r = minima.left(l, parent_depth), minima.right(l, parent_depth)
    open_parent = crosses(parent_l, parent_r, parent_depth)
    parent_id = least_id.least(parent_l, parent_r)
    chain = depth - parent_depth
    pick = np.repeat(np.arange(len(l)), chain)
    step = np.arange(len(pick)) - np.repeat(np.cumsum(chain) - chain, chain)
    top = step == 0
    node_l, node_r, node_depth = l[pick], r[pick], parent_depth[pick] + 1 + step
    own_id = least_id.least(node_l, node_r)
    out = {
        "node": np.full(len(pick), None, object),
        "parent": np.array([digest(a, d) if t and o else None for a, d, t, o in zip(parent_l[pick], parent_depth[pick], top, open_parent[pick])], object),
        "parent_conv_id": np.where(top, parent_id[pick], own_id),
    }
    # Parts of nodes that cross a border: prefixes of the first and of the last class.
    ends_at = [(0, d) for d in range(max(left, 0) + 1)] + [(m - 1, d) for d in range(1, right + 1)]
    place, part_depth = np.array(ends_at, np.int64).T
    part_l, part_r = minima.left(place, part_depth), minima.right(place, part_depth)
    part = np.unique(np.stack([part_l, part_r, part_depth], axis=1), axis=0)
    part_l, part_r, part_depth = part.T
    part_nodes = [digest(a, d) for a, d in zip(part_l, part_depth)]
    part_parents = [digest(a, d - 1) if d else None for a, d in zip(minima.left(part_l, part_depth - 1), part_depth)]
    out = {
        "node": [*out["node"], *part_nodes],
        "parent": [*out["parent"], *part_parents],
        "parent_conv_id": np.concatenate([out["parent_conv_id"], np.zeros(len(part_l), np.int64)]),
    }
    l, r, d = (np.concatenate(x) for x in ((node_l, part_l), (node_r, part_r), (node_depth, part_depth)))  # noqa: E741

    owner = lcp[l] < d
    before = upto[offsets[l] + np.maximum(d - 1, 0)]
    held = members[r + 1] - members[l]
    distinct = fresh_run[r + 1] - fresh_run[l] + np.where(owner, whole[l] - before - fresh[l], 0)
    first_child = np.where(owner, depths[l] > d, lcp[l] == d)
    later = np.searchsorted(by_depth, d * (m + 1) + r, "right") - np.searchsorted(by_depth, d * (m + 1) + l, "right")
    out |= {
        "conv_id": least_id.least(l, r),
        "depth": d,
        "n_convs": held,
        "n_children": first_child + later,
        "n_leaves": leaves[r + 1] - leaves[l],
        "saved_tokens": weighted[r + 1] - weighted[l] - held * before - distinct,
        "ends": [ends[i] if o and depths[i] == e else None for i, o, e in zip(l, owner, d)],
    }
    return pd.DataFrame(out)


def prefix_nodes(sequences_: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, turns), the root included.

    conv_id is the least member, parent_conv_id that of the prefix one turn shorter,
    null for the root. n_convs counts members, n_children prefixes one turn longer,
    n_leaves childless nodes below or at the node, saved_tokens sums (n_convs - 1)
    times the characters of the last turn's text over the node and all below.
    ends_sha256 is the SHA-256 of the ids, ascending and joined by commas, of the
    sequences that end at the node. Without any sequence there is no node.
    """
    keyed = stage(sequences_.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key")), "trie-sequences")
    found = classes(keyed).join(keyed, F.col("first") == F.col("conv_id")).select("first", "n", "ends", "key")
    units = keyed.agg(F.sum(F.length("key"))).first()[0] or 0
    blocks = max(1, ceil(units / _UNIT / block_turns))
    # Staged, so that every reader sees the same blocks.
    ordered = stage(found.repartitionByRange(blocks, "key").select("*", F.spark_partition_id().alias("block")), "trie-blocks")
    edges = ordered.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # A row for each block.
    following = edges.select("block", "high", F.lead("low").over(W.orderBy("block")).alias("low"))
    following = following.withColumn("next", F.lead("block").over(W.orderBy("block")))

    def borders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = [-1 if b is None else common_turns(bytes(a), bytes(b)) for a, b in zip(frame["high"], frame["low"])]
            yield pd.DataFrame({"block": frame["block"], "next": frame["next"], "shared": n}).astype({"next": "Int64"})

    border = stage(following.mapInPandas(borders, "block int, next int, shared int"), "trie-borders")
    sides = border.select(F.col("block").alias("of"), F.col("shared").alias("right")).join(
        border.select(F.col("next").alias("to"), F.col("shared").alias("left")), F.col("of") == F.col("to"), "left"
    )
    sides = sides.select("of", F.coalesce("left", F.lit(-1)).alias("left"), "right")

    def nodes(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(key=frame["key"].map(bytes)).sort_values("key")
        made = block_nodes(
            frame["key"].tolist(),
            frame["first"].to_numpy(np.int64),
            frame["n"].to_numpy(np.int64),
            frame["ends"].tolist(),
            int(frame["left"].iloc[0]),
            int(frame["right"].iloc[0]),
        )
        return made.assign(block=frame["block"].iloc[0])

    parts = stage(
        ordered.join(sides, F.col("block") == F.col("of")).groupBy("block").applyInPandas(nodes, _NODE + ", block int"),
        "trie-nodes",
    )
    # At most the turns that neighbouring blocks share, for each border, and the root.
    crossing = parts.filter("node is not null")
    merged = crossing.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("ends").alias("ends"),
    )
    merged = stage(merged, "trie-crossing")
    ids = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("up_id"))
    open_nodes = merged.join(ids, F.col("parent") == F.col("up"), "left").withColumn("parent_conv_id", F.col("up_id"))
    # A block's nodes look their parents up among the block's own parts: a parent has children in many blocks.
    local = crossing.select(F.col("node").alias("part"), F.col("block").alias("in")).join(ids, F.col("part") == F.col("up"))
    under = parts.filter("node is null and parent is not null").join(local, same(["parent", "block"], ["part", "in"]))
    closed = parts.filter("node is null and parent is null")
    every = [
        df.select(*_FIGURES, F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
        for df in (open_nodes, under.withColumn("parent_conv_id", F.col("up_id")), closed)
    ]
    return every[0].unionByName(every[1]).unionByName(every[2])


def conversation_trie(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    splice: bool = False,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """The nodes of the trie of all conversations of a table with a row for each turn; see ``prefix_nodes``.

    With ``splice`` each conversation is first ``rebuilt`` with its family's beginning.
    Nulls and ties are as in ``sequences``; a repeated row is a turn said twice; other
    columns, whatever their names, play no part. An empty table has no nodes. The
    fingerprints of one conversation, 48 bytes a turn, are held in one task; texts are not.
    """
    own = sequences(turns, id_column, turn, role, text)
    if splice:
        own = rebuilt(stage(own, "trie-own"))
    return prefix_nodes(own, block_turns)


#: What ``conversation_trie`` gives with ``splice`` for the table conversations, for DuckDB.
ORACLE = r"""
WITH polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), own AS (
  SELECT conv_id, list({'print': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
      'n': length(coalesce(text, ''))}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN regexp_extract_all(CAST(conv_id AS VARCHAR), '.')]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
  FROM own, polynomial
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM taken c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 100
), member AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), node AS (
  SELECT [t.print FOR t IN turns[1:depth]] AS prefix, any_value(depth) AS depth, min(conv_id) AS conv_id,
    count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END) AS chars
  FROM member GROUP BY prefix
), ends AS (
  SELECT [t.print FOR t IN turns] AS prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM rebuilt GROUP BY prefix
), up AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM node n LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
)
SELECT u.conv_id, u.depth, u.parent_conv_id, CAST(u.n_convs AS BIGINT) AS n_convs, u.n_children,
  CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
  CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens,
  coalesce(any_value(e.ends_sha256), sha256('')) AS ends_sha256
FROM up u JOIN up b ON b.depth >= u.depth AND b.prefix[1:u.depth] = u.prefix
LEFT JOIN ends e ON e.prefix = u.prefix
GROUP BY u.prefix, u.conv_id, u.depth, u.parent_conv_id, u.n_convs, u.n_children
"""
