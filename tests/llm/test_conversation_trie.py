"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rarebird.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, Turns string, KEY int"


def plain(rows, splice):
    """The nodes as sorted tuples, from every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        stack, found = [p], []
        while stack:
            found.append(stack.pop())
            stack.extend(children[found[-1]])
        return found

    out = []
    for p, ids in members.items():
        under = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        leaves = sum(not children[q] for q in under)
        out.append((len(p), min(ids), parent, len(ids), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def chats(seed, n):
    """Few different turns, so that prefixes and whole conversations repeat."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), n):
        turns = [(r.choice("ab"), r.choice(["x", "yy", "é😀"])) for _ in range(r.randint(1, 7))]
        if r.random() < 0.4:
            turns = [("a", "x")] * r.randint(1, 9)
        rows += [(c, i, *t, "p", 1) for i, t in enumerate(turns)]
    return rows


AWKWARD = [
    (1, None, "a", "late?", None, None),
    (1, 0, "a", "x", None, None),
    (1, 0, "b", "x", None, None),
    (2, 0, None, None, None, None),
    (3, 0, "", "", None, None),
    (3, 0, "", "", None, None),
    (None, 0, "a", "nobody", None, None),
    (None, 1, "a", "nobody", None, None),
    (4, 5, "a", "y" * 100_000, None, None),
    (500, 1, "1", ":x", None, None),
    (501, 1, "", "1:x", None, None),
]


@pytest.mark.parametrize("splice", [True, False])
@pytest.mark.parametrize("block_turns", [200_000, 40, 3])
def test_nodes_against_all_prefixes(spark, splice, block_turns):
    for seed, n in [(1, 120), (2, 30)]:
        rows = chats(seed, n) + (AWKWARD if seed == 2 else [])
        rows = [r for r in rows if seed == 1 or r[0] is None or not 0 <= r[0] <= 4 or r in AWKWARD]
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert got(ct.conversation_trie(table, splice=splice, block_turns=block_turns)) == plain(rows, splice)


def test_copies_long_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE_IDS", 7)
    rows = [(c, t, "a", f"t{t}", "", 1) for c in range(1000, 1100) for t in range(3)]
    rows += [(7, t, "a", f"t{t % 5}", "", 1) for t in range(900)] + [(8, t, "a", f"t{t % 5}", "", 1) for t in range(899)]
    # Without the first of its family a short conversation can lose all its turns.
    rows += [(c, 0, "b", "alone", "", 1) for c in range(2001, 2020)]
    table = spark.createDataFrame(rows, SCHEMA)
    for splice in (True, False):
        want = plain(rows, splice)
        assert got(ct.conversation_trie(table, splice=splice, block_turns=50)) == want
        assert (min(want)[-1] != ct._EMPTY) == splice and max(r[0] for r in want) > 890


def test_empty_table_has_no_nodes(spark):
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA), splice=True).collect() == []


def test_range_minima_against_plain_search():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        values = r.integers(-1, 4, n)
        table = ct.RangeMinima(values)
        at, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(-1, 5)))
        for i, d, a, b in zip(at, depth, table.left(at, depth), table.right(at, depth)):
            left = i
            while left > 0 and values[left] >= d:
                left -= 1
            right = i
            while right + 1 < n and values[right + 1] >= d:
                right += 1
            assert (a, b) == (left, right)
        first = np.minimum(at, n - 1)
        assert table.least(first, np.full_like(first, n - 1)).tolist() == [int(values[f:].min()) for f in first]
