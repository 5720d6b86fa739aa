"""Sharding against a plain sort, on hot sources, copies and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import AWKWARD, SCHEMA

from rarebird.llm import sharding


def plain(rows, shards, seed="shard-"):
    """(doc_id, source, text) to (doc_id, text) -> sorted (shard, slot), by sorting everything."""
    told = lambda *v: "".join("-" if x is None else f"{len(str(x))}:{x}" for x in v)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    by_source = defaultdict(list)
    for doc_id, source, text in rows:
        by_source[source].append((md5(seed + told(doc_id, source, text)), doc_id, text))
    order = []
    for source, held in by_source.items():
        offset = int(md5(seed + ("-" if source is None else "=" + source))[:8], 16) / 2**32
        for rank, (_, doc_id, text) in enumerate(sorted(held, key=lambda h: h[0])):
            order.append(((rank + offset) / len(held), source is None, source or "", rank, doc_id, text))
    places = defaultdict(list)
    for place, (*_, doc_id, text) in enumerate(sorted(order, key=lambda o: o[:4])):
        shard = place * shards // len(order)
        places[doc_id, text].append((shard, place - -(-shard * len(order) // shards)))
    return {k: sorted(v) for k, v in places.items()}


def got(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.doc_id, r.text_crc32].append((r.shard, r.slot))
    return {k: sorted(v) for k, v in found.items()}


def crc(text):
    return zlib.crc32((text or "").encode())


@pytest.mark.parametrize("bucket_rows,copies", [(1_000, 1_000), (3, 2)])
@pytest.mark.parametrize("shards", [1, 7, 24])
def test_same_as_a_plain_sort(spark, monkeypatch, bucket_rows, copies, shards):
    monkeypatch.setattr(sharding.copied, "__defaults__", (copies,))
    r = random.Random(shards)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), f"text {r.randint(0, 9)} é") for i in range(400)]
    rows += [(7, "a", "hot")] * 200 + [(None, "b", "no id")] * 50 + [(None, None, None)] * 3
    rows += [(1_000 + i, f"one-{i}", "x") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    found = sharding.shard_table(table, shards=shards, bucket_rows=bucket_rows)
    want = {(i, crc(t)): v for (i, t), v in plain(rows, shards).items()}
    assert got(found) == want
    again = sharding.shard_table(table.repartition(3), shards=shards, bucket_rows=2 * bucket_rows)
    assert got(again) == want
    counts = Counter(s for v in want.values() for s, _ in v)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards


def test_shards_have_the_mixture_of_the_whole(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "x" * (i % 50)) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = Counter(s for _, s, _ in rows)
    each = Counter((r.source, r.shard) for r in sharding.shard_table(table).select("source", "shard").collect())
    for source, n in total.items():
        assert all(abs(each[source, s] - n / 24) < 2 for s in range(24)), source


def test_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    rows = sharding.shard_table(docs).collect()
    texts = sorted(((str(r[0]), len((r[1] or "").encode()) + 8, crc(r[1])) for r in AWKWARD))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts
    assert len({(r.shard, r.slot) for r in rows}) == len(AWKWARD)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_table(empty).collect() == [] and sharding.sharded_documents(empty).collect() == []


def test_documents_keep_all_rows_and_columns(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "a") for r in AWKWARD], SCHEMA + ", shard int, row_key string")
    placed = sharding.sharded_documents(docs, shards=3)
    assert placed.columns == [*docs.columns, "shard_", "slot"]
    whole = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    assert whole(placed) == whole(docs)
    slots = defaultdict(list)
    for r in placed.collect():
        slots[r["shard_"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == [2, 3, 3]
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == len(AWKWARD) and {r["shard_"] for r in read.collect()} == {0, 1, 2}


def test_no_python(spark):
    table = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    plan = sharding.shard_table(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
