"""The quality classifier against plain loops over coordinates."""

import math
import random

import numpy as np

from rarebird.llm import quality_classifier as qc
from rarebird.llm.quality_classifier import Settings


def texts(n, seed):
    r = random.Random(seed)
    made = ["", " \n", "one", "A a A a", "x!! 12 x!!", "é" * 300]
    while len(made) < n:
        made.append(" ".join(r.choice(["good", "Text", "WOW", "12", "!!", "und", "x"]) for _ in range(r.randint(0, 40))))
    return made[:n]


def plain_features(text, scale):
    """id -> value, from the ids one by one."""
    ids = [int(i) for i in qc.feature_ids(text)]
    found = {}
    for i in ids:
        found[i] = found.get(i, 0.0) + scale / len(ids)
    return found | {qc._DIM: 1.0}


def plain_weight(z, n, s):
    if abs(z) <= s.l1:
        return 0.0
    return -(z - math.copysign(s.l1, z)) / ((s.beta + math.sqrt(n)) / s.alpha + s.l2)


def plain_pass(rows, z, n, s):
    """Follow the regularised leader, a coordinate at a time."""
    for text, y in rows:
        x = plain_features(text, s.scale)
        w = {i: plain_weight(z.get(i, 0.0), n.get(i, 0.0), s) for i in x}
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * x[i] for i in x)))))
        for i in x:
            g, before = (p - y) * x[i], n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * w[i]
            n[i] = before + g * g


def test_features_count_all_ngrams():
    for text in texts(40, 1):
        words = len(qc._TOKEN.findall(text))
        want = 2 * words + max(0, words - 1) + max(0, words - 2)
        assert len(qc.feature_ids(text)) == want
        ids, values = qc._values(text, 12.0)
        plain = plain_features(text, 12.0)
        assert set(ids.tolist()) == set(plain) and np.allclose(values, [plain[i] for i in ids.tolist()])
    assert len(qc.feature_ids(None)) == 0


def test_a_pass_against_plain_loops():
    s = Settings()
    rows = [(t, float(k % 3 == 0)) for k, t in enumerate(texts(80, 2))]
    z, n = np.zeros(qc._DIM + 1), np.zeros(qc._DIM + 1)
    zs, ns = {}, {}
    for _ in range(2):
        qc.ftrl_pass([t for t, _ in rows], [y for _, y in rows], z, n, s)
        plain_pass(rows, zs, ns, s)
    assert set(np.flatnonzero(n).tolist()) == {i for i in ns if ns[i]}
    assert all(math.isclose(z[i], zs[i], abs_tol=1e-9) and math.isclose(n[i], ns[i], abs_tol=1e-9) for i in ns)


def test_training_and_scores_against_plain_loops(spark):
    """Shards passed over one by one, states averaged where they were met, scores as sparse dot products."""
    s = Settings(shards=3, passes=2)
    some = [(k, t, float(k % 2), f"k{k:03d}") for k, t in enumerate(texts(60, 3))]
    table = spark.createDataFrame(some, "id long, text string, label double, key string")
    shard_of = {r.key: r.shard for r in table.selectExpr("key", f"pmod(xxhash64(key), {s.shards}) AS shard").collect()}
    z, n = {}, {}
    for _ in range(s.passes):
        states = []
        for shard in range(s.shards):
            zs, ns = dict(z), dict(n)
            plain_pass([(t, y) for _, t, y, key in sorted(some, key=lambda r: r[3]) if shard_of[key] == shard], zs, ns, s)
            states.append((zs, ns))
        every = {i for _, ns in states for i in ns}
        met = {i: max(1, sum(ns.get(i, 0) > 0 for _, ns in states)) for i in every}
        z = {i: sum(zs.get(i, 0.0) for zs, _ in states) / met[i] for i in every}
        n = {i: sum(ns.get(i, 0.0) for _, ns in states) / met[i] for i in every}
    want = {i: plain_weight(z[i], n[i], s) for i in z}
    got = qc.train(table, s)
    assert np.array_equal(got, qc.train(table.repartition(7), s)) and np.count_nonzero(got) > 20
    assert all(math.isclose(got[i], want.get(i, 0.0), abs_tol=1e-9) for i in {*want, *np.flatnonzero(got).tolist()})
    scored = table.select("id", "text", qc.scorer(table, got, s)("text").alias("score")).collect()
    for row in scored:
        dot = sum(want.get(i, 0.0) * x for i, x in plain_features(row.text, s.scale).items())
        assert math.isclose(row.score, 1 / (1 + math.exp(-dot)), abs_tol=1e-9), row.id


def test_no_labels_give_even_scores(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 7), (2, None), (None, 1)], "doc_id long, quality int")
    got = qc.quality_scores(docs, labels).collect()
    assert [r.score for r in got] == [0.5] * 4 and [r.predicted for r in got] == [1] * 4
    assert next(r for r in got if r.doc_id is None).held_out
