"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_operators import AWKWARD, SCHEMA

from rarebird.llm import spelling_variants as sv


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    best, out = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = others[0] if others and words[others[0]] >= 2 * n else None
        best[w] = form, len(others)
    for w, n in words.items():
        root = w
        while best[root][0]:
            root = best[root][0]
        form, k = best[w]
        out[w] = (form, root, n, k, words[form] if form else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("shared", [64, 2, 1])
def test_groups_against_all_pairs(spark, shared):
    r = random.Random(shared)
    words = {}
    for _ in range(60):
        base = "".join(r.choice("abéÿ") for _ in range(r.randint(5, 9)))
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 1)] = r.choice(["", "a", "é", "zz"])
            words["".join(w)] = r.choice([3, 3, 5, 6, 12, 30, 61])
    # A chain of forms, a long word, and many words that differ at one place.
    words |= {"kkkkk" + "k" * i: 3 * 2**i for i in range(12)}
    words |= {"q" * 3000: 3, "q" * 3001: 9, "q" * 1500 + "w" + "q" * 1499: 40}
    words |= {"ooo" + c + "ooo": 4 for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîï"}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert got(sv.variant_groups(table, shared=shared)) == plain_groups(words)


def test_near_words_share_a_signature():
    r = random.Random(9)
    for _ in range(2000):
        a = "".join(r.choice("abcé") for _ in range(r.randint(1, 12)))
        i = r.randrange(len(a) + 1)
        b = a[:i] + r.choice("abcéx") + a[i + r.randint(0, 1) :]
        if a == b:
            continue
        rows = [{(s, role) for s, _, role, *_ in sv.word_signatures(w)} for w in (a, b)]
        short, long = sorted((a, b), key=len)
        roles = (0, 0) if len(a) == len(b) else (1, 2)
        one, two = (rows[0], rows[1]) if short == a else (rows[1], rows[0])
        assert {s for s, role in one if role == roles[0]} & {s for s, role in two if role == roles[1]}, (a, b)


def test_words_of_texts(spark):
    r = random.Random(5)
    bits = ["Haus", "hause", "HAUSE", "Été", "ÉCOLE", "école", "x×y÷z", "naïve", "abcde1fghij", "ﬁnder", "ßtrasse", "漢字", "don't"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, "HAUSE naïve"), (None, "HAUSE naïve"), (5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = plain_words(rows)
    assert {w.word: w.n for w in sv.run_words(table).filter("n >= 3").collect()} == words and len(words) > 8
    assert got(sv.spelling_variants(table)) == plain_groups(words)


def test_awkward_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(sv, "HELD_WORDS", 2)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in AWKWARD], SCHEMA + ", word string, n int")
    assert got(sv.spelling_variants(docs)) == plain_groups(plain_words([r[:2] for r in AWKWARD]))
    assert sv.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
