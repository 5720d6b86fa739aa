"""The operators against brute force, on rows that are awkward."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarebird.llm import (
    backoff_scores,
    bit_sliced,
    curriculum,
    dart_minhash,
    html_wrappers,
    quality_classifier,
    quality_rules,
    secret_scan,
    shared_prefix,
    token_counts,
)
from rarebird.sources import staging

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Spans string, SIZE int, position string"
LONG = "un mot très long de plus. " * 20_000
AWKWARD = [
    (1, "a b c d e f g h", "en", "s", 15, "x", 1, "p"),
    (1, "a b c d e f g h", "en", "s", 15, "x", 1, "p"),
    (2, None, None, None, None, None, None, None),
    (None, "a b c d e f g h", None, "t", 1, None, None, None),
    (3, "", "en", "", 0, "", 0, ""),
    (4, " \n\t ", "en", "s", 4, "", 0, ""),
    (5, LONG, "fr", "t", len(LONG), "", 0, ""),
    (6, "mot\n\nmot\nmot", "fr", "t", 12, "", 0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def random_texts(n, seed, words="la le un de mot été Haus ### !! x1 y2".split()):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]


def outputs(docs, labels):
    """Results by name, collected: a mere count would leave most columns uncomputed."""
    found = {
        "verdicts": quality_rules.quality_verdicts(docs, labels),
        "good": quality_rules.keep_good(docs, labels),
        "scores": backoff_scores.backoff_scores(docs),
        "scores3": backoff_scores.ngram_scores(docs, order=3),
        "quality": quality_classifier.quality_scores(docs, labels),
        "mix": curriculum.mix(docs),
        "mixed": curriculum.mixed_documents(docs),
        "tokens": token_counts.token_counts(docs),
        "secrets": secret_scan.secret_report(docs),
        "masked": secret_scan.masked_documents(docs),
        "report": shared_prefix.encoded_report(docs),
        "encoded": shared_prefix.encoded_documents(docs),
        "classes": dart_minhash.near_duplicates(docs),
        "single": dart_minhash.one_of_each(docs),
    }
    return {name: df.collect() for name, df in found.items()}


def test_awkward_rows_have_results(docs, no_labels):
    got = outputs(docs, no_labels)
    ids = sorted(str(r[0]) for r in AWKWARD)
    every = ("verdicts", "scores", "scores3", "quality", "mix", "tokens", "secrets", "masked", "report", "encoded", "classes")
    for name in every:
        assert sorted(str(r.doc_id) for r in got[name]) == ids, name
        one, again = (r for r in got[name] if r.doc_id == 1)
        if name != "mix":  # the second row lies behind the first
            assert one == again, name
    words = {1: 8, 2: 0, None: 8, 3: 0, 4: 0, 5: 120_000, 6: 3}
    texts = {r[0]: r[1] for r in AWKWARD}
    for name, column in [("verdicts", "n_words"), ("scores", "n_words"), ("scores3", "n_words"), ("mix", "size")]:
        assert {r.doc_id: r[column] for r in got[name]} == words, name
    for order, name in [(2, "scores"), (3, "scores3")]:
        want = brute_scores([r[1] for r in AWKWARD], order)
        for (doc_id, *_), (micro, back) in zip(AWKWARD, want):
            row = next(r for r in got[name] if r.doc_id == doc_id)
            assert (row.n_backed_off, row.log_score_micro) == (back, micro), (name, doc_id)
            assert (row.mean_log_score is None) == (words[doc_id] == 0)
    # Without labels nothing is learned: the base rules alone decide, and every score is the same.
    assert {r.doc_id for r in got["verdicts"] if not r.base_failed} == {r.doc_id for r in got["verdicts"] if r.kept} == {r.doc_id for r in got["good"]}
    assert len({r.score for r in got["quality"]}) == 1
    assert {r.doc_id: r.taken for r in got["mix"] if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    taken = sum(r.copies for r in got["mix"])
    # Rows alike in all columns are one row of the mixed table for each place.
    assert len(got["mixed"]) == taken and all(r.text == texts[r.doc_id] for r in got["mixed"])
    assert {r.doc_id: r.n_bytes for r in got["tokens"]} == {k: len((t or "").encode()) for k, t in texts.items()}
    assert all((r.n_tokens == 0) == (not texts[r.doc_id]) for r in got["tokens"])
    assert all(r.spans == "" and r.n_assign == r.n_access == r.n_hex == 0 for r in got["secrets"])
    assert {r.doc_id: r.text for r in got["masked"]} == texts
    assert all(len(r.token_ids) == r.n_tokens for r in got["encoded"])
    kinds = {r.doc_id: r.class_id for r in got["classes"]}
    assert kinds[1] == 1 and len({kinds[k] for k in (1, 5, 6)}) == 3
    assert {r.doc_id for r in got["single"]} >= {1, 5, 6}


def brute_scores(texts, order):
    """(log_score_micro, n_backed_off) of each text by counting all n-grams."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(ws[i : i + k]) for ws in words for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    begun = Counter()
    for g, n in counts.items():
        begun[g[:-1]] += n

    def share(g):
        if len(g) == 1:
            return counts[g] / begun[()], 0
        return (counts[g] / begun[g[:-1]], 0) if counts[g] >= 2 else (0.4 * share(g[1:])[0], 1)

    found = [[share(tuple(ws[max(0, k - order + 1) : k + 1])) for k in range(len(ws))] for ws in words]
    return [(sum(round(np.log(s) * 1e6) for s, _ in f), sum(b for _, b in f)) for f in found]


def test_empty_tables_have_empty_results(empty, no_labels):
    assert not any(outputs(empty, no_labels).values())


def test_other_tables_may_be_empty_or_awkward(spark):
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [0.5, -0.5]),
         (4, [0.5, -0.5]), (5, [1.0]), (6, []), (7, [float("inf"), 0.0])],
        schema,
    )
    got = bit_sliced.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 4, -524288), (0, 2, 4, -524288)]
    none = spark.createDataFrame([], schema)
    assert bit_sliced.top_k(none, none).count() == 0
    pages = spark.createDataFrame(
        [(1, "http://a.org/x", None), (2, None, "<p>x<p>y"), (3, "http://a.org", ""), (None, "bad", "plain &amp; text")],
        "page_id long, url string, html string",
    )
    texts = {r.page_id: r.text for r in html_wrappers.main_texts(pages).collect()}
    assert texts == {1: "", 2: "x y", 3: "", None: "plain & text"}
    assert html_wrappers.main_texts(pages.limit(0)).count() == 0


# Quality rules.


def test_statistics_against_plain_counting():
    for text in [*random_texts(200, 1), "a\na\n \na b", "x\ry", "é##\n\n", "a a a a a"]:
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        got = quality_rules.statistics(text)[:5]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        assert got == (len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)), text


def test_a_list_is_learned_in_order_and_spares_good_rows():
    rng = np.random.default_rng(0)
    x, y = rng.random(3000), rng.random(3000)
    bad = (x > 0.8) | ((y < 0.1) & (x > 0.3))
    rules = quality_rules.learn({"x": x, "y": y}, bad)
    held = np.logical_or.reduce([r.holds({"x": x, "y": y}) for r in rules.rules])
    assert 2 <= len(rules.rules) and (held & ~bad).sum() < 0.02 * (~bad).sum() and (held & bad).sum() > 0.95 * bad.sum()
    assert quality_rules.learn({"x": x}, np.zeros(3000, bool)).rules == ()


# Backoff scores.


def test_backoff_scores_against_brute_force(spark, monkeypatch):
    # Few hot words and parts, so that all kinds of pairs occur.
    texts = random_texts(60, 3, [f"w{int(random.Random(i).paretovariate(0.7))}" for i in range(400)]) + ["", "w1", "w1 w1"]
    words = [t.split() for t in texts]
    one = Counter(w for ws in words for w in ws)
    two = Counter(p for ws in words for p in zip(ws, ws[1:]))
    begun = Counter(w for ws in words for w in ws[:-1])
    total = sum(one.values())

    def score(ws):
        micro = back = 0
        for k, w in enumerate(ws):
            if not k:
                share = one[w] / total
            elif two[ws[k - 1], w] >= 2:
                share = two[ws[k - 1], w] / begun[ws[k - 1]]
            else:
                share, back = 0.4 * one[w] / total, back + 1
            micro += round(np.log(share) * 1e6)
        return micro, back

    for hot, top, parts in [(3, 2, 5), (20, 4, 3), (65_535, 1_024, 1)]:
        monkeypatch.setattr(backoff_scores, "HOT", hot)
        monkeypatch.setattr(backoff_scores, "_START", hot)
        monkeypatch.setattr(backoff_scores, "TOP", top)
        common = [w for w, _ in sorted(one.items(), key=lambda x: (-x[1], x[0]))][:hot]
        h = dart_minhash.word_hashes([w.encode() for w in common])
        order = np.argsort(h)
        pairs = np.zeros(top * top, np.int64)
        for (a, b), n in two.items():
            if a in common[:top] and b in common[:top]:
                pairs[common.index(a) * top + common.index(b)] = n
        pad = [0] * (hot - len(common) + 1)
        c = backoff_scores.Counts(
            h[order], order, np.array([one[w] for w in common] + pad), np.array([begun[w] for w in common] + pad), pairs, total
        )
        import pandas as pd

        frames = [pd.DataFrame({"key": range(k, k + 20), "text": texts[k : k + 20]}) for k in range(0, 60, 20)]
        frames.append(pd.DataFrame({"key": range(60, len(texts)), "text": texts[60:]}))
        packed = pd.concat([f for frame in frames for f in backoff_scores.pack(iter([frame]), c, parts)])
        scored = pd.concat([backoff_scores.score_part(f, c) for _, f in packed.groupby("part")])
        sums = pd.concat([backoff_scores.add_block(f) for _, f in scored.groupby("block")])
        got = {k: (m, b) for k, m, b in sums.itertuples(index=False)}
        assert got == {k: score(ws) for k, ws in enumerate(words) if ws}


@pytest.mark.parametrize("often", [1, 10, 10_000])
def test_scores_of_any_order_against_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(backoff_scores, "OFTEN", often)
    texts = random_texts(60, 7, [f"w{int(random.Random(i).paretovariate(0.9))}" for i in range(400)]) + ["", "w1", "w1 w1", "w1 w1 w2"]
    texts += texts[:20]
    words = [t.split() for t in texts]
    counts = Counter(tuple(ws[i : i + k]) for ws in words for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    begun = Counter(g[:-1] for g, n in counts.items() for _ in range(n))

    def share(g):
        if len(g) == 1:
            return counts[g] / begun[()], 0
        return (counts[g] / begun[g[:-1]], 0) if counts[g] >= 2 else (0.4 * share(g[1:])[0], 1)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for order in (2, 3, 4):
        got = {r.doc_id: r for r in backoff_scores.ngram_scores(docs, order).collect()}
        assert len(got) == len(texts)
        for i, ws in enumerate(words):
            found = [share(tuple(ws[max(0, k - order + 1) : k + 1])) for k in range(len(ws))]
            assert got[i].n_backed_off == sum(b for _, b in found) and got[i].n_words == len(ws)
            assert got[i].log_score_micro == sum(round(np.log(s) * 1e6) for s, _ in found)


# Bit-sliced search.


def test_top_rows_against_sorting():
    rng = np.random.default_rng(4)
    rows = rng.integers(-40, 40, (300, 7))
    rows[100:200] = rows[5]
    ids = rng.permutation(300)
    block = bit_sliced.slice_block(ids.astype(np.int64), rows)
    for q in [*rng.integers(-40, 40, (20, 7)), np.zeros(7, np.int64), rows[5]]:
        near, points = bit_sliced.search_block(block, 17, q, 10)
        want = sorted((-int(r @ q), i) for i, r in zip(ids.tolist(), rows) if i != 17)[:10]
        assert sorted(zip([-p for p in points], near.tolist())) == want


def test_large_components_take_part(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [2.1e6, 1.0]), (1, [2.0, 1.0]), (2, [4e6, 0.0]), (3, [-4e6, 2.0]), (4, [0.0, 1e30]), (100, [0.0, -0.5]), (200, [1e-30, 0.0])]
    vectors = spark.createDataFrame(rows, schema)
    whole = {i: [int(np.floor(1024 * c)) for c in v] for i, v in rows}
    got = bit_sliced.top_k(vectors.filter("vec_id <> 4"), vectors.filter("vec_id % 100 = 0")).collect()
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i not in (q, 4))
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(i, -n) for n, i in scores]
    # A vector of any size is found where scores fit a long.
    far = bit_sliced.top_k(vectors, vectors.filter("vec_id = 200"), k=10).collect()
    assert [r.score for r in far] == [0] * 6
    with pytest.raises(Exception, match="out of bounds|too large|Overflow|overflow"):
        bit_sliced.top_k(vectors, vectors.filter("vec_id = 4")).collect()


# HTML.


def test_wrapper_of_a_host():
    pages = [
        f"<html><body><div class=top>Site</div><ul>{'<li><a href=/x>l</a>' * n}</ul><div>Text {n} &eacute;</div>"
        f"{'<i>old</i>' if n % 2 else ''}<div class=x>Bye</div></body></html>"
        for n in range(1, 6)
    ]
    wrapper = html_wrappers.stream(pages[0])
    for page in pages[1:]:
        wrapper = html_wrappers.align(wrapper, html_wrappers.stream(page))
    shown = html_wrappers.expression(wrapper)
    assert "(<li><a>'l'</a></li>)+" in shown and "'Site'" in shown and "(<i>'old'</i>)?" in shown
    assert html_wrappers.main_text(pages[0], html_wrappers.template(wrapper)) == "Text 1 é"


def test_marked_articles_are_read_whole():
    page = (
        "<!DOCTYPE html><title>t</title><nav>menu</nav><script>var t='</p>';</script><article><h1>A&amp;B</h1><p>one<b>two</b>"
        "<br>three<p>four<!-- no --><div class='comments'>reader</div><div class=ad-box>buy</div></article><footer>f</footer>"
    )
    assert html_wrappers.main_text(page) == "A&B onetwo three four"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_wrappers.main_text(deep) == "x" and html_wrappers.stream(deep)


def test_copies_and_small_groups_are_no_template(spark):
    wide = "".join(f"<div class='k{chr(97 + i % 26)}{chr(97 + i // 26)}'>x{{n}}y{i}</div>" for i in range(500))
    page = lambda n, more="": f"<html><body><p>Text {n}</p>{more}{wide.replace('{n}', str(n))}<div>Bye</div></body></html>"
    rows = [("copies", "<html><body><p>Same</p></body></html>")] * 5
    rows += [("group", f"<html><body><p>Text {n}</p>{'<h3>Rare</h3>' if n < 3 else ''}<div>Bye</div></body></html>") for n in range(20)]
    rows += [("wide", page(n)) for n in range(4)]
    pages = spark.createDataFrame([(i, f"http://{h}.org/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in html_wrappers.main_texts(pages).orderBy("page_id").collect()]
    assert got[:5] == ["Same"] * 5
    assert got[5:25] == [f"Text {n}{' Rare' if n < 3 else ''}" for n in range(20)]
    assert [t.split()[-1] for t in got[25:]] == [f"x{n}y499" for n in range(4)]
    many = [[f"a.{i}", 1, False, False, []] for i in range(1000)]
    other = [[f"b.{i}", 1, False, False, []] for i in range(1000)]
    assert {x[0] for x in html_wrappers.align(many, other)} == {x[0] for x in many + other}


def test_template_inside_articles_is_left_out(spark):
    page = (
        "<body><article><h1>T{n}</h1><p>Text <a href=/x>link{n}</a> {n}</p><ul><li><a href=/r>more{n}</a></ul>"
        "<div class=zone>Try our plan</div></article><p>Bye {n}</p></body>"
    )
    rows = [(n, f"http://a.org/{n}", page.replace("{n}", str(n))) for n in range(6)]
    rows += [(6, "http://b.org", page.replace("{n}", "6")), (7, "http://a.org/7", "<body><article><div class=zone>Try our plan</div></article><p>Left</p></body>")]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[n] for n in range(6)] == [f"T{n} Text link{n} {n}" for n in range(6)]
    assert got[6] == "T6 Text link6 6 more6 Try our plan" and got[7] == "Left"


# Classifier.


def test_classifier_learns_and_ignores_held_out_labels(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        good = i % 2
        words = [f"w{r.randint(0, 3000)}" + ("" if good else "***") for _ in range(40)]
        rows.append((i, " ".join(words), good))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = table.drop("quality"), table.select("doc_id", "quality")
    got = quality_classifier.quality_scores(docs, labels).collect()
    held = [g for g in got if g.held_out]
    assert 100 < len(held) < 300 and sum(g.predicted == g.doc_id % 2 for g in held) > 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 0).otherwise(F.col("quality")))
    again = quality_classifier.quality_scores(docs.repartition(5), flipped).collect()
    assert {g.doc_id: g.score for g in got} == {g.doc_id: g.score for g in again}


# Curriculum.


def test_mix_reaches_targets(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "c", "c", "c", None])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = curriculum.mix(table, keep=["source"]).collect()
    sources = {m.source: m for m in mixed}
    total = sum(m.size for m in mixed)
    assert sum(m.target for m in sources.values()) == pytest.approx(1.5 * total)
    for name, m in sources.items():
        own = [x for x in mixed if x.source == name]
        assert sum(x.taken for x in own) == int(m.target) and m.target <= 2 * m.source_size
        assert all(x.taken <= 2 * x.size and (x.copies > 0) == (x.taken > 0) for x in own)
        places = [p for x in own for p in x.positions]
        assert all(0 <= p <= 1 for p in places)
    # A source that fades has more than half of its copies in the first half.
    fading = [p for x in mixed if x.source == "a" for p in x.positions]
    assert sum(p < 0.5 for p in fading) > 0.58 * len(fading)
    again = curriculum.mix(table.repartition(7), keep=["source"]).collect()
    assert sorted((m.doc_id, m.taken, m.position or -1) for m in mixed) == sorted((m.doc_id, m.taken, m.position or -1) for m in again)


def test_mixed_rows_are_told_apart(spark):
    rows = [(1, "w w", "p\x1f=q", "r"), (1, "w w", "p", "q\x1f=r"), (None, "w w w", None, "x"), (None, "w", None, "x")] + [
        (7, f"w{i}", "hot", "y") for i in range(500)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = curriculum.mix(table, keep=["lang"]).select("copies").groupBy().sum().first()[0]
    mixed = curriculum.mixed_documents(table).collect()
    assert len(mixed) == taken and {tuple(r) for r in mixed} <= set(rows)
    assert {tuple(r) for r in mixed if r.doc_id == 1} == set(rows[:2])


# Token counts.


def test_spliced_counts_equal_whole_counts(spark):
    t = token_counts.tokenizer("byte_bpe_50k.json")
    r = random.Random(7)
    alphabet = "ab  \n'sré😀12.<|>" + "x"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 900))) for _ in range(60)]
    texts += ["x" * 700, " " * 700, "it's<|endoftext|>" * 50, "don't " * 120, "12'll" * 99]
    want = [len(t.encode(x, add_special_tokens=False)) for x in texts]
    got = [token_counts.count_widening("byte_bpe_50k.json", x, 100, 50) for x in texts]
    assert got == want
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = token_counts.token_counts(table, step=100, overlap=50).collect()
    assert {c.doc_id: (c.n_tokens, c.n_bytes) for c in counted} == {
        i: (n, len(x.encode())) for i, (n, x) in enumerate(zip(want, texts))
    }


# Secrets.


def test_secret_scan_against_plain_search(spark):
    r = random.Random(8)
    bits = ["token", "API_KEY", "apikey", "passwd", "ſecret", '"', "'", " = ", ":", "AKIA", "ABCDEFGH12345678", "deadbeef",
            "0123456789abcdef", "x", "é", "\n", "abcdefghijkl", "ghp_" + "a" * 36, "secret="]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.secret_report(table).collect():
        text, found = texts[row.doc_id], []
        for k, (kind, pattern, group, least, either) in enumerate(secret_scan.BASE_RULES):
            for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if either else 0)):
                if len(m[group]) >= least:
                    found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        joined = ",".join(s for *_, s in sorted(found))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))
        assert row.n_hex == sum(k == 2 for _, k, _ in found)


def test_trigram_queries_hold_for_every_match():
    for kind, pattern, _, _, _ in secret_scan.RULES:
        assert (secret_scan.trigram_query(pattern) is True) == (kind == "hex")


def test_long_secrets_are_masked_whole(spark):
    line, begin = "MIIEpAIBAAKCAQEA7+/b" * 3, "-----BEGIN RSA PRIVATE KEY-----"
    end = begin.replace("BEGIN", "END")
    texts = {
        f"a {begin}\n{line}\n{line}\nab==\n{end} z": "a [SECRET] z",
        f"a {begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES,0f\n\n{line}\n{end}\nz": "a [SECRET]\nz",
        f'k="{begin}\\n{line}\\n{end}\\n"': 'k="[SECRET]\\n"',
        f"a {begin}\n{line}\n{line}\nab==\n\nThe text goes on.": "a [SECRET]\n\nThe text goes on.",
        f"{begin}\n{line}\nab==\nSome text\n{begin}\n{line}\n{end}\nz": "[SECRET]\nSome text\n[SECRET]\nz",
        f"a {begin}\nThe text goes on.": "a [SECRET]\nThe text goes on.",
        f"a {begin}\nHello\nyou": "a [SECRET]\nHello\nyou",
        "x ghp_" + "Zy" * 300 + " y": "x [SECRET] y",
        "x xoxb-" + "Zy-" * 300 + " y": "x [SECRET] y",
        "x sk_live_" + "Zy" * 300 + " y": "x [SECRET] y",
    }
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_scan.mask(table).orderBy("doc_id").collect()]
    assert got == list(texts.values())


# SentencePiece.


def test_ids_equal_the_librarys(spark):
    import sentencepiece
    from rarebird.llm.common import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(shared_prefix.MODEL))
    r = random.Random(9)
    texts = ["".join(r.choice("abcde  \n\tABéß漢😀09.,!<s>") for _ in range(r.randint(0, 50))) for _ in range(2000)]
    texts += random_texts(100, 10) + [LONG[:5000], " ", "   a", "a" * 300]
    encoded = shared_prefix.encode_block(texts)
    assert [e.tolist() for e in encoded] == sp.encode(texts)
    assert shared_prefix.decode_block(encoded) == texts


def test_models_of_other_kinds_are_refused(monkeypatch):
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        def get_score(self, i):
            return super().get_score(i) - 0.5

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    monkeypatch.setattr(shared_prefix, "_loaded", {})
    with pytest.raises(ValueError, match="not a BPE model"):
        shared_prefix.load(shared_prefix.MODEL)


def test_known_words_are_let_go_in_two_steps(monkeypatch):
    monkeypatch.setattr(shared_prefix, "REMEMBERED", 4)
    monkeypatch.setattr(shared_prefix, "BLOCK_CHARS", 5)
    texts = random_texts(40, 21)
    want = shared_prefix.encode_block(texts)
    shared_prefix.load(shared_prefix.MODEL)[2].clear()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(shared_prefix.encode_block(texts), want))


def test_unigram_search_against_brute_force():
    r = random.Random(11)
    scores = {p: (i, -r.random() * 5) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "bab"])}
    pieces = shared_prefix.Pieces(scores, list(range(100, 356)), unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max(scores[word[:n]][1] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in scores)

    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(200)})
    by_id = {i: s for i, s in scores.values()}
    for word, ids in pieces.walk(words):
        assert sum(by_id[i] for i in ids) == pytest.approx(best(word))


# Near-duplicates.


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(12)
    off = []
    for _ in range(60):
        ids = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = rng.random(200) * 3, rng.random(200) * 3
        b[:120] = a[:120]
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        off.append((dart_minhash.signature(ids, a, 128) == dart_minhash.signature(ids, b, 128)).mean() - j)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def like_texts(seed, n=150):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        words = base[:] if r.random() < 0.6 else [f"w{r.randint(0, 500)}" for _ in range(r.randint(1, 100))]
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"v{r.randint(0, 99999)}"
        texts.append(" ".join(words))
    return texts + ["a b", "a b", "a  b", "", None, None]


@pytest.mark.parametrize("small", [2048, 2])
@pytest.mark.parametrize("weighting", ["set", "count"])
def test_classes_against_all_pairs(spark, monkeypatch, small, weighting):
    monkeypatch.setattr(dart_minhash, "SMALL_BUCKET", small)
    texts = like_texts(13)
    sets = []
    for t in texts:
        w = t.split() if t else []
        c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        sets.append(c if weighting == "count" else Counter(dict.fromkeys(c, 1)))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = (sets[i] & sets[j]).total()
            if common and common >= 0.8 * (sets[i].total() + sets[j].total() - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dart_minhash.near_duplicates(table, weighting=weighting).collect()
    assert {g.doc_id: g.class_id for g in got} == {i: root(i) for i in range(len(texts))}


def test_texts_are_linked_whatever_their_ids(spark):
    a, b, c = ([" ".join(f"{k}{i}" for i in range(40)) + f" end{n}" for n in range(3)] for k in "abc")
    rows = [
        (None, a[0], "near"), (None, a[1], "near"), (9, a[2], "near"),  # ids missing
        (5, b[0], "one id"), (5, c[0], "one id"), (5, b[0], "one id"), (6, b[1], "near"),  # an id of unlike texts
        (None, c[1], "near"), (None, c[1], "again"), (None, "nobody's text", "alone"), (None, "nobody's text", "alone"),
        (7, None, "none"), (7, None, "none"), (7, " ", "none"), (None, None, "none"), (None, None, "none"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, Class_ID string")
    got = Counter((r.doc_id, r.class_id) for r in dart_minhash.near_duplicates(table).collect())
    # a is 9's class, b and c are classes of their own that are both known by 5.
    assert got == Counter({(None, 9): 2, (9, 9): 1, (5, 5): 3, (6, 5): 1, (None, 5): 2, (None, None): 4, (7, 7): 3})
    single = dart_minhash.one_of_each(table)
    assert single.columns == table.columns
    kept = Counter((r.doc_id, r.text) for r in single.collect())
    want = [(9, a[2]), (5, b[0]), (5, c[0]), (None, "nobody's text"), (7, None), (7, " "), (None, None), (None, None)]
    assert kept == Counter(want)
    named = table.select(table.doc_id.cast("string").alias("doc_id"), "text")
    assert Counter((r.doc_id, r.class_id) for r in dart_minhash.near_duplicates(named).collect()) == Counter(
        {tuple(None if v is None else str(v) for v in key): n for key, n in got.items()}
    )


def test_small_buckets_lose_no_link():
    r = random.Random(14)
    for _ in range(40):
        base = list(range(40))
        sets = [np.array(sorted({x if r.random() > 0.12 else r.randint(100, 200) for x in base})) for _ in range(25)]
        found = dart_minhash.link_bucket(list(range(25)), sets, list(range(25)), 0.8)
        parent = list(range(25))

        def joined(pairs):
            parent[:] = range(25)
            for a, b in pairs:
                x, y = parent[a], parent[b]
                parent[:] = [min(x, y) if p in (x, y) else p for p in parent]
            return list(parent)

        jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        every = [(i, j) for j in range(25) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
        assert joined(found) == joined(every)


def test_no_bucket_is_finished_whose_texts_have_all_been_compared(spark, monkeypatch):
    texts = {1: range(100), 2: range(50, 150), 3: range(500, 600), 4: range(505, 605), 5: range(3, 103), 6: range(13, 113)}
    sets = spark.createDataFrame([(i, list(x)) for i, x in texts.items()], "id long, pieces array<long>")
    # Both texts compared and unlike; two unlike the least one but like each other; two pairs near the
    # least one (distances 0.06, 0.23), like each other only across (0.18).
    buckets = {10: [1, 2], 11: [1, 3, 4], 12: [1, 5, 6]}
    members = spark.createDataFrame([(b, i, 100) for b, ids in buckets.items() for i in ids], "bucket long, id long, n int")
    finish, left = dart_minhash._finish, []
    monkeypatch.setattr(dart_minhash, "_finish", lambda rows, *a: (left.extend(rows.collect()), finish(rows, *a))[1])
    roots = {r.id: r.root for r in dart_minhash.links(members, sets, 0.8).collect()}
    assert {(r.bucket, r.id) for r in left} == {(11, 3), (11, 4), (12, 5), (12, 6)}
    assert roots == {1: 1, 5: 1, 6: 1, 3: 3, 4: 3}


def test_buckets_go_on_from_known_distances():
    r = random.Random(15)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for _ in range(40):
        base = list(range(40))
        sets = [np.array(sorted({x if r.random() > 0.12 else r.randint(100, 200) for x in base})) for _ in range(25)]
        known = [1.0 - jaccard(sets[0], s) for s in sets[1:]]
        # Those like the first text have been joined to it.
        classes = [0 if 1.0 - d >= 0.8 else i for i, d in enumerate(known, 1)]
        found = dart_minhash.link_bucket(list(range(1, 25)), sets[1:], classes, 0.8, known)
        every = [(i, j) for j in range(25) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]

        def joined(pairs):
            parent = list(range(25))
            for a, b in pairs:
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
            return parent

        assert joined([*found, *((0, i) for i, c in enumerate(classes, 1) if c == 0)]) == joined(every)


def test_texts_in_a_block_are_as_they_are_alone(monkeypatch):
    monkeypatch.setattr(dart_minhash, "LONG_WORD", 6)
    odd = ["", None, " \n", "a", "a b", "a  b\x1cc d\x0be f", "muchlonger words é ü 漢字 muchlonger", "a a a a a a a a", "p q r s t ", " p q r s t u"]
    texts = pa.array(odd + random_texts(60, 16) + ["end"])
    for weighting in ("set", "count"):
        ids, weights, sizes = dart_minhash.flat_elements(texts, weighting)
        bounds = np.cumsum(sizes)[:-1]
        signatures = iter(dart_minhash.signatures(ids, weights, sizes[sizes > 0], 160))
        for text, mine, its in zip(texts.to_pylist(), np.split(ids, bounds), np.split(weights, bounds)):
            words = text.encode().split() if text else []
            runs = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
            assert len(mine) == len(runs) and sorted(its) == sorted(runs.values() if weighting == "count" else [1] * len(runs))
            alone, heavy, _ = dart_minhash.flat_elements(pa.array([text], pa.string()), weighting)
            assert (alone == mine).all() and (heavy == its).all()
            if runs:
                assert (dart_minhash.signature(alone, heavy, 160) == next(signatures)).all()
    cut = [x for block in dart_minhash.blocks(texts, 100) for x in block.to_pylist()]
    assert cut == texts.to_pylist()


def test_no_more_texts_are_counted_than_rules_are_learned_from(spark, monkeypatch):
    r = random.Random(22)
    good, bad = ("le un de mot été Haus ".split() for _ in range(2))
    texts = [" ".join(r.choice(good if i % 2 else bad + ["###"] * 6) + str(r.randint(0, 999)) for _ in range(60)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    counted, stage = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, *a: (counted.append((t := stage(df, *a)).count()), t)[1])
    monkeypatch.setattr(quality_rules, "MAX_TRAINING_ROWS", 50)
    kept = {d.doc_id for d in quality_rules.keep_good(docs, labels).collect()}
    assert len(counted) == 1 and 50 <= counted[0] < 200
    measured = quality_rules.with_statistics(docs)
    rules = quality_rules.fit(measured, labels, max_rows=50)
    assert rules.rules and kept == {d.doc_id for d in quality_rules.judge(measured, rules).filter("kept").collect()}
    # Where too few of the first ones pass the base rules, all are counted.
    short = docs.withColumn("text", F.when(F.md5(F.col("doc_id").cast("string")) > "8", F.col("text")).otherwise("few words"))
    counted.clear()
    rules = quality_rules.fit_texts(short, labels, "text", "stats", max_rows=50)
    assert len(counted) == 2 and counted[1] == 400
    assert rules == quality_rules.fit(quality_rules.with_statistics(short), labels, max_rows=50)
