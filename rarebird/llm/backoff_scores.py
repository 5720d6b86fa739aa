"""Stupid-backoff scores of texts under counts of the whole corpus.

The score of a word is the share of its pair among the pairs that begin with the
word before it, if the pair occurs often enough, or else ``ALPHA`` times the
word's share of all words; a text's first word has its share. Logarithms are
summed per document, in whole millionths, so that the order of adding is no matter.

The n-grams of the documents are exploded and dealt out by hash; a task that gets
a part of the hash range counts the n-grams in it and joins the counts to the
n-grams of each document. What would be uneven is counted beforehand and kept at
hand everywhere, within fixed bounds: the ``HOT`` most frequent words, and all pairs
of the ``TOP`` most frequent ones. Pairs of top words are scored where they are read.
Of any other pair, the rarer word decides the part it goes to, so a part has all
that counting needs: a pair with a rare second word meets all occurrences of that
word; a pair with a rare first word meets all pairs it begins; a pair of two
rare words goes to both parts, and is scored by the one that has what it needs.

N-grams travel packed, as arrays of each block of rows: hot words as two bytes,
documents as places in the block. Sums go back packed the same way and are added a
block at a time.

``ngram_scores`` does the same at any order, by tables: the n-grams of each order are
counted by groupBy on their hash, after each block has counted its own; each count
table is joined to the next shorter order's scores and to the counts of its contexts;
and the n-grams of each document are joined to the scores. The few n-grams that make up
more than a ten-thousandth of the corpus are scored where they are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import words
from rarebird.llm.dart_minhash import mixed, word_hashes
from rarebird.sources.staging import stage

ALPHA = 0.4
#: Times a pair must occur for its own share to count.
LEAST = 2
#: Words whose counts every task has (at most 1.5 MB), and words all of whose
#: pairs are counted beforehand (at most 8 MB).
HOT = 65_535
TOP = 1_024
#: Words of a packed block, and pairs that one part holds, about.
BLOCK_WORDS = 500_000
PART_PAIRS = 2_500_000
#: At most so many n-grams are scored where they are read: those with a larger share.
OFTEN = 10_000
_START = HOT


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document keys, word hashes, and each word's place among the keys, of blocks of rows."""
    keys: list[int] = []
    hashes: list[np.ndarray] = []
    size = 0

    def made():
        lengths = [len(h) for h in hashes]
        return np.array(keys, np.int64), np.concatenate(hashes), np.repeat(np.arange(len(keys)), lengths)

    for frame in frames:
        for key, text in zip(frame["key"].tolist(), frame["text"].tolist()):
            found = word_hashes(words(text))
            if len(found):
                keys.append(key)
                hashes.append(found)
                size += len(found)
            if size >= BLOCK_WORDS or len(keys) >= 60_000:
                yield made()
                keys, hashes, size = [], [], 0
    if keys:
        yield made()


@dataclass(frozen=True)
class Counts:
    """Hot words by hash, with their counts; pairs of top words; the number of all words."""

    hashes: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    begun: np.ndarray
    pairs: np.ndarray
    total: int

    def hot(self, h: np.ndarray) -> np.ndarray:
        """The hot words' ids, by descending frequency; -1 for other words."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)


def _logs(share: np.ndarray) -> np.ndarray:
    return np.rint(np.log(share) * 1e6)


def count_words(rows: DataFrame) -> DataFrame:
    """word (its hash), n and begun (times another word follows), of every word of the corpus; staged."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, doc in _blocks(frames):
            last = np.append(doc[1:] != doc[:-1], True)
            found, at, n = np.unique(h, return_inverse=True, return_counts=True)
            ends = np.bincount(at[last], minlength=len(found))
            yield pd.DataFrame({"word": found.view(np.int64), "n": n, "begun": n - ends})

    counted = rows.mapInPandas(count, "word long, n long, begun long")
    return stage(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("begun").alias("begun")), "word-counts")


def _by_id(counts: pd.Series) -> np.ndarray:
    """Counts by hot word's id; 0 for ids no word has, such as that of a text's start."""
    return np.pad(counts.to_numpy(np.int64), (0, HOT + 1 - len(counts)))


def hot_counts(rows: DataFrame, table: DataFrame) -> Counts:
    """Counts that every task needs: those of the hot words, and of pairs of top words."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.orderBy(F.col("n").desc(), "word").limit(HOT).toPandas()
    h = hot["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    counts = Counts(
        h[order],
        order,
        _by_id(hot["n"]),
        _by_id(hot["begun"]),
        np.zeros(0, np.int64),
        int(total),
    )
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_pairs = np.zeros(TOP * TOP, np.int64)
        for _, h, doc in _blocks(frames):
            ids = sent.value.hot(h)
            a, b = ids[:-1], ids[1:]
            both = (a >= 0) & (a < TOP) & (b >= 0) & (b < TOP) & (doc[1:] == doc[:-1])
            all_pairs += np.bincount(a[both] * TOP + b[both], minlength=TOP * TOP)
        at = np.flatnonzero(all_pairs)
        yield pd.DataFrame({"pair": at, "n": all_pairs[at]})

    found = rows.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(TOP * TOP, np.int64)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"]
    return Counts(counts.hashes, counts.ids, counts.words, counts.begun, pairs, counts.total)


def _sums(doc: np.ndarray, n: int, micro: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Per document: sums of the logarithms, words that backed off."""
    return np.stack([np.bincount(doc, micro, n), np.bincount(doc, back, n)])


def pack(frames: Iterator[pd.DataFrame], c: Counts, parts: int) -> Iterator[pd.DataFrame]:
    """Packed pairs of each block for each part; sums that need no part go along with one."""
    for keys, h, doc in _blocks(frames):
        ids = c.hot(h)
        first = np.append(True, doc[1:] != doc[:-1])
        before_h = np.append(h[:1], h[:-1])
        before = np.where(first, _START, np.append(ids[:1], ids[:-1]))
        top = (before < TOP) & (before >= 0) & (ids < TOP) & (ids >= 0)
        n12 = np.zeros(len(h), np.int64)
        n12[top] = c.pairs[before[top] * TOP + ids[top]]
        here = top | ((before == _START) & (ids >= 0))
        a, b, d = before[here], ids[here], doc[here]
        seen = n12[here] >= LEAST
        share = np.where(
            seen,
            n12[here] / np.maximum(c.begun[a], 1),
            np.where(a == _START, 1.0, ALPHA) * c.words[b] / c.total,
        )
        done = _sums(d, len(keys), _logs(share), ~seen & (a != _START))
        hot_a, hot_b = before >= 0, ids >= 0
        kinds = [
            ("hh", ~here & hot_a & hot_b, lambda m: mixed((before[m] * 65536 + ids[m]).astype(np.uint64)), before, ids),
            ("hr", hot_a & ~hot_b, lambda m: mixed(h[m]), before, h),
            ("rh", ~hot_a & hot_b, lambda m: mixed(before_h[m]), before_h, ids),
            ("rr_first", ~hot_a & ~hot_b, lambda m: mixed(before_h[m]), before_h, h),
            ("rr_second", ~hot_a & ~hot_b, lambda m: mixed(h[m]), before_h, h),
        ]
        sent: dict[int, dict] = {int(mixed(keys[:1].view(np.uint64))[0] % np.uint64(parts)): {"done": (keys, done)}}
        for kind, mask, deal, a, b in kinds:
            at = np.flatnonzero(mask)
            to = (deal(at) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            small = lambda x: x.astype(np.uint16) if x.dtype == np.int64 else x
            for some in np.split(at, cuts) if len(at) else []:
                part = int(deal(some[:1])[0] % np.uint64(parts))
                sent.setdefault(part, {})[kind] = (doc[some].astype(np.uint16), small(a[some]), small(b[some]))
        block = xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1
        yield pd.DataFrame(
            {
                "part": list(sent),
                "block": block,
                "n": len(keys),
                "pairs": [pickle.dumps(some, protocol=5) for some in sent.values()],
            }
        )


def _times(x: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[at]


def score_part(frame: pd.DataFrame, c: Counts) -> pd.DataFrame:
    """Sums per document of each block over the pairs of one part, packed."""
    frame = frame.reset_index(drop=True)
    blocks = [pickle.loads(b) for b in frame["pairs"]]
    offsets = np.concatenate([[0], np.cumsum(frame["n"])])
    out = np.zeros((2, offsets[-1]))
    for at, some in zip(offsets, blocks):
        if "done" in some:
            out[:, at : at + len(some["done"][0])] += some["done"][1]

    def gathered(kind: str, a_type, b_type):
        found = [(at, some[kind]) for at, some in zip(offsets, blocks) if kind in some]
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
        return (
            join([at + x[0].astype(np.int64) for at, x in found], np.int64),
            join([x[1] for _, x in found], a_type),
            join([x[2] for _, x in found], b_type),
        )

    def add(doc, share, back) -> None:
        nonlocal out
        if len(doc):
            out += _sums(doc, offsets[-1], _logs(share), back)

    pair = lambda a, b: mixed(mixed(a.astype(np.uint64)) * np.uint64(3) + b.astype(np.uint64))
    doc, a, b = gathered("hh", np.int64, np.int64)
    n12 = _times(a * 65536 + b)
    seen = n12 >= LEAST
    add(doc, np.where(seen, n12 / np.maximum(c.begun[a], 1), ALPHA * c.words[b] / max(1, c.total)), ~seen)

    doc, a, b = gathered("hr", np.int64, np.uint64)
    doc2, a2, b2 = gathered("rr_second", np.uint64, np.uint64)
    n2 = _times(np.concatenate([b, b2]))
    n12 = _times(pair(a, b))
    seen = (n12 >= LEAST) & (a != _START)
    rest = np.where(a == _START, 1.0, ALPHA) * n2[: len(b)] / max(1, c.total)
    add(doc, np.where(seen, n12 / np.maximum(c.begun[a], 1), rest), ~seen & (a != _START))
    unseen = _times(pair(a2, b2)) < LEAST
    add(doc2[unseen], ALPHA * n2[len(b) :][unseen] / max(1, c.total), np.ones(int(unseen.sum())))

    doc, a, b = gathered("rh", np.uint64, np.int64)
    doc2, a2, b2 = gathered("rr_first", np.uint64, np.uint64)
    begun = _times(np.concatenate([a, a2]))
    n12 = _times(pair(a, b))
    seen = n12 >= LEAST
    add(doc, np.where(seen, n12 / begun[: len(a)], ALPHA * c.words[b] / max(1, c.total)), ~seen)
    n12 = _times(pair(a2, b2))
    seen = n12 >= LEAST
    add(doc2[seen], (n12 / begun[len(a) :])[seen], np.zeros(int(seen.sum())))
    sums = []
    for at, end, some in zip(offsets, offsets[1:], blocks):
        micro, back = out[:, at:end].astype(np.int64)
        touched = np.flatnonzero(micro | back).astype(np.uint16)
        keys = some["done"][0] if "done" in some else None
        sums.append(pickle.dumps((keys, touched, micro[touched], back[touched].astype(np.int32)), protocol=5))
    return pd.DataFrame({"block": frame["block"], "n": frame["n"], "sums": sums})


def add_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums per document of one block, from those of all parts."""
    micro, back = np.zeros((2, frame["n"].iloc[0]), np.int64)
    keys = None
    for blob in frame["sums"]:
        some_keys, at, some_micro, some_back = pickle.loads(blob)
        keys = keys if some_keys is None else some_keys
        micro[at] += some_micro
        back[at] += some_back
    return pd.DataFrame({"key": keys, "micro": micro, "back": back})


def _per_row(named: DataFrame, sums: DataFrame, id_column: str) -> DataFrame:
    """The result's rows from the sums per key."""
    # Rows alike in id and text have one key; their sums hold every copy.
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = named.select("id", "key", size.alias("n_words"))
    copies = sizes.groupBy(F.col("key").alias("same")).agg(F.count("*").alias("copies"))
    share = lambda column: F.coalesce((F.col(column) / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    return (
        sizes.join(copies, F.col("key") == F.col("same"))
        .join(sums, F.col("key") == F.col("of"), "left")
        .select(
            F.col("id").alias(id_column), "n_words", share("back").alias("n_backed_off"), share("micro").alias("log_score_micro")
        )
        .withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score_micro") / F.col("n_words") / 1e6))
    )


def backoff_scores(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, n_words, n_backed_off, log_score_micro and mean_log_score.

    ``log_score_micro`` is the sum over words of the rounded millionfold natural
    logarithm of their scores. Null and empty texts have no words, a sum of 0 and
    a null mean. Repeated rows count in the corpus each and have a row each.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    named = named.withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    rows = named.filter("text is not null").select("key", "text")
    table = count_words(rows)
    counts = hot_counts(rows, table)
    parts = max(1, -(-counts.total // PART_PAIRS))
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return pack(frames, sent.value, parts)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        return score_part(frame, sent.value)

    sums = (
        rows.mapInPandas(packed, "part int, block long, n int, pairs binary")
        .groupBy("part")
        .applyInPandas(score, "block long, n int, sums binary")
        .groupBy("block")
        .applyInPandas(add_block, "key long, micro long, back long")
        .groupBy("key")
        .agg(F.sum("micro").alias("micro"), F.sum("back").alias("back"))
        .withColumnRenamed("key", "of")
    )
    return _per_row(named, sums, id_column)


def _grams(h: np.ndarray, doc: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: where n-grams end, their hashes and those of their contexts."""
    place = np.arange(len(h)) - np.searchsorted(doc, doc)
    gram = mixed(h)
    out = [(np.arange(len(h)), gram, np.zeros(len(h), np.uint64))]
    for k in range(2, order + 1):
        context = np.append(gram[:1], gram[:-1])
        gram = mixed(mixed(context + np.uint64(k)) * np.uint64(3) + h)
        at = np.flatnonzero(place >= k - 1)
        out.append((at, gram[at], context[at]))
    return out


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """k, gram, context, shorter (without its first word), n and longest (times it has all the context) of all n-grams; staged."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, doc in _blocks(frames):
            grams = _grams(h, doc, order)
            shorter = np.zeros(len(h), np.uint64)
            place = np.arange(len(h)) - np.searchsorted(doc, doc)
            for k, (at, gram, context) in enumerate(grams, 1):
                found, first, of, n = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                longest = n if k == order else np.bincount(of[place[at] == k - 1], minlength=len(found))
                yield pd.DataFrame(
                    {
                        "k": k,
                        "gram": found.view(np.int64),
                        "context": context[first].view(np.int64),
                        "shorter": shorter[at][first].view(np.int64),
                        "n": n,
                        "longest": longest,
                    }
                )
                shorter[at] = gram

    counted = rows.mapInPandas(count, "k int, gram long, context long, shorter long, n long, longest long")
    # All rows of a gram have one context and one shorter gram.
    table = counted.groupBy("k", "gram", "context", "shorter").agg(F.sum("n").alias("n"), F.sum("longest").alias("longest"))
    return stage(table, "gram-counts", "k")


def gram_scores(table: DataFrame, order: int) -> DataFrame:
    """gram, micro, back and n of the n-grams that words are scored by."""
    total = table.filter("k = 1").agg(F.sum("n")).first()[0] or 0
    below = None
    for k in range(1, order + 1):
        own = table.filter(F.col("k") == k)
        if below is None:
            scored = own.withColumn("share", F.col("n") / F.lit(total)).withColumn("back", F.lit(0))
        else:
            begun = own.groupBy("context").agg(F.sum("n").alias("begun")).withColumnRenamed("context", "of")
            seen = own.filter(F.col("n") >= LEAST).join(begun, F.col("context") == F.col("of"))
            seen = seen.withColumn("share", F.col("n") / F.col("begun")).withColumn("back", F.lit(0)).drop("of", "begun")
            lower = below.select(F.col("gram").alias("of"), F.col("share").alias("lower"))
            rest = own.filter(F.col("n") < LEAST).join(lower, F.col("shorter") == F.col("of"))
            rest = rest.withColumn("share", ALPHA * F.col("lower")).withColumn("back", F.lit(1)).drop("of", "lower")
            scored = seen.unionByName(rest)
        below = stage(scored.select("gram", "share", "back", "n", "longest"), f"gram-scores-{k}")
        used = below.filter("longest > 0")
        scores = used if k == 1 else scores.unionByName(used)
    return scores.select("gram", F.rint(F.log("share") * 1e6).cast("long").alias("micro"), "back", F.col("longest").alias("n"))


def ngram_scores(docs: DataFrame, order: int = 3, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """What ``backoff_scores`` gives, with up to ``order`` - 1 words before a word as its context.

    A word backs off if the n-gram with all of that context is too rare; it then has
    ``ALPHA`` times its score under a context shorter by a word, and so on.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    named = named.withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    rows = named.filter("text is not null").select("key", "text")
    scores = gram_scores(count_grams(rows, order), order)
    total = scores.agg(F.sum("n")).first()[0] or 0
    often = scores.filter(F.col("n") > total / OFTEN).toPandas().sort_values("gram")
    sent = docs.sparkSession.sparkContext.broadcast([often[c].to_numpy(np.int64) for c in ("gram", "micro", "back")])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, hot_micro, hot_back = sent.value
        for keys, h, doc in _blocks(frames):
            gram = np.zeros(len(h), np.uint64)
            for at, some, _ in _grams(h, doc, order):
                gram[at] = some
            gram = gram.view(np.int64)
            at = np.minimum(np.searchsorted(hot, gram), max(0, len(hot) - 1))
            known = hot[at] == gram if len(hot) else np.zeros(len(h), bool)
            done = _sums(doc[known], len(keys), hot_micro[at[known]], hot_back[at[known]]).astype(np.int64)
            # n = 0: what is known of a document; its gram only deals the row out.
            yield pd.DataFrame({"key": keys, "at": keys, "n": 0, "known": done[0], "known_back": done[1]})
            by = pd.DataFrame({"doc": doc[~known], "at": gram[~known]}).groupby(["doc", "at"], sort=False).size().reset_index(name="n")
            yield pd.DataFrame({"key": keys[by["doc"]], "at": by["at"], "n": by["n"], "known": 0, "known_back": 0})

    spread_rows = rows.mapInPandas(spread, "key long, at long, n int, known long, known_back long")
    cold = scores.filter(F.col("n") <= total / OFTEN).select("gram", "micro", "back")
    joined = spread_rows.join(cold, (F.col("at") == F.col("gram")) & (F.col("n") > 0), "left")
    share = lambda column, known: F.sum(F.coalesce(F.col(column) * F.col("n"), F.lit(0)) + F.col(known)).alias(column)
    sums = joined.groupBy("key").agg(share("micro", "known"), share("back", "known_back")).withColumnRenamed("key", "of")
    return _per_row(named, sums, id_column)


#: What ``backoff_scores`` gives for the table documents, for DuckDB.
ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents
), positions AS (
  SELECT r, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM rows)
), one AS (SELECT w, count(*) AS n FROM positions GROUP BY w
), begun AS (SELECT v, count(*) AS n FROM positions WHERE v IS NOT NULL GROUP BY v
), two AS (SELECT v, w, count(*) AS n FROM positions WHERE v IS NOT NULL GROUP BY v, w
), total AS (SELECT count(*) AS n FROM positions
), scored AS (
  SELECT p.r, p.v IS NOT NULL AND two.n < 2 AS back,
    CAST(round(ln(CASE WHEN p.v IS NULL THEN one.n / total.n
      WHEN two.n >= 2 THEN two.n / begun.n
      ELSE 0.4::DOUBLE * one.n / total.n END) * 1e6) AS BIGINT) AS micro
  FROM positions p CROSS JOIN total JOIN one ON p.w = one.w
    LEFT JOIN two ON p.v = two.v AND p.w = two.w LEFT JOIN begun ON p.v = begun.v
), sums AS (
  SELECT r, CAST(sum(micro) AS BIGINT) AS micro, CAST(sum(CAST(back AS INT)) AS BIGINT) AS back FROM scored GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(back, 0) AS n_backed_off,
  coalesce(micro, 0) AS log_score_micro,
  CASE WHEN len(ws) > 0 THEN micro / len(ws)::DOUBLE / 1e6::DOUBLE END AS mean_log_score
FROM rows LEFT JOIN sums USING (r)
"""

#: What ``ngram_scores`` gives for the table documents at order 3, for DuckDB.
ORACLE_OF_THREE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents
), positions AS (
  SELECT r, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM rows)
), one AS (SELECT w, count(*) AS n FROM positions GROUP BY w
), begun AS (SELECT v, count(*) AS n FROM positions WHERE v IS NOT NULL GROUP BY v
), two AS (SELECT v, w, count(*) AS n FROM positions WHERE v IS NOT NULL GROUP BY v, w
), begun_two AS (SELECT u, v, count(*) AS n FROM positions WHERE u IS NOT NULL GROUP BY u, v
), three AS (SELECT u, v, w, count(*) AS n FROM positions WHERE u IS NOT NULL GROUP BY u, v, w
), total AS (SELECT count(*) AS n FROM positions
), under_pair AS (
  SELECT p.r, p.u IS NOT NULL AS has_u, three.n AS n3, begun_two.n AS b2, p.v IS NOT NULL AND two.n < 2 AS back,
    CASE WHEN p.v IS NULL THEN one.n / total.n
      WHEN two.n >= 2 THEN two.n / begun.n
      ELSE 0.4::DOUBLE * (one.n / total.n) END AS share
  FROM positions p CROSS JOIN total JOIN one ON p.w = one.w
    LEFT JOIN two ON p.v = two.v AND p.w = two.w LEFT JOIN begun ON p.v = begun.v
    LEFT JOIN three ON p.u = three.u AND p.v = three.v AND p.w = three.w
    LEFT JOIN begun_two ON p.u = begun_two.u AND p.v = begun_two.v
), scored AS (
  SELECT r, CASE WHEN has_u THEN n3 < 2 ELSE back END AS back,
    CAST(round(ln(CASE WHEN NOT has_u THEN share WHEN n3 >= 2 THEN n3 / b2 ELSE 0.4::DOUBLE * share END) * 1e6) AS BIGINT) AS micro
  FROM under_pair
), sums AS (
  SELECT r, CAST(sum(micro) AS BIGINT) AS micro, CAST(sum(CAST(back AS INT)) AS BIGINT) AS back FROM scored GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(back, 0) AS n_backed_off,
  coalesce(micro, 0) AS log_score_micro,
  CASE WHEN len(ws) > 0 THEN micro / len(ws)::DOUBLE / 1e6::DOUBLE END AS mean_log_score
FROM rows LEFT JOIN sums USING (r)
"""
