"""Grouping of spelling variants with PartEnum signatures.

A word is taken as the multiset of its letters, a binary vector with a place for each
letter's first, second, third ... occurrence. One letter inserted or deleted changes
one place, one replaced changes two: near words have vectors at a Hamming distance of
at most two. The places are dealt to parts, and a word's signatures are its vector on
all choices of all but two parts (all but one, if lengths differ): two vectors that
differ in as few places agree on some choice, so near words share a signature.

Order is what multisets leave out. Near words agree before and behind the place where
they differ, so each signature is made once for each half of the word in which that
place may lie, and holds the letters outside that half. A signature that many words
share has its range halved again, down to a single place if need be, where all words
that share it are near: no group of many words is ever paired with itself, and none is
left out. Words that share a signature are joined and compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarebird.functions.columns import named
from rarebird.sources.staging import stage

#: The shortest word, in code points, and the least number of its occurrences.
SHORTEST, RAREST = 5, 3
#: One of so many runs loses a letter.
SLIPS = 97
#: Words that may share a signature before its range is halved.
SHARED = 64
#: Distinct words a task counts before it sends them on.
HELD_WORDS = 200_000
#: A-Z, a-z and U+00C0 to U+00FF in UTF-8, after ``bytes.lower`` has lower-cased A-Z alone.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_ROW = "signature long, word string, role int, choice int, low int, high int"
_COLUMNS = [field.split()[0] for field in _ROW.split(", ")]
_ODD = 0x9E3779B97F4A7C15
#: Whose letters a signature may be compared with: those of words of one length, or of
#: the shorter and of the longer of two words.
_EQUAL, _SHORTER, _LONGER = 0, 1, 2


def slipped(run: bytes, prefix: int) -> bytes:
    """The run, less one letter if the CRC-32 of its document and itself says so."""
    h = zlib.crc32(run, prefix)
    if h % SLIPS:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def run_words(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """word and n: how often each word of at least ``SHORTEST`` letters is among the runs of letters of all texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for key, body in zip(frame["key"], frame["text"]):
                if not body:
                    continue
                prefix = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(_RUN.findall(body.encode().lower())).items():
                    # Letters of two bytes begin with 0xC3.
                    if len(run) >= SHORTEST and len(run) - run.count(b"\xc3") >= SHORTEST:
                        held[slipped(run, prefix)] += n
                if len(held) >= HELD_WORDS:
                    yield sent(held)
                    held.clear()
        yield sent(held)

    def sent(held: Counter) -> pd.DataFrame:
        long = [(w.decode(), n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= SHORTEST]
        return pd.DataFrame(long, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    key = F.coalesce(named(id_column).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), named(text).cast("string").alias("text")).filter("text is not null")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def part_digests(word: str, parts: int) -> list[int]:
    """For each part a number that the word's places in the part decide, whatever their order: a sum of hashes."""
    seen: dict[str, int] = {}
    sums = [0] * parts
    for letter in word:
        seen[letter] = seen.get(letter, 0) + 1
        h = _place(letter, seen[letter])
        sums[h % parts] += h
    return sums


@lru_cache(maxsize=10_000)
def _place(letter: str, occurrence: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{letter}{occurrence}")


def agreeing(word: str, role: int) -> list[int]:
    """A number for each choice of all but as many parts as the vectors of near words differ in places at most."""
    apart = 2 if role == _EQUAL else 1
    sums = part_digests(word, apart + 1)
    return [
        sum(sums[p] * pow(_ODD, p + 1, 2**64) for p in chosen) for chosen in combinations(range(len(sums)), len(sums) - apart)
    ]


def outside(word: str, role: int, low: int, high: int) -> int:
    """A number that the letters outside a range of places decide, together with the range and the lengths compared.

    Places are counted in the shorter of two near words; the longer one has one more letter there.
    """
    longer = role == _LONGER
    return xxhash.xxh3_64_intdigest(f"{role == _EQUAL}:{len(word) - longer}:{low}:{word[:low]}:{word[high + longer :]}")


def signature(agreed: int, fixed: int) -> int:
    return (agreed + fixed) % 2**64 - 2**63


def halves(low: int, high: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two halves of a range of places."""
    middle = (low + high) // 2
    return (low, middle), (middle, high)


def word_signatures(word: str) -> Iterator[tuple]:
    """The word's rows, for each half of its places, in each role."""
    for role in (_EQUAL, _SHORTER, _LONGER):
        # A letter may be inserted behind the last one: one place more.
        places = len(word) + (role == _SHORTER)
        agreed = agreeing(word, role)
        for low, high in halves(0, places):
            fixed = outside(word, role, low, high)
            for choice, number in enumerate(agreed):
                yield signature(number, fixed), word, role, choice, low, high


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), 10_000):
            rows = [row for word in frame["word"].iloc[start : start + 10_000] for row in word_signatures(word)]
            yield pd.DataFrame(rows, columns=_COLUMNS)


def _halved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows again, each for both halves of its range."""
    for frame in frames:
        rows = []
        for _, word, role, choice, low, high in frame[_COLUMNS].itertuples(index=False):
            agreed = agreeing(word, role)[choice]
            for some in halves(low, high):
                rows.append((signature(agreed, outside(word, role, *some)), word, role, choice, *some))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def candidates(words: DataFrame, shared: int = SHARED) -> list[DataFrame]:
    """Tables of rows that may meet by signature, in groups of at most ``shared`` words or of one place.

    Ranges are halved as long as more words share a signature: as many rounds as the
    longest such word has binary digits in its length.
    """
    rows = stage(words.select("word").mapInPandas(_signed, _ROW), "spelling-signatures")
    ready = []
    while True:
        many = rows.filter("high - low > 1").groupBy(F.col("signature").alias("hot")).agg(F.count(F.lit(1)).alias("held"))
        many = stage(many.filter(F.col("held") > shared).select("hot"), "spelling-hot")
        if many.isEmpty():
            return [*ready, rows]
        hot = F.col("signature") == F.col("hot")
        ready.append(rows.join(many, hot, "left_anti"))
        rows = stage(rows.join(many, hot, "left_semi").mapInPandas(_halved, _ROW), "spelling-signatures")


def near_words(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """word and near, each way, of all pairs of distinct words that one letter inserted, deleted or replaced makes alike."""
    found = None
    for rows in candidates(words, shared):
        met = rows.select("signature", "word", "role")
        # Both sides are the same rows, dealt once. The shorter word comes first, or else the lesser.
        apart = f"(a.role = {_SHORTER} AND b.role = {_LONGER})"
        alike = f"(a.role = {_EQUAL} AND b.role = {_EQUAL} AND a.word < b.word)"
        pairs = met.alias("a").join(met.alias("b"), F.expr(f"a.signature = b.signature AND ({apart} OR {alike})"))
        pairs = pairs.filter("levenshtein(a.word, b.word, 1) = 1").selectExpr("a.word AS word", "b.word AS near")
        found = pairs if found is None else found.unionByName(pairs)
    pairs = found.distinct()
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, others) with root: the last word that forms lead to.

    A form is at least twice as frequent as its word, so chains end. Every round
    doubles the steps taken; a chain of k steps takes about log2(k) rounds.
    """
    steps = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("root").alias("next")).filter(F.col("at") != F.col("next"))
        moved = steps.join(ahead, F.col("root") == F.col("at"), "left")
        moved = stage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return forms.join(steps, "word")


def variant_groups(words: DataFrame, ratio: int = 2, shared: int = SHARED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; words distinct).

    The form is the most frequent near word, the first in code-point order among
    equals, if it is at least ``ratio`` times as frequent; null otherwise. The root is
    where forms lead, the word itself if nowhere.
    """
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = W.partitionBy("word").orderBy(F.col("near_n").desc(), "near")
    links = near_words(words, shared).join(counts, "near")
    ranked = links.withColumn("rank", F.row_number().over(best)).withColumn("n_near", F.count(F.lit(1)).over(W.partitionBy("word")))
    chosen = ranked.filter("rank = 1").select("word", "near", "near_n", "n_near")
    taken = F.col("near_n") >= ratio * F.col("n")
    forms = words.join(chosen, "word", "left").select(
        "word",
        F.when(taken, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("near_n")).alias("form_n"),
    )
    return with_roots(stage(forms, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``variant_groups`` of the words of all texts that occur ``RAREST`` times at least.

    Null and empty texts have no words, a null id counts as an empty one, repeated
    rows count each, and other columns, whatever their names, play no part. Texts
    without such words, and empty tables, give no rows.
    """
    words = run_words(docs, text, id_column).filter(F.col("n") >= RAREST)
    return variant_groups(stage(words, "spelling-words"))


#: What ``spelling_variants`` gives for the table documents, for DuckDB. Near words
#: become alike when a letter of one or of both is left out at the same place.
ORACLE = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(id || ':' || run)), '..')]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
  FROM lowered, polynomial WHERE length(run) >= 5
), word AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), less AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM word
), less_one AS (
  SELECT word, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM less
), near AS (
  SELECT DISTINCT a.word, b.word AS near FROM less_one a JOIN less_one b USING (rest, pos) WHERE a.word <> b.word
  UNION SELECT l.word, s.word FROM less_one l JOIN word s ON s.word = l.rest
  UNION SELECT s.word, l.word FROM less_one l JOIN word s ON s.word = l.rest
), best AS (
  SELECT near.word, arg_max(near.near, (c.n, rn)) AS near, max(c.n) AS near_n, count(*) AS n_near
  FROM near JOIN (SELECT *, row_number() OVER (ORDER BY word DESC) AS rn FROM word) c ON c.word = near.near GROUP BY near.word
), form AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM word LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM form
  UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL
), rooted AS (
  SELECT chain.word, chain.root FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN rooted USING (word)
"""
