"""Token counts by overlap resynchronisation.

Texts of up to ``step`` characters are encoded as they are. A longer text is cut
into chunks that start every ``step`` characters and reach ``overlap`` characters
into the next; each chunk is encoded by itself, with offsets, in whichever task
it lands. Neighbouring chunks are spliced at the first position where both begin
a pre-token.

Why such a position is stable: the pre-tokeniser scans from left to right and
never looks back, so two scans that start a match at the same position go on
alike, and merges never cross pre-tokens. What a scan says near the end of its
chunk may change with the text that follows, by at most the longest lookahead or
special token; positions in the last ``GUARD`` characters are not used.

Where two chunks share no boundary (one word longer than the overlap, say), the
text is counted again with overlap and step doubled, until chunks align or one
chunk holds the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import free_name, text_or_empty, tokenizer_path

STEP = 65_536
OVERLAP = 1_024
#: Characters at a chunk's end whose boundaries are not trusted: more than the
#: 13 of the longest special token and the 3 of the longest lookahead.
GUARD = 32
_BATCH = 64
_loaded: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once a worker, without truncation or padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_path(path))
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def count_batch(path: str, texts: list[str]) -> list[int]:
    t = tokenizer(path)
    out: list[int] = []
    for at in range(0, len(texts), _BATCH):
        out += [len(e) for e in t.encode_batch_fast(texts[at : at + _BATCH], add_special_tokens=False)]
    return out


def boundaries(path: str, chunk: str, start: int, overlap: int) -> tuple[int, list, list, list, list]:
    """Tokens of a chunk, and where pre-tokens begin in its first and last ``overlap`` characters.

    Positions count from the text's start; beside each stands the number of the
    chunk's tokens before it.
    """
    e = tokenizer(path).encode(chunk, add_special_tokens=False)
    words, offsets, n = e.word_ids, e.offsets, len(chunk)
    begins = [(offsets[i][0], i) for i in range(len(words)) if not i or words[i] is None or words[i] != words[i - 1]]
    head = [b for b in begins if b[0] < min(overlap, n - GUARD)]
    tail = [b for b in begins if n - overlap <= b[0] < n - GUARD]
    return (
        len(words),
        [start + p for p, _ in head],
        [i for _, i in head],
        [start + p for p, _ in tail],
        [i for _, i in tail],
    )


def splice(parts: list[tuple[int, list, list, list, list]]) -> int | None:
    """Tokens of the text whose chunks these are, in order; None if two don't align."""
    total = begin = 0
    for left, right in zip(parts, parts[1:]):
        here = dict(zip(right[1], right[2]))
        match = next(((p, i) for p, i in zip(left[3], left[4]) if p in here), None)
        if match is None:
            return None
        total += match[1] - begin
        begin = here[match[0]]
    return total + parts[-1][0] - begin


def cuts(n: int, step: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text of n characters."""
    starts = range(0, max(1, n - overlap), step)
    return [(s, min(n, s + step + overlap)) for s in starts]


def count_widening(path: str, text: str, step: int, overlap: int) -> int:
    """Chunk by chunk, with overlaps doubled until the chunks align."""
    while len(text) > step + overlap:
        parts = [boundaries(path, text[a:b], a, overlap) for a, b in cuts(len(text), step, overlap)]
        found = splice(parts)
        if found is not None:
            return found
        step, overlap = 2 * step, 2 * overlap
    return len(tokenizer(path).encode(text, add_special_tokens=False))


def _counter(path: str) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_batch(path, texts.tolist()), dtype="int64")

    return count


def token_counts(
    docs: DataFrame,
    path: str = "byte_bpe_50k.json",
    text: str = "text",
    id_column: str = "doc_id",
    step: int = STEP,
    overlap: int = OVERLAP,
    limit: int = 1024,
) -> DataFrame:
    """``id_column``, n_bytes, n_tokens and over_limit of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows and rows
    without id each give a row. Other columns are not read.
    """
    if not GUARD < overlap <= step:
        raise ValueError(f"an overlap above {GUARD} and up to the step is needed")
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = F.length("text") <= step + overlap
    short = rows.filter(whole).select("id", size, _counter(path)("text").alias("n_tokens"))
    huge = rows.filter(~whole).withColumn("key", F.sha2("text", 256))
    counted = _huge_counts(huge.select("key", "text"), path, step, overlap)
    long = huge.select("id", size, "key").join(counted, "key").select("id", "n_bytes", "n_tokens")
    return short.unionByName(long).select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _huge_counts(huge: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """key and n_tokens of each distinct text; its chunks are encoded in different tasks."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"]):
                spans = cuts(len(text), step, overlap)
                for at in range(0, len(spans), _BATCH):
                    some = spans[at : at + _BATCH]
                    yield pd.DataFrame(
                        {"key": key, "start": [a for a, _ in some], "chunk": [text[a:b] for a, b in some]}
                    )

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [boundaries(path, c, int(s), overlap) for c, s in zip(frame["chunk"], frame["start"])]
            yield pd.DataFrame(
                {"key": frame["key"], "start": frame["start"]}
                | {n: [m[k] for m in made] for k, n in enumerate(("n", "head", "head_i", "tail", "tail_i"))}
            )

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("start").sort_values("start")
        parts = list(frame[["n", "head", "head_i", "tail", "tail_i"]].itertuples(index=False, name=None))
        found = splice(parts)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "spliced": pd.array([found], dtype="Int64")})

    def widen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [count_widening(path, t, 2 * step, 2 * overlap) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "n_tokens": counts})

    spliced = (
        huge.mapInPandas(cut, "key string, start long, chunk string")
        .repartition("key", "start")
        .mapInPandas(
            encode,
            "key string, start long, n long, head array<long>, head_i array<long>, tail array<long>, tail_i array<long>",
        )
        .groupBy("key")
        .applyInPandas(join, "key string, spliced long")
    )
    failed = spliced.filter("spliced is null").select("key")
    again = (
        huge.join(failed, "key", "left_semi").dropDuplicates(["key"]).mapInPandas(widen, "key string, n_tokens long")
    )
    return spliced.filter("spliced is not null").select("key", F.col("spliced").alias("n_tokens")).unionByName(again)
