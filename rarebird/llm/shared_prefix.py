"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Spaces become marks; the marked text is cut into marked words, across which no
piece of the model reaches. The distinct marked words of a block of texts are
sorted, which is the order in which their trie is walked depth-first: going from
one word to the next, the forward states of the common prefix stay on the stack
and only those beyond are computed.

A forward state is the best segmentation of a prefix: its last piece and the state
before that. Under a unigram model it is the one of the largest sum of scores.
Under a BPE model the score of a path is 0 if every two neighbouring pieces are
compatible, that is, merging their joined text by the model's ranks gives these two
pieces again, and minus infinity otherwise. Each prefix has exactly one path of
score 0, and that of the whole word is what merging gives, so ids equal the
library's. The public model is of this kind.

Characters that no piece covers become the ids of their bytes. Decoding joins
pieces and bytes and turns marks to spaces.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarebird.llm.common import free_name, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Characters of the texts whose words are walked together, about, and words whose
#: ids, and pairs of pieces whose verdicts, a worker remembers.
BLOCK_CHARS = 2_000_000
REMEMBERED = 200_000
PAIRS_REMEMBERED = 300_000
#: The score of a character that no piece covers, under a unigram model.
UNKNOWN = -1e6
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """A vocabulary: ids and scores of its pieces, ids of bytes, and the search."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], unigram: bool = False):
        self.scores, self.byte_ids, self.unigram = scores, byte_ids, unigram
        # Gives the pieces that end at each character of a word, the longest first.
        self.endings = ahocorasick.Automaton()
        for piece, (number, score) in scores.items():
            self.endings.add_word(piece, (len(piece), number, score, piece))
        self.endings.make_automaton()
        self.pairs: dict[int | tuple, bool] = {}
        # No piece may go on after a mark that follows another character.
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece of this model reaches across marked words")

    def merged(self, text: str) -> list[str]:
        """What merging neighbours by rank, the best pair first, makes of a text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found is not None and found[1] > best:
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str, key) -> bool:
        """Whether merging the joined text gives the two pieces; on the left may be nothing."""
        if len(self.pairs) >= PAIRS_REMEMBERED:
            self.pairs.clear()
        verdict = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return verdict

    # A state is (last piece, state before, score, the piece's id or a character without one).
    def advance(self, word: str, start: int, states: list[tuple]) -> None:
        """Appends the forward states of word[:start + 1], ..., word."""
        if self.unigram:
            return self.advance_by_sums(word, start, states)
        pairs = self.pairs
        done = start
        for last, (n, number, _, piece) in self.endings.iter(word):
            if last < done:  # the state is known, or a longer piece has been taken
                continue
            while last > done:
                self.stand_alone(word[done], states)
                done += 1
            before = states[last + 1 - n]
            left = before[3]
            key = left << 20 | number if left.__class__ is int else (left, number)
            verdict = pairs.get(key)
            if verdict or (verdict is None and self.compatible(before[0], piece, key)):
                states.append((piece, before, 0.0, number))
                done += 1
        for character in word[done:]:
            self.stand_alone(character, states)

    def advance_by_sums(self, word: str, start: int, states: list[tuple]) -> None:
        """The same by sums of scores."""
        best: dict[int, tuple] = {}
        for last, (n, number, score, piece) in self.endings.iter(word):
            if last < start:
                continue
            while start + len(best) < last:
                best[start + len(best)] = ()
            for done in range(len(states) - 1, last):
                states.append(best[done]) if best[done] else self.stand_alone(word[done], states)
            before = states[last + 1 - n]
            if not best.get(last) or before[2] + score > best[last][2]:
                best[last] = (piece, before, before[2] + score, number)
        for done in range(len(states) - 1, len(word)):
            states.append(best[done]) if best.get(done) else self.stand_alone(word[done], states)

    def stand_alone(self, character: str, states: list[tuple]) -> None:
        """Appends the state behind a character that no piece ends with."""
        before = states[-1]
        states.append((character, before, before[2] + UNKNOWN if self.unigram else 0.0, character))

    def ids(self, state: tuple) -> list[int]:
        """Ids along the path to a state."""
        out: list[int] = []
        while state[0]:
            found = self.scores.get(state[0])
            if found is not None:
                out.append(found[0])
            else:
                out += [self.byte_ids[b] for b in reversed(state[0].encode("utf-8", "surrogatepass"))]
            state = state[1]
        out.reverse()
        return out

    def walk(self, sorted_words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Words, given in sorted order, and their ids: the trie's words, depth-first."""
        states: list[tuple] = [("", None, 0.0, _NOTHING)]
        previous = ""
        for word in sorted_words:
            shared = 0
            for one, other in zip(previous, word):
                if one != other:
                    break
                shared += 1
            del states[shared + 1 :]
            self.advance(word, shared, states)
            yield word, self.ids(states[-1])
            previous = word


#: Stands for a piece's id before the first piece.
_NOTHING = 1 << 19
_loaded: dict = {}


class Remembered:
    """Ids of words met: those met lately and, once these are too many, those before, which are then let go."""

    def __init__(self):
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def keep(self, words: set[str]) -> list[str]:
        """Brings the known ones of some words to those met lately; returns the others."""
        if len(self.lately) >= REMEMBERED // 2:
            self.lately, self.before = {}, self.lately
        new = []
        for word in words:
            if word not in self.lately:
                ids = self.before.get(word)
                if ids is None:
                    new.append(word)
                else:
                    self.lately[word] = ids
        return new

    def clear(self) -> None:
        self.lately, self.before = {}, {}


def load(path: str) -> tuple[Pieces, list[bytes], Remembered]:
    """The vocabulary, what each id decodes to, and ids of words met; once a worker."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        scores: dict[str, tuple[int, float]] = {}
        byte_ids, spelled = [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                scores[piece] = (i, sp.get_score(i))
                spelled.append(piece.replace(MARK, " ").encode())
        # The scores of a BPE model are its ranks, negated; those of others are logarithms.
        if any(score != int(score) for _, score in scores.values()):
            raise ValueError(f"{path} is not a BPE model")
        _loaded[path] = (Pieces(scores, byte_ids), spelled, Remembered())
    return _loaded[path]


def marked_words(text: str | None) -> list[str]:
    """A text's marked words; none for null and empty texts."""
    return _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_blocks(texts: list[str | None], path: str = MODEL) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Start, end and the ids of each text, of blocks of texts in order."""
    pieces, _, known = load(path)
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars < BLOCK_CHARS):
            chars += len(texts[end] or "")
            end += 1
        found = [marked_words(t) for t in texts[start:end]]
        for word, ids in pieces.walk(sorted(known.keep(set(chain.from_iterable(found))))):
            known.lately[word] = array("i", ids).tobytes()
        yield start, end, [np.frombuffer(b"".join(map(known.lately.__getitem__, some)), dtype=np.int32) for some in found]
        start = end


def encode_block(texts: list[str | None], path: str = MODEL) -> list[np.ndarray]:
    """Ids of each text."""
    return [ids for _, _, some in encode_blocks(texts, path) for ids in some]


def decode_block(ids: list, path: str = MODEL) -> list[str]:
    """The text of each row of ids; ids that a model does not have are an error."""
    _, spelled, _ = load(path)
    out = []
    for some in ids:
        raw = b"".join([spelled[i] for i in some]) if some is not None else b""
        text = raw.decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def encode(docs: DataFrame, text: str = "text", into: str = "token_ids", path: str = MODEL) -> DataFrame:
    """All rows and columns, and ``into``, an array of ids, which replaces a column so named.

    Null and empty texts have no ids. Rows are encoded each, repeated or not.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_block(texts.tolist(), path), dtype=object)

    return docs.withColumn(into, ids(F.col(text).cast("string")))


def decode(rows: DataFrame, ids: str = "token_ids", into: str = "text", path: str = MODEL) -> DataFrame:
    """All rows and columns, and ``into``, the text of the ids; null ids give an empty text.

    Decoding gives back an encoded text, but for marks in it, which become spaces.
    """

    @F.pandas_udf("string")
    def texts(some: pd.Series) -> pd.Series:
        return pd.Series(decode_block(some.tolist(), path), dtype=object)

    return rows.withColumn(into, texts(ids))


def encoded_documents(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source"), path: str = MODEL
) -> DataFrame:
    """Columns ``keep``, n_tokens and token_ids of every row."""
    whole = free_name(docs, "whole_text")
    rows = docs.select(*keep, F.col(text).cast("string").alias(whole))
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids leave a block at a time: those of a whole batch would take several times its texts.
        for batch in batches:
            for start, end, ids in encode_blocks(batch.column(len(keep)).to_pylist(), path):
                some = batch.slice(start, end - start)
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *made], schema.names)
        load(path)[2].clear()  # the worker goes on to other work

    return rows.mapInArrow(run, schema)


def encoded_report(docs: DataFrame, text: str = "text", id_column: str = "doc_id", path: str = MODEL) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (of the ids as text, comma-joined) and round_trip.

    ``round_trip`` tells whether decoding gives the text again (a null text: the empty one).
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, round_trip boolean")
    def report(texts: pd.Series) -> pd.DataFrame:
        values, out = texts.tolist(), []
        for start, end, encoded in encode_blocks(values, path):
            for value, ids, text in zip(values[start:end], encoded, decode_block(encoded, path)):
                digest = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
                out.append((len(ids), digest, text == (value or "")))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(id_column), report(F.col(text).cast("string")).alias("r"))
    return rows.select(id_column, "r.*")
