"""MinHash near-duplicates with DartMinHash.

A text is a weighted set: its distinct runs of five words, each with a weight. A
weighted element owns the region from 0 to its weight. Darts fall on the plane of
weight and rank at rate one, at places that hashes of the element alone decide;
a dart inside an element's region counts. Each dart also has a coordinate, and a
signature keeps, per coordinate, the dart of the lowest rank. Two texts agree on
a coordinate with the chance of their weighted Jaccard similarity. Only darts
below a rank at which all coordinates are likely to be met are thrown; should one
stay empty, the rank is doubled. So the work is one hash an element and a fixed
number of darts a text, however long it is.

Signatures are cut into bands; texts that share a band are candidates, and the
similarity of candidates is computed in full. In a bucket, all texts are compared
with its least one only. Texts unlike it are taken on in a bucket of their own.
A text unlike it may still be like one that was like it, but only within what the
triangle inequality of the Jaccard distance allows; those pairs are compared too.
So no like pair of a bucket is lost, and no bucket emits all of its pairs. What is
left of a bucket after some rounds is finished within a task, once it is small.
Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import CACHE_WORDS, free_name
from rarebird.sources.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 5 miss a pair of similarity 0.8 once in 300,000.
BANDS = 32
#: The largest buckets that a task finishes.
SMALL_BUCKET = 2_048
SMALL_PIECES = 1_000_000
#: Rows of small tables that a task holds.
TASK_ROWS = 200_000
ROWS = 5
#: Bytes of texts that are taken apart together, about, and darts that are thrown together.
BLOCK_BYTES = 1 << 18
DARTS = 1 << 14
#: Bytes of the longest words that are hashed by running sums.
LONG_WORD = 64
#: Found in every text with a word.
HAS_WORDS = r"[^\x20\x09-\x0D]"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_DART = np.uint64(0xC2B2AE3D27D4EB4F)
_ACROSS = np.uint64(0xD6E8FEB86659FD93)
_COORDINATE = np.uint64(0xA0761D6478BD642F)
_BASE = 0x9FB21C651E98DF25


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mix (the finisher of splitmix64)."""
    shifted = x >> np.uint64(30)
    out = x ^ shifted
    out *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(out, np.uint64(27), out=shifted)
    out ^= shifted
    out *= np.uint64(0x94D049BB133111EB)
    np.right_shift(out, np.uint64(31), out=shifted)
    out ^= shifted
    return out


#: A random value for each byte, and which bytes are part of words.
_VALUES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD))
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


class _WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, alike in all processes."""
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts, one behind the other, and where each begins; the last entry is where all end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(texts: pa.Array, size: int = 0) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes, in order; a longer text is one by itself."""
    _, bounds = _flat(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(bounds, bounds[start] + (size or BLOCK_BYTES), "right")) - 1
        end = max(end, start + 1)
        yield texts.slice(start, end - start)
        start = end


def _spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of flat texts begin and end; no word reaches across a bound."""
    solid = _SOLID[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at some places of a text's bytes, alike wherever a word stands.

    A polynomial of random byte values modulo 2**64: differences of running sums, brought
    to the power of place 0. Long words, where such polynomials have weak spots, are hashed each.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    sizes = ends - starts
    h = mixed(mixed(h + sizes.astype(np.uint64) * _GOLD))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


_known_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least; those of a block of usual size are kept."""
    if len(_known_powers[0]) >= n:
        return _known_powers
    wanted = max(n, 2 * BLOCK_BYTES)
    found = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(wanted, base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * BLOCK_BYTES:
        _known_powers[:] = found
    return found


def flat_elements(texts: pa.Array, weighting: str = "set", shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and weights of all texts' runs of words, text by text, by ascending id; and how many each text has.

    A text of fewer words is one run; a text without words has none. Weights are
    1 under "set" and the number of occurrences under "count".
    """
    raw, bounds = _flat(texts)
    starts, ends = _spans(raw, bounds)
    h = span_hashes(raw, starts, ends)
    word_at = np.searchsorted(starts, bounds)  # the first word of each text
    n_words = np.diff(word_at)
    n_runs = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    run_at = np.concatenate([[0], np.cumsum(n_runs)])
    # The first words of all runs, and the words of each.
    firsts = np.arange(run_at[-1]) + np.repeat(word_at[:-1] - run_at[:-1], n_runs)
    ids = np.zeros(run_at[-1], np.uint64)
    short = np.repeat(n_words, n_runs) < shingle
    some_short = bool(short.any())
    for k in range(shingle):
        if not some_short:
            ids = mixed(ids * np.uint64(3) + h[firsts + k] + _GOLD)
        else:
            has = ~short | (k < np.repeat(n_words, n_runs))
            ids[has] = mixed(ids[has] * np.uint64(3) + h[firsts[has] + k] + _GOLD)
    for a, b in zip(run_at[:-1].tolist(), run_at[1:].tolist()):
        ids[a:b].sort()
    if not len(ids):
        return ids, np.empty(0), n_runs
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[run_at[:-1][n_runs > 0]] = True
    places = np.flatnonzero(new)
    sizes = np.diff(np.searchsorted(places, run_at))
    counts = np.diff(places, append=len(ids))
    return ids[places], (np.ones(len(places)) if weighting == "set" else counts.astype(float)), sizes


def signature(ids: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Per coordinate, the dart of the lowest rank in the regions of the weighted elements."""
    return signatures(ids, weights, np.array([len(ids)]), k)[0]


def signatures(ids: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The signature of each of several sets of weighted elements, none of them empty; a row each.

    The sets' elements lie one behind the other, ``sizes`` of each.
    """
    weights = np.asarray(weights, float)
    of = np.repeat(np.arange(len(sizes)), sizes)
    strips = np.ceil(weights).astype(np.int64)
    # A region is cut into strips of weight one, each with a stream of darts of its own.
    nth = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    seeds = mixed(np.repeat(ids, strips) + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
    room, of_strip = np.repeat(weights, strips) - nth, np.repeat(of, strips)
    limits = (k * np.log(k) + 2 * k) / np.bincount(of, weights, minlength=len(sizes))
    out = np.zeros(len(sizes) * k, np.uint64)
    while len(seeds):
        lowest = np.full(len(out), np.inf)
        at, ranks, darts = _thrown(seeds, room, of_strip, limits, k)
        np.minimum.at(lowest, at, ranks)
        wins = ranks == lowest[at]
        out[at[wins]] = darts[wins]
        # Sets that missed a coordinate throw again, twice as far.
        missed = np.isinf(lowest).reshape(-1, k).any(axis=1) & (np.bincount(of_strip, minlength=len(sizes)) > 0)
        limits = np.where(missed, 2 * limits, limits)
        again = missed[of_strip]
        seeds, room, of_strip = seeds[again], room[again], of_strip[again]
    return out.reshape(-1, k)


def _thrown(
    seeds: np.ndarray, room: np.ndarray, of: np.ndarray, limits: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (set times k, and coordinate), rank and number of all darts that count below the sets' limits."""
    # Strips of sets of about one limit throw side by side, so many darts at a time.
    some = 2 ** np.floor(np.log2(np.maximum(limits, 1.0))).astype(np.int64)
    whole = bool((room >= 1).all())
    found: list[tuple] = []
    for n in np.unique(some[of]).tolist():
        alike = some[of] == n
        state, thrown = (seeds[alike], room[alike], of[alike], np.zeros(int(alike.sum()))), 0
        while len(state[0]):
            # The next darts of each strip; gaps between their ranks are exponential.
            numbers = np.arange(thrown + 1, thrown + n + 1, dtype=np.uint64)[:, None] * _DART
            left_over, width = [], max(1, DARTS // n)
            for begin in range(0, len(state[0]), width):
                seed, left, owner, last = (x[begin : begin + width] for x in state)
                dart = mixed(seed + numbers)
                rank = (dart >> np.uint64(11)).astype(float)
                rank *= 2.0**-53
                rank += 2.0**-54
                np.log(rank, out=rank)
                np.negative(rank, out=rank)
                # Summed one after the other, so that a dart has one rank however many are thrown at a time.
                rank[0] += last
                for i in range(1, n):
                    rank[i] += rank[i - 1]
                limit = limits[owner]
                counts = rank < limit
                if not whole:
                    counts &= (mixed(dart ^ _ACROSS) >> np.uint64(11)).astype(float) * 2.0**-53 < left
                which = np.flatnonzero(counts)
                landed = dart.ravel()[which]
                at = (mixed(landed ^ _COORDINATE) % np.uint64(k)).astype(np.int64)
                at += np.tile(owner * k, n)[which]
                found.append((at, rank.ravel()[which], landed))
                more = np.flatnonzero(rank[-1] < limit)
                left_over.append((seed[more], left[more], owner[more], rank[-1][more]))
            state, thrown = tuple(map(np.concatenate, zip(*left_over))), thrown + n
    return tuple(map(np.concatenate, zip(*found)))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, different bands having different keys."""
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    parts = sig.reshape(-1, bands, rows)
    keys = np.repeat(keys[None, :], len(parts), axis=0)
    for r in range(rows):
        keys = mixed(keys * np.uint64(3) + parts[:, :, r] + _GOLD)
    return keys.view(np.int64)


def _lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """Arrays of longs, the sizes of which are given, from their values one behind the other."""
    bounds = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _bands(weighting: str, bands: int, rows: int, shingle: int) -> Column:
    @F.arrow_udf("array<long>")
    def keys(texts: pa.Array) -> pa.Array:
        values, sizes = [], []
        for several in blocks(texts, 4 * BLOCK_BYTES):
            parts = [flat_elements(block, weighting, shingle) for block in blocks(several)]
            ids, weights, each = map(np.concatenate, zip(*parts))
            some = each > 0
            values.append(band_keys(signatures(ids, weights, each[some], bands * rows), bands, rows).ravel())
            sizes.append(np.where(some, bands, 0))
        return _lists(values, sizes)

    return keys


def _pieces(weighting: str, shingle: int) -> Column:
    """The weighted set as a plain set: an id for each unit of weight."""

    @F.arrow_udf("array<long>")
    def pieces(texts: pa.Array) -> pa.Array:
        values, sizes = [], []
        for block in blocks(texts):
            ids, weights, each = flat_elements(block, weighting, shingle)
            strips = weights.astype(np.int64)
            nth = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
            values.append(mixed(np.repeat(ids, strips) + nth.astype(np.uint64) * _GOLD).view(np.int64))
            of = np.repeat(np.arange(len(each)), each)
            sizes.append(np.bincount(of, strips, minlength=len(each)).astype(np.int64))
        return _lists(values, sizes)

    return pieces


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with the Jaccard similarity of their sets, staged."""
    one = sets.select(F.col("id").alias("a"), F.col("pieces").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("pieces").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    return stage(
        both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")), "similarities"
    )


def link_bucket(
    ids: list[int], sets: list[np.ndarray], classes: list[int], least: float, known: Sequence[float] | None = None
) -> list[tuple[int, int]]:
    """Links that join all texts of a small bucket that a chain of like pairs of it joins.

    Texts of one of the ``classes`` are joined already. The bucket's texts are
    compared with the least one; those unlike it are compared with the ones like
    it, as far as the triangle inequality asks for, until a link joins them; then
    the same is done with those unlike it. ``known`` has the texts' distances from one that
    all have been compared with, and that is not among them: they go on from there.
    """
    far, found = 1.0 - least, []
    parent = {c: c for c in classes}
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    in_one = np.zeros(len(distinct), np.int32)

    def root(i: int) -> int:
        c = classes[i]
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    def distances(i: int) -> np.ndarray:
        """From one text to each, by marking its pieces among those of all."""
        mine = codes[ends[i] - sizes[i] : ends[i]]
        in_one[mine] = 1
        marked = np.concatenate([[0], np.cumsum(in_one[codes])])
        in_one[mine] = 0
        common = marked[ends] - marked[ends - sizes]
        return 1.0 - common / (sizes[i] + sizes - common)

    def link(i: int, j: int) -> None:
        if root(i) != root(j):
            found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            parent[root(i)] = root(j)

    def sides(some: list[int], d: np.ndarray) -> tuple[list[int], list[int]]:
        return [i for i in some if 1.0 - d[i] >= least], [i for i in some if 1.0 - d[i] < least]

    def across(unlike: list[int], like: list[int], d: np.ndarray) -> None:
        """Those like one text are of one class, so one link to any of them will do."""
        if not like:
            return
        like = np.array(like)
        for x in unlike:
            if d[x] <= 2 * far + 1e-9 and root(x) != root(like[0]):
                enough = like[d[x] - d[like] <= far + 1e-9]
                if len(enough):
                    enough = enough[1.0 - distances(x)[enough] >= least]
                    if len(enough):
                        link(x, int(enough[0]))

    left = sorted(range(len(ids)), key=ids.__getitem__)
    if known is not None:
        d = np.asarray(known)
        like, left = sides(left, d)
        across(left, like, d)
    while len({root(i) for i in left}) > 1:
        first, *rest = left
        d = distances(first)
        like, left = sides(rest, d)
        for i in like:
            link(first, i)
        across(left, like, d)
    return found


def _finish(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within buckets, each compared in one task; ``members`` has bucket, id, root and similarity to the bucket's least."""

    def bucket_links(rows: pa.Table) -> list[tuple[int, int]]:
        ids, firsts = np.unique(rows["id"].to_numpy(), return_index=True)
        roots, known = rows["root"].to_numpy()[firsts], 1.0 - rows["similarity"].to_numpy()[firsts]
        sets = [rows["pieces"][i].values.to_numpy() for i in firsts.tolist()]
        return link_bucket(ids.tolist(), sets, roots.tolist(), least, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets lie one behind the other; the last one of a batch may go on in the next.
        open_ = None
        for batch in chain(batches, [None]):
            if batch is not None:
                batch = pa.Table.from_batches([batch])
                rows = batch if open_ is None else pa.concat_tables([open_, batch])
            elif open_ is None:
                return
            else:
                rows = open_
            buckets = rows["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist()]
            cuts += [len(buckets)] if batch is None else []
            found = [pair for a, b in zip(cuts, cuts[1:]) for pair in bucket_links(rows.slice(a, b - a))]
            open_ = rows.slice(cuts[-1])
            columns = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

    rows = members.select("bucket", "id", "root", "similarity").join(sets, "id").select("bucket", "id", "root", "similarity", "pieces")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _fitted(df: DataFrame, rows: int) -> DataFrame:
    """In as many partitions as ``rows``, a bound of its rows, call for."""
    return df.coalesce(max(8, rows // TASK_ROWS))


def links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """id and root, the least id of its class, of all ids that share a bucket with a like text.

    ``members`` has rows of bucket, id and n (the size of the id's set), staged.
    All texts are compared with the least one of each of their buckets, each pair
    once. Texts that links join already, in whichever bucket those were found,
    need no comparison. So a bucket is done if those unlike its least text are of one class, and
    none of them that is of another class than the least one is near enough for one like that.
    Of other buckets, those of up to ``SMALL_BUCKET`` texts and ``SMALL_PIECES`` pieces left to compare
    are finished within a task. Larger ones are compared across, and what is left of them has another round.
    """
    far, found, roots = 1.0 - least, None, None
    while True:
        rows = members.count()
        pairs = members.join(members.groupBy("bucket").agg(F.min("id").alias("a")), "bucket").filter("id <> a")
        pairs = pairs.select("bucket", "a", F.col("id").alias("b"), "n")
        compared = stage(
            _fitted(pairs.join(_similarities(pairs, sets), ["a", "b"]), rows).withColumn("d", 1.0 - F.col("similarity")),
            "bucket-compared",
        )
        like, unlike = compared.filter(F.col("similarity") >= least), compared.filter(F.col("similarity") < least)
        found = _linked(found, like.select("a", "b"), rows)
        roots = components(found)
        classed = (
            unlike.join(roots.select(F.col("id").alias("b"), F.col("root").alias("rx")), "b", "left")
            .join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left")
            .withColumns({"root": F.coalesce("rx", "b"), "first_root": F.coalesce("ra", "a")})
        )
        # d(x, y) >= d(a, x) - d(a, y): only this near can x and y be like each other.
        near = (F.col("root") != F.col("first_root")) & (F.col("d") <= 2 * far + 1e-9)
        left = stage(
            _fitted(classed.select("bucket", F.col("b").alias("id"), "root", "first_root", "similarity", "d", "n", near.alias("near")), rows),
            "bucket-unlike",
        )
        unlike_ones = left.groupBy("bucket").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min("first_root").alias("first_root"),
            F.min(F.when(F.col("near"), F.col("d"))).alias("nearest"), F.count("*").alias("texts"), F.sum("n").alias("all"),
        )
        # Only like ones this far from the least text can be like any that is unlike it.
        within = F.col("d") >= F.col("nearest") - far - 1e-9
        beside = like.join(unlike_ones.filter("nearest is not null").select("bucket", "nearest", "first_root"), "bucket").filter(within)
        beside = stage(
            _fitted(beside.select("bucket", F.col("b").alias("id"), F.col("first_root").alias("root"), "similarity", "d", "n"), rows),
            "bucket-like",
        )
        like_ones = beside.groupBy("bucket").agg(F.count("*").alias("like_texts"), F.sum("n").alias("like_all"))
        texts, pieces = (F.col(n) + F.coalesce(f"like_{n}", F.lit(0)) for n in ("texts", "all"))
        open_ = unlike_ones.join(like_ones, "bucket", "left").filter("low < high or like_texts > 0")
        open_ = open_.select("bucket", ((texts <= SMALL_BUCKET) & (pieces <= SMALL_PIECES)).alias("small"))
        open_ = stage(_fitted(open_, rows), "bucket-open")
        columns = ("bucket", "id", "root", "similarity")
        small = left.select(*columns).unionByName(beside.select(*columns)).join(open_.filter("small"), "bucket")
        small = _finish(small, sets, least)
        large = open_.filter("not small").select("bucket")
        if large.isEmpty():
            return components(_linked(found, small, rows))
        apart = left.filter("near").select("bucket", F.col("id").alias("x"), F.col("d").alias("dx")).join(large, "bucket")
        across = apart.join(beside.select("bucket", F.col("id").alias("y"), F.col("d").alias("dy")), "bucket").filter(
            F.col("dx") - F.col("dy") <= far + 1e-9
        )
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        across = _similarities(across, sets).filter(F.col("similarity") >= least).select("a", "b")
        found = _linked(found, small.unionByName(across), rows)
        members = stage(left.select("bucket", "id", "n").join(large, "bucket"), "bucket-left")


def _linked(found: DataFrame | None, more: DataFrame, rows: int) -> DataFrame:
    """All links so far; those from buckets of more rows than one fit the same partitions."""
    return stage(_fitted((more if found is None else found.unionByName(more)).distinct(), rows), "links")


def components(edges: DataFrame) -> DataFrame:
    """id and root, the least id of its component, for each id of the staged edges (a, b), a < b.

    Alternates two steps until components are stars: every id links its larger
    neighbours to its least one, then every id links its smaller neighbours to
    the least one. Edges never grow in number; tables are written between steps.
    """
    while True:
        rows = edges.count()
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.col("of")).alias("m"))
        large = (
            sides.filter("b > a")
            .join(least, F.col("a") == F.col("of"))
            .select(F.col("m").alias("a"), "b")
            .filter("a < b")
            .distinct()
        )
        edges = stage(_fitted(large, rows), "edges-large")
        least = edges.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("m"))
        joined = edges.join(least, F.col("b") == F.col("of"))
        small = joined.select(F.least("a", "m").alias("m"), F.col("a").alias("n")).filter("m < n")
        edges = stage(_fitted(small.union(least.select("m", "of")).toDF("a", "b").distinct(), rows), "edges-small")
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("b", F.lit(0), F.lit(1))
        )
        open_ = ends.groupBy("id").agg(F.max("up").alias("up"), F.sum("down").alias("down")).filter("down > 1 or up + down > 1")
        if _fitted(open_, rows).isEmpty():
            leaves = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
            return leaves.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def text_classes(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    similarity: float = SIMILARITY,
    weighting: str = "set",
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The rows as (id, content), and the class of each distinct text with words, both staged.

    ``content`` is the SHA-256 of the text, null for texts without words. A class has
    the least id of its texts, null if none of them has one (class_id), and a
    text that stands for it: the least by id, nulls last, then by content (shown).
    Texts are compared whatever ids their rows have.
    """
    some = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    with_words = some.filter(F.col("text").rlike(HAS_WORDS))
    contents = stage(some.select("id", _content("text").alias("content")), "contents")
    known = contents.filter("content is not null")
    # An id that one row alone bears finds that row's text without hashing texts again.
    alone = (
        known.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("content").alias("content")).filter("n = 1")
    )
    no_id = F.lit(None).cast(contents.schema["id"].dataType)
    firsts = (
        known.select("content", "id", no_id.alias("own"))
        .union(alone.select("content", no_id, "id"))
        .groupBy("content")
        .agg(F.min("id").alias("first"), F.min("own").alias("own"))
    )
    # The numbers are those of the table as written, whatever task wrote a part of it.
    firsts = stage(firsts.withColumn("key", F.monotonically_increasing_id()), "firsts")
    by_id = with_words.join(firsts.filter("own is not null").select(F.col("own").alias("id"), "key"), "id").select("key", "text")
    # In a table of its own, so that its size is known: texts need not move for the sake of few others, or none.
    others = stage(firsts.filter("own is null").select("content", "key"), "texts-of-no-id")
    by_content = with_words.withColumn("content", _content("text")).join(others, "content").select("key", "text")
    single = by_id.unionByName(by_content.dropDuplicates(["key"])).withColumnRenamed("key", "id")
    keys = single.select("id", F.explode(_bands(weighting, bands, rows, shingle)("text")).alias("bucket"))
    keys = stage(keys, "band-keys")
    shared = keys.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last")
    members = stage(keys.join(shared.select("bucket"), "bucket", "left_semi"), "band-members")
    sets = stage(
        single.join(members.select("id").distinct(), "id", "left_semi").select(
            "id", _pieces(weighting, shingle)("text").alias("pieces")
        ),
        "shingle-sets",
    )
    roots = links(members.join(sets.select("id", F.size("pieces").alias("n")), "id"), sets, similarity)
    linked = firsts.join(roots.withColumnRenamed("id", "key"), "key").select("content", "first", "root")
    # Ids that are missing come behind all others.
    heads = linked.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "content")).alias("head"))
    joined = linked.join(heads, "root").select("content", F.col("head.first").alias("class_id"), F.col("head.content").alias("shown"))
    lonely = firsts.join(linked.select("content"), "content", "left_anti")
    lonely = lonely.select("content", F.col("first").alias("class_id"), F.col("content").alias("shown"))
    return contents, stage(joined.unionByName(lonely), "text-classes")


def _content(column: str) -> Column:
    """32 bytes that tell texts with words apart; null for others."""
    return F.when(F.col(column).rlike(HAS_WORDS), F.unhex(F.sha2(F.col(column), 256)))


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """Per row: the id and class_id, the least id among all texts that links join.

    Equal texts are one class. Texts of fewer words than a run are compared as
    a whole; null texts and texts without words are alike to nothing, so the class of
    such a row is its own id. Rows without id have the class of their text, null
    if no text of the class has an id. Rows that share an id but not a text have the
    classes of their texts. An empty table has no rows. ``settings`` as in ``text_classes``.
    """
    contents, classes = text_classes(docs, text, id_column, **settings)
    mapped = contents.join(classes, "content", "left")
    # Where the content is null there is no class to look up.
    own = F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return mapped.select(F.col("id").alias(id_column), own.alias("class_id"))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """One row of each class, unchanged: that of the least id, or of the least content hash where none has an id.

    Of repeated rows with that id and text, one stays; rows that share an id but are of
    different classes all may. Null texts and texts without words are no copies of
    each other: one row of each such id and text stays, and all of those without id.
    """
    _, classes = text_classes(docs, text, id_column, **settings)
    content, its_id, its_content = (free_name(docs, name) for name in ("text_hash", "class_id", "class_text"))
    shown = classes.filter("content = shown").select(F.col("class_id").alias(its_id), F.col("content").alias(its_content))
    mine = F.col(id_column).eqNullSafe(F.col(its_id)) & (F.col(content) == F.col(its_content))
    known = docs.withColumn(content, _content(text)).join(shown, mine, "left_semi")
    known = known.dropDuplicates([id_column, content]).drop(content)
    wordless = docs.filter(F.coalesce(~F.col(text).rlike(HAS_WORDS), F.lit(True)))
    some_id = F.col(id_column).isNotNull()
    return known.unionByName(wordless.filter(some_id).dropDuplicates([id_column, text])).unionByName(wordless.filter(~some_id))
