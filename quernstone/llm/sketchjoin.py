"""Near-duplicate join by parity sketches.

A record is the set of its distinct runs of ``run`` words, each a 32-bit hash.
XOR-hashing a set into a bit sketch toggles one bit per element, so the Hamming
distance of two sketches never exceeds the size of the sets' symmetric difference.
Two records with Jaccard similarity ``t`` or more have sizes within a factor
``1/t`` and a symmetric difference of at most ``(1-t)/(1+t) * (|A|+|B|)``.

The sketch has one bit for each 32-bit hash, so it is kept as the elements
themselves. Two things are made of it:

- *Segments.* A size band (half an octave of set sizes) cuts the sketch into as many
  segments as differences must not exceed for one to stay untouched (pigeonhole),
  or fewer, so that a segment of a band's record holds ``PER_SEGMENT`` bits or more.
  Segments with ``MIN_IN_SEGMENT`` bits are join keys. A record emits those of its
  own band and of all bands up to ``1/t`` times its size, so any two records that can
  reach the threshold meet in at least one band. Bands of few segments are cut up to
  ``MOST_CUTS`` times.
- *The folded sketch*: all bits folded onto ``SKETCH_BITS`` by XOR. Its distance is
  still a lower bound of the difference and discards candidates before the exact
  check of their elements.

Between the two, 128 one-bit minima of each set travel with its keys: a pair whose
minima agree less than three standard deviations below what the threshold lets expect
is not spelled out. That drops one pair in about 700 that lies at the very threshold,
fewer above it, and saves most pairs that agree on a segment by chance.

Equal element sets are collapsed before any of this. Keys under which more than
``MOST_OF_KEY`` classes meet are not spelled out as pairs: their classes are compared
in blocks, sketch against sketch, and only pairs within the bound come out.

Records of few elements are joined exactly at any threshold, by prefixes in hash
order; their pairs are not judged by minima. Beyond that the segments are larger than the pigeonhole asks for; recall is
measured in the README. All candidates come from keys, none through other links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scratch import Scratch
from quernstone.operators.skew import hot_aware_join

#: Bits of a record that a segment holds on average, at a band's lower end.
PER_SEGMENT = 3
#: Bits a segment must hold to be a key: smaller ones agree by chance.
MIN_IN_SEGMENT = 4
#: Bands per octave of set sizes.
PER_OCTAVE = 2
#: A band is cut again, by other hashes, until it has so many segments or MOST_CUTS cuts.
ENOUGH_SEGMENTS, MOST_CUTS = 120, 5
#: Rounds in which the bands are joined, to bound the disk that keys take.
ROUNDS = 4
#: One-bit minima of a set, in words of 64.
MINIMA_WORDS = 2
#: Standard deviations below the expected agreement of minima at which a pair is given up.
DEVIATIONS = 3
#: Rows of at most so many elements are joined exactly.
SMALL = 32
#: Bits of the full sketch.
SKETCH_BITS = 512
#: Names of candidates' classes at most (8 bytes each) that are broadcast to the elements.
MOST_ENDS = 1_000_000
#: Classes under one key that are paired by the join itself; larger groups are compared in blocks of half as many.
MOST_OF_KEY = 2_000
#: Keys that a task pairs at once, 16 bytes each.
KEYS_OF_TASK = 4_000_000
#: Pairs made at once.
PAIRS_AT_ONCE = 4_000_000
#: Hot keys are told by one in so many classes. At most MOST_ENDS hot keys are broadcast.
ONE_IN = 64
#: Words remembered with their hash, per Python worker.
MEMO = 500_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: The same for ASCII texts: all but letters and digits becomes a space.
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_M1, _M2, _M3, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """The words of a text, in lower case, as bytes."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


class _Words:
    """Hashes of words, remembered while the vocabulary fits."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> list[int]:
        seen = self.seen
        try:
            return [seen[w] for w in words]
        except KeyError:
            pass
        if len(seen) > MEMO:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        return [seen[w] for w in words]


def element_sets(texts: list[str], run: int, min_words: int, hashes: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts with at least ``min_words`` words: (their positions, each element's row among them, the element).

    Elements are 32-bit hashes, distinct per row and sorted by (row, element).
    """
    kept: list[int] = []
    flat: list[int] = []
    sizes: list[int] = []
    for i, text in enumerate(texts):
        words = words_of(text)
        if len(words) >= max(min_words, run):
            kept.append(i)
            sizes.append(len(words))
            flat += hashes(words)
    h = np.array(flat, dtype=np.uint64)
    n = len(h)
    if not n:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    m = n - run + 1
    x = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            x = x * _M1 + h[k : k + m] * (_M2 + np.uint64(2 * k))
        x = _mix(x)
    inside = row[:m] == row[run - 1 :]
    # Row and element in one number, which sorts faster than two columns.
    both = np.sort((row[:m][inside].astype(np.uint64) << np.uint64(32)) | (x[inside] >> np.uint64(32)))
    row, x = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
    first = np.ones(len(x), dtype=bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return np.array(kept), row[first], x[first]


_EVEN = ~np.uint64(1)


def segments_of(band: np.ndarray) -> np.ndarray:
    """Number of segments of a band."""
    return np.maximum(2, np.floor(np.exp2(band / PER_OCTAVE) / PER_SEGMENT)).astype(np.int64)


def block_keys(row: np.ndarray, x: np.ndarray, size: np.ndarray, threshold: float = 0.5, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the segments of all bands that a row takes part in, and for the prefix of every small row.

    Of ``parts`` parts only the bands, and the small rows, of ``part`` are made.
    """
    own = np.floor(np.log2(np.maximum(size, 2)) * PER_OCTAVE + 1e-9).astype(np.int64)
    # Bands up to that of the largest set that can reach the threshold.
    last = np.floor(np.log2(np.maximum(size, 2) / threshold) * PER_OCTAVE + 1e-9).astype(np.int64)
    rows, keys = [], []
    with np.errstate(over="ignore"):
        bits = _mix(x)
        for up in range(int((last - own).max(initial=0)) + 1):
            band = own + up
            segments = segments_of(band)
            cuts = np.clip(-(-ENOUGH_SEGMENTS // segments), 1, MOST_CUTS)
            for cut in range(int(cuts.max(initial=0))):
                takes = np.flatnonzero((band <= last) & (cut < cuts) & (band % parts == part))
                if not len(takes):
                    continue
                mine = slice(None) if len(takes) == len(size) else np.repeat(np.isin(np.arange(len(size)), takes), size)
                v, n, width = bits[mine], size[takes], segments[takes]
                salt = _mix(band[takes].astype(np.uint64) * _M3 + np.uint64(cut) * _M2)
                # Every row has its segments side by side in one array.
                base = np.r_[0, np.cumsum(width)]
                place = ((((v ^ np.repeat(salt, n)) * _MIX) >> np.uint64(32)) * np.repeat(width.astype(np.uint64), n) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], n)
                count = np.bincount(place, minlength=base[-1])
                # The bits that stand in a segment, hashed to one number; every element sets a bit of its own.
                content = np.zeros(base[-1], dtype=np.uint64)
                np.add.at(content, place, v)
                kept = np.flatnonzero(count >= MIN_IN_SEGMENT)
                at = np.searchsorted(base, kept, side="right") - 1
                rows.append(takes[at])
                keys.append(_EVEN & _mix(content[kept] + (kept - base[at]).astype(np.uint64) * _M1 + salt[at] + count[kept].astype(np.uint64) * _M3))
    if part == 0:
        small_rows, small_keys = prefix_keys(row, x, size, threshold)
        # Odd keys are those of the exact join of small rows, which no estimate may prune.
        rows.append(small_rows)
        keys.append(small_keys | np.uint64(1))
    if not rows:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def prefix_keys(row: np.ndarray, x: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that two rows of the threshold, one of at most SMALL elements, always share a key.

    Such rows share ``ceil(threshold * n)`` elements of n, so, in any common order, one
    among the first ``n - ceil(threshold * n) + 1`` and two among one more. Above 0.5
    different sets share two elements at least, and the key is a pair.
    """
    pair = threshold > 0.5
    rows, keys = [], []
    ends = np.r_[0, np.cumsum(size)]
    for i in np.flatnonzero(size * threshold <= SMALL + 1e-9):
        n = int(size[i])
        first = np.sort(_mix(x[ends[i] : ends[i + 1]] ^ _M2))[: min(n, n - int(np.ceil(threshold * n - 1e-9)) + 1 + pair)]
        if pair:
            a, b = np.triu_indices(len(first), 1)
            first = first[a] * _M1 + first[b]
        rows.append(np.full(len(first), i))
        keys.append(_mix(first ^ _M3))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.array([], dtype=np.int64), np.array([], dtype=np.uint64))


def parity_sketch(row: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    """SKETCH_BITS bits per row as int64 words: bit i is the parity of the elements hashed to i."""
    bit = (_mix(x ^ _M3) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(row * SKETCH_BITS + bit, minlength=n_rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, SKETCH_BITS), axis=1).view(np.int64)


def one_bit_minima(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 * MINIMA_WORDS bits per row as int64 words: one bit of the least element in each of as many orders. No row is empty."""
    bits = np.zeros((len(start), 64 * MINIMA_WORDS), dtype=np.uint8)
    low = x.astype(np.uint32)
    for i in range(64 * MINIMA_WORDS):
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat(low * _ODD[i] ^ _FLIP[i], start)
            bits[:, i] = _mix(least.astype(np.uint64) + np.uint64(i)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def least_agreement(threshold: float) -> int:
    """Agreeing minima below which a pair is given up."""
    n, p = 64 * MINIMA_WORDS, (1 + threshold) / 2
    return int(np.floor(n * p - DEVIATIONS * np.sqrt(n * p * (1 - p))))


_ODD = (_mix(np.arange(1, 64 * MINIMA_WORDS + 1).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (_mix(np.arange(1001, 1001 + 64 * MINIMA_WORDS).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MINIMA = [f"m{i}" for i in range(MINIMA_WORDS)]
_WORDS_OF_SKETCH = SKETCH_BITS // 64
_SKETCH = [f"s{i}" for i in range(_WORDS_OF_SKETCH)]
_RECORDS = "id long, class long, n int, " + ", ".join(f"{s} long" for s in [*_SKETCH, *_MINIMA]) + ", elements array<int>"


def _records(run: int, min_words: int):
    """For mapInArrow over (id, text): one row per record. Only the first record of a class in a task carries its sketch and elements."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = _Words(), set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 4096):
                kept, row, x = element_sets(batch.column(1).slice(lo, 4096).to_pylist(), run, min_words, hashes)
                n = len(kept)
                if not n:
                    continue
                size = np.bincount(row, minlength=n)
                start = np.r_[0, np.cumsum(size)[:-1]]
                with np.errstate(over="ignore"):
                    name = np.add.reduceat(_mix(x), start).view(np.int64)
                again = np.zeros(n, dtype=bool)
                for i, c in enumerate(name.tolist()):
                    again[i] = c in met
                    met.add(c)
                own = ~again[row]
                sketch = np.concatenate([parity_sketch(row, x, n), one_bit_minima(x, start)], axis=1)
                ends = np.r_[0, np.cumsum(np.where(again, 0, size))].astype(np.int32)
                elements = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[own].astype(np.uint32).view(np.int32)), mask=pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:][kept].astype(np.int64)),
                        pa.array(name),
                        pa.array(size.astype(np.int32), mask=again),
                        *[pa.array(np.ascontiguousarray(sketch[:, i]), mask=again) for i in range(sketch.shape[1])],
                        elements,
                    ],
                    names=["id", "class", "n", *_SKETCH, *_MINIMA, "elements"],
                )

    return work


_KEYS = "key long, class long, " + ", ".join(f"{m} long" for m in _MINIMA)


def _keys(threshold: float, part: int, parts: int):
    """For mapInArrow over (class, minima, elements): the keys of every class, with its minima."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = batch.column(batch.num_columns - 1)
            ends = elements.offsets.to_numpy().astype(np.int64)
            size = np.diff(ends)
            x = elements.values.to_numpy()[ends[0] : ends[-1]].view(np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            at, key = block_keys(row, x, size, threshold, part, parts)
            kept = [pa.array(c.to_numpy()[at]) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *kept], names=["key", "class", *_MINIMA])

    return work


def _paired(threshold: float):
    """For mapInArrow over (key, class, minima), all rows of a key in one task: the pairs of classes that share a key and enough minima."""
    enough = least_agreement(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[c.to_numpy() for c in b.columns] for b in batches]
        if not found:
            return
        # Bits are counted on unsigned numbers only; of others numpy takes the absolute value.
        key, name, *minima = (np.concatenate(x) for x in zip(*found))
        minima = [m.view(np.uint64) for m in minima]
        del found
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        for size in np.unique(count[count > 1]).tolist():
            at = start[count == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for lo in range(0, len(at), step):
                x, y = (order[(at[lo : lo + step, None] + k).ravel()] for k in (i, j))
                agree = 64 * len(minima) - sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int16) for m in minima)
                exact = np.repeat(key[at[lo : lo + step]] & 1 == 1, len(i))
                fit = ((agree >= enough) | exact) & (name[x] != name[y])
                x, y = name[x[fit]], name[y[fit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return work


def _within(a_n, b_n, distance, threshold: float):
    """Whether sizes and sketch distance leave the threshold possible; for columns and arrays alike."""
    return (a_n >= b_n * threshold) & (b_n >= a_n * threshold) & (distance <= (a_n + b_n) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _block_compare(threshold: float):
    """For applyInArrow over two blocks (``side`` 0 and 1, or one block alone) of one hot key: the pairs within the bound."""

    def work(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        name, n = table["class"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        sketch = np.stack([table[s].to_numpy().view(np.uint64) for s in _SKETCH], axis=1)
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        found_a, found_b = [], []
        for i in left.tolist():
            distance = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
            j = right[_within(n[i], n[right], distance, threshold) & (name[right] != name[i])]
            found_a.append(np.minimum(name[i], name[j]))
            found_b.append(np.maximum(name[i], name[j]))
        both = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return work


def _candidates(classes: DataFrame, hot: DataFrame | None, threshold: float, part: int, tasks: int, most_of_key: int) -> DataFrame:
    """Pairs (``a, b``) of classes that share a key of ``part``; ``hot`` has the keys (``key, n_key``) that many share."""
    keys = classes.select("class", *_MINIMA, "elements").mapInArrow(_keys(threshold, part, ROUNDS), _KEYS)
    few = keys if hot is None else keys.join(hot, "key", "left_anti")
    met = few.repartition(tasks, "key").mapInArrow(_paired(threshold), "a long, b long")
    if hot is None:
        return met.distinct()
    n_blocks = F.ceil(F.col("n_key") * 2 / F.lit(most_of_key)).cast("int")
    many = keys.join(hot, "key").withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Each block meets every other once: a class goes to as many places as there are blocks.
    spread = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", "class", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    placed = spread.join(classes.select("class", "n", *_SKETCH), "class")
    compared = placed.groupBy("key", "lo", "hi").applyInArrow(_block_compare(threshold), "a long, b long")
    return met.unionByName(compared).distinct()


def _hot_keys(classes: DataFrame, threshold: float, most_of_key: int, one_in: int, scratch: Scratch) -> DataFrame | None:
    """The keys that some ``most_of_key`` classes or more share, told by one class in ``one_in``; either way of joining is exact."""
    some = classes.where(F.pmod(F.xxhash64("class"), F.lit(one_in)) == 0).select("class", *_MINIMA, "elements")
    found = None
    for part in range(ROUNDS):
        keys = some.mapInArrow(_keys(threshold, part, ROUNDS), _KEYS).select("key")
        found = keys if found is None else found.unionByName(keys)
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * one_in >= most_of_key)
    hot = scratch.save(counted.select("key", (F.col("n") * one_in).alias("n_key")))
    n_hot = hot.count()
    return None if not n_hot else F.broadcast(hot) if n_hot <= MOST_ENDS else hot


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The (a, b) whose sketches allow, and whose elements reach, the threshold."""
    # A class has a row per task that met it; what they double is dropped with the pairs.
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(s).alias(f"{x}_{s}") for s in _SKETCH])
    distance = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    possible = _within(F.col("a_n"), F.col("b_n"), distance, threshold)
    # Names and sketches of a task's classes fit its memory, so the pairs need no sorting.
    near = scratch.save(pairs.join(side("a").hint("shuffle_hash"), "a").join(side("b").hint("shuffle_hash"), "b").where(possible).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n")).distinct())
    # While their names are few, only the classes of candidates are moved.
    if 2 * near.count() <= MOST_ENDS:
        ends = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct()
        classes = classes.join(F.broadcast(ends), "class", "left_semi")
    whole = lambda x: classes.select(F.col("class").alias(x), F.col("elements").alias(f"{x}_e"))
    shared = F.size(F.array_intersect("a_e", "b_e"))
    return near.join(whole("a"), "a").join(whole("b"), "b").where(shared >= (F.col("n") - shared) * F.lit(threshold) - F.lit(1e-9)).select("a", "b").distinct()


def near_duplicate_links(
    df: DataFrame, id_col: str, text: Column, *, run: int = 5, threshold: float = 0.8, min_words: int = 0, most_of_key: int = MOST_OF_KEY, one_in: int = ONE_IN, label: str = "sketchjoin"
) -> tuple[DataFrame, DataFrame]:
    """Links between near-duplicate records: (links ``a, b`` between classes, membership ``class, rep, id``).

    A class is all records with one element set, named by a 64-bit hash of the set;
    its representative is the smallest id. Linked classes have a Jaccard similarity
    over runs of ``run`` words of at least ``threshold``; each link comes once. Words
    are longest runs of letters or digits in lower case. Records with fewer than
    ``min_words`` words, or fewer than ``run``, have no element and take no part; so do
    null ids. Null text counts as empty; rows repeating an id and text count once, an
    id with several texts counts with each; an empty input gives two empty results;
    further columns are ignored. Texts are used whole, at any length.
    """
    scratch = Scratch(df.sparkSession, label)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("id").isNotNull())
    sets = scratch.save(source.mapInArrow(_records(run, min_words), _RECORDS))
    # At most one row per class and task: a class with a third of all rows is as cheap as any other from here on.
    classes = sets.where(F.col("elements").isNotNull())
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(classes.agg(F.sum("n")).first()[0] or 0) // KEYS_OF_TASK))
    hot = _hot_keys(classes, threshold, most_of_key, one_in, scratch)
    met = None
    for part in range(ROUNDS):
        pairs = scratch.save(_candidates(classes, hot, threshold, part, tasks, most_of_key))
        met = pairs if met is None else met.unionByName(pairs)
    links = scratch.save(_verified(met.distinct(), classes, threshold, scratch))
    rows = sets.select("class", "id").distinct()
    of_class = scratch.save(rows.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows")))
    member = hot_aware_join(rows, of_class.select("class", "rep"), "class", of_class.select("class", "n_rows"), sets.count())
    return links, member


def near_duplicate_pairs(df: DataFrame, id_col: str, text: Column, **options) -> DataFrame:
    """All pairs ``(a, b)`` of ids, a < b, of :func:`near_duplicate_links`, copies included."""
    links, member = near_duplicate_links(df, id_col, text, **options)
    side = lambda x: member.select(F.col("class").alias(x), F.col("id").alias(f"{x}_id"))
    across = links.join(side("a"), "a").join(side("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    copies = member.select("class", F.col("id").alias("a")).join(member.select("class", F.col("id").alias("b")), "class").where("a < b").select("a", "b")
    return across.unionByName(copies)


def near_duplicate_groups(df: DataFrame, id_col: str, text: Column, **options) -> DataFrame:
    """One row per record with at least ``run`` words: ``id``, its class's representative ``rep`` and number of links ``n_links``."""
    links, member = near_duplicate_links(df, id_col, text, **options)
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    degree = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return member.join(degree, "class", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))
