"""Joins on likeness and nearness: fuzzy names without comparing all pairs, keywords near a position."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.vectorized import common_length, sorted_tokens, token_sort_ratio
from quernstone.operators.identity import hooked
from quernstone.operators.scratch import Scratch


def most_edits(length: int, other: int, least: float) -> int:
    """Insertions and deletions that leave two texts of these lengths an indel ratio of ``least``."""
    return int((1 - least / 100) * (length + other) + 1e-9)


def _parts(length: int, n: int) -> list[tuple[int, int]]:
    """``n`` nearly equal parts of a text: (start, length)."""
    base, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = base + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def _keys(least: float):
    """For mapInArrow over names: (key, name, side), for pairs of more than MOST_GROUPED edits. Side 0 indexes a name's own parts, side 1 probes those of the shorter or equally long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, sides = [], [], []
            for name in batch.column(0).to_pylist():
                text = sorted_tokens(name)
                n = len(text)
                made: set[tuple[str, int]] = set()
                # Own parts, once per number of edits that a partner of some length allows.
                longest = int(n * (200 - least) / least) if least > 0 else n
                for edits in {e for m in range(n, longest + 1) if (e := even_edits(n, m, least)) > MOST_GROUPED}:
                    for i, (at, size) in enumerate(_parts(n, edits + 1)):
                        made.add((f"{n}:{edits}:{i}:{text[at : at + size]}", 0))
                # Substrings that can be a part of a partner no longer than this one.
                for m in range(max(1, int(n * least / (200 - least))), n + 1):
                    edits = even_edits(n, m, least)
                    if edits <= MOST_GROUPED:
                        continue
                    for i, (at, size) in enumerate(_parts(m, edits + 1)):
                        for start in range(max(0, at - edits), min(n - size, at + edits) + 1):
                            made.add((f"{m}:{edits}:{i}:{text[start : start + size]}", 1))
                for key, side in made:
                    keys.append(key)
                    names.append(name)
                    sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(sides, pa.int8())], names=["key", "name", "side"])

    return work


def even_edits(length: int, other: int, least: float) -> int:
    """As :func:`most_edits`, less one where that many can't be: the lengths say whether a distance is odd or even."""
    edits = most_edits(length, other, least)
    return edits - ((edits ^ (length + other)) & 1)


#: Pairs that may differ by more edits than this are met by the parts of the longer names, all others by groups of characters.
MOST_GROUPED = 24


def _groups(edits: int) -> tuple[int, int]:
    """For pairs of up to so many edits: the number of groups of characters, and how many of them make a key."""
    kept = 2 if edits <= 12 else 1
    return edits + kept, kept


def _budgets(length: int, least: float) -> list[int]:
    """The numbers of edits that a text of this length may have with partners of any length, as far as groups serve them."""
    shortest, longest = int(length * least / (200 - least)), int(length * (200 - least) / least) if least > 0 else length
    most = {even_edits(length, m, least) for m in range(max(1, shortest), longest + 1) if abs(length - m) <= even_edits(length, m, least)}
    return sorted(e for e in most if e <= MOST_GROUPED)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix, one row a text, and the lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(1, int(lengths.max()))
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width), lengths


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over names: how often each character stands in the batch."""
    for batch in batches:
        seen = Counter("".join(sorted_tokens(name) for name in batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(map(ord, seen), pa.int32()), pa.array(seen.values(), pa.int64())], names=["c", "n"])


def _balanced(counts: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters in rising order and the group of each, so that all ``n`` groups come up about equally often."""
    load, group = [0] * n, {}
    for c, times in sorted(counts, key=lambda x: (-x[1], x[0])):
        g = load.index(min(load))
        group[c], load[g] = g, load[g] + times
    chars = sorted(group)
    return np.array(chars, dtype=np.uint32), np.array([group[c] for c in chars], dtype=np.int64)


def _group_keys(counts: list[tuple[int, int]], least: float):
    """For mapInArrow over names: (key, name), a key for each choice of groups and each number of edits, which is in the key's lowest bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        budgets: dict[int, list[int]] = {}
        for batch in batches:
            by_edits: dict[int, list[tuple[str, str]]] = {}
            for name in batch.column(0).to_pylist():
                if text := sorted_tokens(name):
                    if len(text) not in budgets:
                        budgets[len(text)] = _budgets(len(text), least)
                    for edits in budgets[len(text)]:
                        by_edits.setdefault(edits, []).append((text, name))
            for edits, members in by_edits.items():
                n, kept = _groups(edits)
                if edits not in tables:
                    tables[edits] = _balanced(counts, n)
                chars, group_of = tables[edits]
                codes, lengths = _codes([t for t, _ in members])
                inside = np.arange(codes.shape[1]) < lengths[:, None]
                # Group n is no group: what lies behind the end of a text.
                groups = np.where(inside, group_of[np.minimum(np.searchsorted(chars, codes), len(chars) - 1)], n)
                names = pa.array([name for _, name in members], pa.string())
                for i, chosen in enumerate(combinations(range(n), kept)):
                    serves = np.zeros(n + 1, dtype=bool)
                    serves[list(chosen)] = True
                    key = np.full(len(members), i + 1, dtype=np.uint64)
                    for j in range(codes.shape[1]):
                        key = np.where(serves[groups[:, j]], (key + codes[:, j]) * _ODD, key)
                    key ^= key >> np.uint64(29)
                    key = (key * _ODD) & ~np.uint64(31) | np.uint64(edits)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), names], names=["key", "name"])

    return work


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Pairs compared at once.
_AT_ONCE = 200_000
#: Pairs after which it is looked anew which ones are connected already.
_TIED_AT_ONCE = 50_000


def common_lengths(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """As ``common_length`` for many pairs at once: row by row over matrices of code points, texts of ``a`` of at most 63 characters."""
    width = int(a_lengths.max())
    inside = np.arange(width) < a_lengths[:, None]
    # Code points in as few bytes as they need; no text has the last of these numbers, which stands behind an end.
    kind = np.uint8 if max(a.max(), b.max()) < 255 else np.uint16 if max(a.max(), b.max()) < 65_535 else np.uint32
    a = np.where(inside, a[:, :width], np.iinfo(kind).max).astype(kind)
    b = np.ascontiguousarray(b[:, : int(b_lengths.max())].T.astype(kind))
    packed, s = np.zeros((len(a), 8), dtype=np.uint8), np.full(len(a), ~np.uint64(0))
    at = packed.view("<u8")[:, 0]
    for j, column in enumerate(b):
        packed[:, : (width + 7) // 8] = np.packbits(a == column[:, None], axis=1, bitorder="little")
        at[b_lengths <= j] = 0
        u = s & at
        s = (s + u) | (s - u)
    return np.bitwise_count(~s & ((np.uint64(1) << a_lengths.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


class _Trees:
    """The names that one task has seen, by number, and the trees that its pairs have joined them to."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.root = np.zeros(0, dtype=np.int64)

    def numbers(self, names: list[str]) -> np.ndarray:
        at = np.array([self.number.setdefault(n, len(self.number)) for n in names], dtype=np.int64)
        self.root = np.r_[self.root, np.arange(len(self.root), len(self.number))]
        return at

    def stars(self) -> pa.RecordBatch:
        """Each name with the least one of its tree, names that are alone left out."""
        least: dict[int, str] = {}
        for n, r in zip(self.number, self.root.tolist()):
            if r not in least or n < least[r]:
                least[r] = n
        ties = [(n, least[r]) for n, r in zip(self.number, self.root.tolist()) if n != least[r]]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in ties], pa.string()), pa.array([m for _, m in ties], pa.string())], names=["src", "dst"])


def _alike(least: float, link: bool = False):
    """For mapInArrow over (key, name) in order of the key: (a, b, ratio) of the pairs that share a key and are alike.

    With ``link``, (src, dst) that connect the same names: pairs already connected by
    others of the task are neither compared nor given, and a task gives fewer rows
    than it has names, however many pairs are alike.
    """
    limits: dict[int, np.ndarray] = {}

    def limit(total: np.ndarray) -> np.ndarray:
        most = int(total.max())
        if most not in limits:
            limits[most] = np.array([even_edits(n, 0, least) for n in range(most + 1)], dtype=np.int64)
        return limits[most][total]

    def compared(keys: np.ndarray, names: pa.Array, trees: _Trees | None) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[new, len(keys)])
        in_run = np.repeat(sizes, sizes) > 1
        if not in_run.any():
            return
        names, edits = names.filter(pa.array(in_run)).to_pylist(), keys[in_run] & 31
        sizes = sizes[sizes > 1]
        texts = [sorted_tokens(name) for name in names]
        numbers = trees.numbers(names) if link else None
        codes, lengths = _codes(texts)
        bags = np.zeros((len(texts), 32), dtype=np.int16)
        for j in range(codes.shape[1]):
            rows = np.flatnonzero(lengths > j)
            bags[rows, codes[rows, j] % 32] += 1

        def alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of the pairs those that are alike and, with ``link``, not yet connected; and their ratios."""
            if link:
                apart = trees.root[numbers[left]] != trees.root[numbers[right]]
                left, right = left[apart], right[apart]
            if not len(left):
                return left, right, np.zeros(0)
            allowed = limit(lengths[left] + lengths[right])
            fit = (allowed == edits[left]) & (np.abs(lengths[left] - lengths[right]) <= allowed)
            left, right, allowed = left[fit], right[fit], allowed[fit]
            fit = np.abs(bags[left] - bags[right]).sum(axis=1) <= allowed
            left, right = left[fit], right[fit]
            shorter = np.where(lengths[left] <= lengths[right], left, right)
            longer = left + right - shorter
            common = np.empty(len(left), dtype=np.int64)
            fast = lengths[shorter] <= 63
            # In order of their lengths, for matrices without much behind the ends.
            at = np.flatnonzero(fast)[np.argsort(lengths[longer[fast]], kind="stable")]
            for part in np.array_split(at, len(at) // 5_000 + 1) if len(at) else []:
                common[part] = common_lengths(codes[shorter[part]], lengths[shorter[part]], codes[longer[part]], lengths[longer[part]])
            for k in np.flatnonzero(~fast):
                common[k] = common_length(texts[left[k]], texts[right[k]])
            ratio = 100.0 * 2 * common / (lengths[left] + lengths[right])
            found = ratio >= least
            return left[found], right[found], ratio[found]

        def tie(left: np.ndarray, right: np.ndarray) -> None:
            left, right, _ = alike(left, right)
            trees.root = hooked(trees.root, numbers[left], numbers[right])

        # Each name meets those after it in its run.
        n_after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(texts)) - 1
        before = np.r_[0, np.cumsum(n_after)]
        if link:
            # The next one first, which connects most of a run in which all are alike.
            left = np.flatnonzero(n_after)
            for part in np.array_split(left, len(left) // _TIED_AT_ONCE + 1):
                tie(part, part + 1)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(before, before[first] + _AT_ONCE, "right")) - 1)
            count = n_after[first:last]
            left = np.repeat(np.arange(first, last), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(before[first:last] - before[first], count)
            first = last
            if not len(left):
                continue
            if link:
                apart = trees.root[numbers[left]] != trees.root[numbers[right]]
                left, right = left[apart], right[apart]
                for part in np.array_split(np.arange(len(left)), len(left) // _TIED_AT_ONCE + 1):
                    tie(left[part], right[part])
                continue
            left, right, ratio = alike(left, right)
            if not len(left):
                continue
            pairs = {}
            for k in range(len(left)):
                a, b = names[left[k]], names[right[k]]
                if a != b:
                    pairs[(a, b) if a < b else (b, a)] = ratio[k]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(list(pairs.values()), pa.float64())], names=["a", "b", "ratio"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names = np.zeros(0, dtype=np.int64), pa.array([], pa.string())
        trees = _Trees() if link else None
        for batch in batches:
            # The last run may go on in the next batch.
            keys = np.r_[keys, batch.column(0).to_numpy()]
            names = pa.concat_arrays([names, batch.column(1).cast(pa.string())])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole >= 50_000:
                yield from compared(keys[:whole], names[:whole], trees)
                keys, names = keys[whole:], names[whole:]
        if len(keys):
            yield from compared(keys, names, trees)
        if link:
            yield trees.stars()

    return work


def _names(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df.sparkSession, "names").save(df.select(F.trim(F.col(name)).alias("name")).where("name <> ''").distinct())


def _sharing_keys(names: DataFrame, least: float) -> DataFrame:
    """``key``, ``name`` in order of the key, for :func:`_alike`."""
    # One row for each character that names are written in.
    counts = [(r.c, r.n) for r in names.mapInArrow(_char_counts, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()]
    # Few bytes, much work each: the number of partitions is not left to their size.
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = names.repartition(n, "name").mapInArrow(_group_keys(counts, least), "key long, name string")
    return keyed.repartition(n, "key").sortWithinPartitions("key")


def _long_pairs(names: DataFrame, least: float) -> DataFrame | None:
    """``a``, ``b``, ``ratio`` of the pairs that differ by more than MOST_GROUPED edits; None where names are too short for that."""
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    if least > 0 and most_edits(longest, int(longest * (200 - least) / least), least) <= MOST_GROUPED:
        return None
    long = names.mapInArrow(_keys(least), "key string, name string, side byte")
    own = long.where("side = 0").select("key", F.col("name").alias("x"))
    probe = long.where("side = 1").select("key", F.col("name").alias("y"))
    met = own.join(probe, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.withColumn("ratio", token_sort_ratio("a", "b")).where(F.col("ratio") >= least)


def similar_names(df: DataFrame, name: str, least: float = 90.0) -> DataFrame:
    """All pairs ``a < b`` of different names whose sorted words have an indel ratio of ``least`` or more, with the ``ratio``.

    An inserted or deleted character belongs to one group of characters and leaves the
    others as they are. With two groups more than the edits allowed, two texts have
    at least two groups in common, and what stands of them in the texts, in its
    order, is the same in both: that is the key. Unlike a part of a name such a key
    draws on all of its words, so names that share a given name or a legal form don't
    meet by it alone. Groups are balanced by how often characters come up. Pairs of
    more than MOST_GROUPED edits, in very long names, meet by the parts of
    :func:`_keys` instead. Null and blank names take no part.
    """
    names = _names(df, name)
    found = _sharing_keys(names, least).mapInArrow(_alike(least), "a string, b string, ratio double")
    long = _long_pairs(names, least)
    return (found if long is None else found.unionByName(long)).distinct()


def linked_names(df: DataFrame, name: str, least: float = 90.0) -> DataFrame:
    """``src, dst`` that connect the same names as the pairs of :func:`similar_names`, which are not all made: for clusters."""
    names = _names(df, name)
    found = _sharing_keys(names, least).mapInArrow(_alike(least, link=True), "src string, dst string")
    long = _long_pairs(names, least)
    return (found if long is None else found.unionByName(long.select(F.col("a").alias("src"), F.col("b").alias("dst")))).distinct()


def nearest_word(df: DataFrame, item: str, text: Column, pattern: str, words: dict[str, str], reach: int = 200) -> DataFrame:
    """For every match of ``pattern`` in a text the label of the closest of ``words`` within ``reach`` characters, on either side.

    ``item, match_no, match, label, distance``; null label where none is near. Ties go to
    the word that comes first. Words are patterns with a label each. Positions come
    from splitting the text, all in expressions.
    """

    def found(p: str) -> Column:
        # The lengths of what lies between matches give their places.
        between, hits = F.split(F.col("__t"), p), F.regexp_extract_all(F.col("__t"), F.lit(f"({p})"), F.lit(1))
        before = lambda i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
        return F.transform(hits, lambda h, i: F.struct(before(i).alias("at"), F.length(h).alias("size"), h.alias("hit")))

    rows = df.select(F.col(item).alias("item"), text.alias("__t")).where(F.col("__t").isNotNull())
    marks = rows.select("item", "__t", F.posexplode(found(pattern)).alias("match_no", "m"))

    def labelled(label: str, p: str) -> Column:
        return F.transform(found(p), lambda w: F.struct(w["at"].alias("at"), w["size"].alias("size"), F.lit(label).alias("label")))

    near = F.array(*[labelled(label, p) for label, p in words.items()])
    scored = marks.select("item", "match_no", "m", F.flatten(near).alias("w"))
    gap = lambda w: F.greatest(w["at"] - (F.col("m.at") + F.col("m.size")), F.col("m.at") - (w["at"] + w["size"]), F.lit(0))
    close = F.filter(F.transform("w", lambda w: F.struct(gap(w).alias("distance"), w["at"].alias("at"), w["label"].alias("label"))), lambda w: w["distance"] <= reach)
    best = F.array_min(close)
    return scored.select("item", "match_no", F.col("m.hit").alias("match"), best["label"].alias("label"), best["distance"].alias("distance"))


def running_ids(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Number the groups from 1 by size, the largest first; ties by ``group``. Groups are the small side of a clustering."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n_rows"), *(order or (group,)))))
