"""Finding evaluation texts inside a corpus by suffix arrays over corpus shards.

Each task turns its documents into shards of word numbers and sorts the suffixes
of a shard by prefix doubling. Every suffix of every item is then looked up by
binary search, one word deeper at a time and for all suffixes at once; those
found to the required depth are extended to the longest verbatim match, with its
place in document and item.

Only words of the items can be part of a match, so all other words of the corpus
are one number that equals nothing. That number also parts the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shard; bounds a task's memory to some 100 bytes per word, whatever the size of its input.
SHARD_WORDS = 1_500_000
#: Characters of item texts sent to every executor at once; larger item tables are looked up in several passes.
BLOCK_CHARS = 32_000_000
#: (item suffix, corpus place) pairs extended at once.
PAIRS_AT_ONCE = 2_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")


class _Items:
    """The items of one block as word numbers, one after the other, each ended by -1."""

    def __init__(self, rows: list[tuple[int, str]], least: int) -> None:
        self.numbers: dict[str, int] = {}
        flat: list[int] = []
        of: list[int] = []
        for item, text in rows:
            words = _WORD.findall(text.lower())
            if len(words) < least:
                continue
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            flat += [*numbers, -1]
            of += [item] * (len(numbers) + 1)
        self.words = np.array([*flat, *[-1] * least], dtype=np.int64)
        self.item = np.array([*of, *[0] * least], dtype=np.int64)
        whole = np.ones(len(flat), dtype=bool)
        for k in range(least):
            whole &= self.words[k : k + len(flat)] > 0
        self.starts = np.flatnonzero(whole)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``words`` in the order of their suffixes, compared by at least ``depth`` words."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-have] = rank[have:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(rank, kind="stable")


def _bound(words: np.ndarray, suffixes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of ``wanted`` at ``depth`` in each interval [lo, hi) of the suffix array."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        todo = lo < hi
        if not todo.any():
            return lo
        mid = (lo + hi) >> 1
        at = suffixes[np.where(todo, mid, 0)] + depth
        there = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
        less = (there <= wanted) if right else (there < wanted)
        lo = np.where(todo & less, mid + 1, lo)
        hi = np.where(todo & ~less, mid, hi)


def _extended(words: np.ndarray, at: np.ndarray, items: _Items, start: np.ndarray, least: int) -> np.ndarray:
    """Length of the verbatim match of each (corpus place, item place), known to be at least ``least``."""
    length = np.full(len(at), least, dtype=np.int64)
    going = np.arange(len(at))
    while len(going):
        a, b = at[going] + length[going], start[going] + length[going]
        same = (a < len(words)) & (b < len(items.words))
        same &= words[np.minimum(a, len(words) - 1)] == items.words[np.minimum(b, len(items.words) - 1)]
        going = going[same]
        length[going] += 1
    return length


def _shard_matches(docs: list[int], lengths: list[int], flat: list[int], items: _Items, least: int) -> Iterator[pa.RecordBatch]:
    words = np.array(flat, dtype=np.int64)
    starts_of = np.r_[0, np.cumsum(lengths)]
    # A match lies in a run of item words of at least its length; suffixes elsewhere are left out.
    known = (words > 0).astype(np.int64)
    total = np.r_[0, np.cumsum(known)]
    can = np.flatnonzero(total[least:] - total[:-least] == least) if len(words) >= least else np.array([], dtype=np.int64)
    if not len(can) or not len(items.starts):
        return
    keep = np.zeros(len(words) + 1, dtype=bool)
    for k in range(least):
        keep[can + k] = True
    keep = keep[:-1]
    # One place of each gap stays, to part the runs on both sides of it.
    gap_start = ~keep & np.r_[True, keep[:-1]]
    kept = np.flatnonzero(keep | gap_start)
    place, words = kept, np.where(keep[kept], words[kept], 0)
    suffixes = suffix_array(words, least)
    suffixes = suffixes[words[suffixes] > 0]
    query = items.starts
    lo, hi = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(suffixes), dtype=np.int64)
    for depth in range(least):
        wanted = items.words[query + depth]
        low = _bound(words, suffixes, lo, hi, depth, wanted, False)
        high = _bound(words, suffixes, low, hi, depth, wanted, True)
        live = low < high
        query, lo, hi = query[live], low[live], high[live]
        if not len(query):
            return
    ends = np.cumsum(hi - lo)
    first = 0
    while first < len(query):
        # As many item suffixes as have PAIRS_AT_ONCE places together, one at least.
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        count = (hi - lo)[first:last]
        q = np.repeat(query[first:last], count)
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = suffixes[np.repeat(lo[first:last], count) + offset]
        # A match that goes on to the left was met one word earlier.
        left = (at > 0) & (q > 0) & (words[at - 1] == items.words[q - 1]) & (items.words[q - 1] > 0)
        at, q = at[~left], q[~left]
        first = last
        if not len(at):
            continue
        length = _extended(words, at, items, q, least)
        doc = np.searchsorted(starts_of, place[at], side="right") - 1
        item = items.item[q]
        order = np.lexsort((q, place[at], -length, item, doc))
        best = order[np.r_[True, (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])]]
        item_start = np.searchsorted(items.item_first, q[best], side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(docs, dtype=np.int64)[doc[best]]),
                pa.array(item[best]),
                pa.array(length[best].astype(np.int32)),
                pa.array((place[at][best] - starts_of[doc[best]]).astype(np.int32)),
                pa.array((q[best] - items.item_first[item_start]).astype(np.int32)),
            ],
            names=["doc_id", "item_id", "n_words", "doc_word", "item_word"],
        )


def _matcher(shared, least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(shared.value, least)
        items.item_first = np.flatnonzero(np.r_[True, items.words[:-1] == -1])
        number = items.numbers
        docs, lengths, flat = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = len(flat)
                flat += [number.get(w, 0) for w in _WORD.findall(text.as_py().lower())]
                flat.append(0)
                docs.append(doc)
                lengths.append(len(flat) - before)
                if len(flat) >= SHARD_WORDS:
                    yield from _shard_matches(docs, lengths, flat, items, least)
                    docs, lengths, flat = [], [], []
        if docs:
            yield from _shard_matches(docs, lengths, flat, items, least)

    return work


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, *, least: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item sharing at least ``least`` consecutive words: ``doc_id, item_id, n_words, doc_word, item_word``.

    ``n_words`` is the longest verbatim match of the pair, and the other two are the
    word offsets where it begins (the first such place). Words are longest runs of
    letters or digits in lower case, so punctuation and spacing don't matter. Null
    ids and texts take no part, items shorter than ``least`` words match nothing,
    rows repeated in either table change nothing, and empty tables give no rows.
    Documents are used whole. Items are sent out in blocks of at most
    ``block_chars`` characters (or one item), so their table may grow.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for block in range(n_blocks):
        own = texts if n_blocks == 1 else texts.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in own.collect()])
        part = corpus.mapInArrow(_matcher(shared, least), "doc_id long, item_id long, n_words int, doc_word int, item_word int")
        found = part if found is None else found.unionByName(part)
    first = F.struct(-F.col("n_words"), F.col("doc_word"), F.col("item_word"))
    best = found.groupBy("doc_id", "item_id").agg(F.min(first).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col1")).alias("n_words"), F.col("b.doc_word").alias("doc_word"), F.col("b.item_word").alias("item_word"))


def without_leaks(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents that contain no item; documents without an id are kept."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
