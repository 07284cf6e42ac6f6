"""Collapsing records that differ only in formatting, by radix partitioning and tries.

Every record's key is reduced to canonical text; records with equal canonical
text are copies. The canonical texts are partitioned recursively: a bucket of more
than ``MOST_IN_BUCKET`` rows, a limit that no input size moves, is split by the next
characters after the prefix that all its members have in common, until each bucket
fits or holds a single text. Only the rows of split buckets are met at the next
depth, and each depth is written. Each fitting bucket is then counted in a trie
whose terminals keep their counters, one bucket at a time. A bucket of a single
text, however hot, needs no trie and no shuffle: its counters come from the partial
aggregates of the partitioning itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scratch import Scratch

#: Rows of a bucket at most; larger ones are split. Bounds the memory of a trie.
MOST_IN_BUCKET = 50_000
#: Buckets split at one depth whose names are broadcast; more are joined by a shuffle.
MOST_SENT = 200_000
#: Characters added to a split bucket's prefix.
STRIDE = 2
#: Bytes per edge of a trie.
EDGE = 8


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def canonical_url(url: Column) -> Column:
    """What remains of a url without its formatting: host, words of the path, sorted query parameters.

    Letter case, scheme, leading ``www.``, ports 80 and 443, surrounding space and
    brackets, percent-encoding, the kind and number of separators, trailing
    punctuation and the order of parameters are dropped. Null where no letter or
    digit remains.
    """
    x = F.regexp_replace(url, r"^[\s<>\[\](){}\"'`\x{A0}]+|[\s<>\[\](){}\"'`\x{A0}]+$", "")
    x = F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*%3a%2f%2f"), _decoded(x)).otherwise(x)
    x = F.regexp_replace(x, r"(?i)^(?:[a-z][a-z0-9+.-]*:/+|/+)", "")
    host = F.lower(_decoded(F.regexp_extract(x, r"^[^/?#]*", 0)))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"[.,;]*(?::(?:80|443)?)?[.,;]*$", "")
    path = F.regexp_extract(x, r"^[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(x, r"\?(.*)$", 1)
    parameters = F.array_sort(F.filter(F.transform(F.split(query, r"[&;?]"), lambda p: _words(_decoded(p))), lambda p: p != ""))
    text = F.concat(F.trim(host), F.lit("/"), _words(_decoded(path)), F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(F.lit("")))
    return F.when(text.rlike(r"[\p{L}\p{N}]"), text)


class _Trie:
    """Byte strings; each terminal counts the records that end there and lists their ids."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, records: list[int]) -> None:
        node = self.root
        for i in range(0, len(key), EDGE):
            node = node.setdefault(key[i : i + EDGE], {})
        node.setdefault(None, []).extend(records)

    def terminals(self) -> Iterator[list[int]]:
        todo = [self.root]
        while todo:
            for edge, below in todo.pop().items():
                if edge is None:
                    yield below
                else:
                    todo.append(below)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (bucket, text, id): one row per text of a batch, with all its ids, so that copies met together move their text once."""
    for batch in batches:
        if batch.num_rows:
            grouped = pa.table(batch).group_by(["bucket", "text"]).aggregate([("id", "list")])
            yield from grouped.rename_columns(["bucket", "text", "ids"]).to_batches()


def _counted(trie: _Trie) -> pa.RecordBatch:
    terminals = list(trie.terminals())
    first = np.repeat([min(t) for t in terminals], [len(t) for t in terminals])
    return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), pa.array(np.concatenate(terminals).astype(np.int64))], names=["first", "id"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (bucket, text, ids), sorted by bucket, whole buckets per partition: (first, id) of every row."""
    present, trie = None, _Trie()
    for batch in batches:
        for bucket, text, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket != present and trie.root:
                yield _counted(trie)
                trie = _Trie()
            present = bucket
            trie.add(text.encode()[len(bucket.encode()) :], ids)
    if trie.root:
        yield _counted(trie)


def _common(a: Column, b: Column) -> Column:
    """Length of the prefix that two texts have in common."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(lengths, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def formatting_copies(df: DataFrame, id_col: str, canonical: Column, *, least_bucket: int = MOST_IN_BUCKET, label: str = "copies") -> DataFrame:
    """One row per record with a canonical text: ``first`` (the least id with that text) and ``id``.

    Records whose canonical text or id is null take no part. Ids repeated with the
    same text are kept as separate rows, each a copy. No rows give no rows. Further
    columns are ignored. Copies of one text may be any share of all rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, label)
    rows = scratch.save(df.select(F.col(id_col).cast("long").alias("id"), canonical.alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()))
    state = [F.count(F.lit(1)).alias("n"), F.min("text").alias("lo"), F.max("text").alias("hi"), F.min("id").alias("first")]
    whole = rows.agg(*state, _common(F.min("text"), F.max("text")).alias("common")).first()
    if whole.n > least_bucket and whole.lo == whole.hi:
        return rows.select(F.lit(whole['first']).alias("first"), "id")
    # All rows begin as one bucket; every text of a split bucket is cut after its bucket's common prefix.
    active = rows.select("id", "text", F.substring("text", 1, whole.common + STRIDE if whole.n > least_bucket else 0).alias("bucket"))
    settled, hot = [], []
    while whole.n > least_bucket:
        big = scratch.save(active.groupBy("bucket").agg(*state).where(F.col("n") > least_bucket).select("bucket", "first", (F.col("lo") == F.col("hi")).alias("one_text"), (_common(F.col("lo"), F.col("hi")) + STRIDE).alias("upto")))
        n_big = big.count()
        if not n_big:
            settled.append(active)
            break
        sent = F.broadcast(big) if n_big <= MOST_SENT else big
        level = scratch.save(active.join(sent, "bucket", "left").select("id", "text", "first", "one_text", F.when(F.col("upto").isNull() | F.col("one_text"), F.col("bucket")).otherwise(F.substring("text", F.lit(1), F.col("upto"))).alias("bucket")))
        settled.append(level.where("one_text IS NULL").select("id", "text", "bucket"))
        hot.append(level.where("one_text").select("first", "id"))
        active = level.where("NOT one_text").select("id", "text", "bucket")
    settled = settled or [active]
    small = settled[0]
    for part in settled[1:]:
        small = small.unionByName(part)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.n // (8 * least_bucket)))
    combined = small.select("bucket", "text", "id").mapInArrow(_combined, "bucket string, text string, ids array<long>")
    counted = combined.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "first long, id long")
    for part in hot:
        counted = counted.unionByName(part)
    return counted


def page_counts(df: DataFrame, id_col: str, url_col: str, **options) -> DataFrame:
    """One row per page: ``first_seq``, the ``url`` of that row as written, and ``n_copies`` (its rows, itself included)."""
    members = formatting_copies(df, id_col, canonical_url(F.col(url_col)), **options)
    pages = members.groupBy(F.col("first").alias("first_seq")).agg(F.count(F.lit(1)).alias("n_copies"))
    urls = df.groupBy(F.col(id_col).cast("long").alias("first_seq")).agg(F.min(url_col).alias("url"))
    return pages.join(urls, "first_seq").select("first_seq", "url", "n_copies")
