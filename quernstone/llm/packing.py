"""Filling containers of fixed capacity with whole texts: a grouping genetic algorithm on islands.

Texts are spread over shards of bounded size by hash. On every shard several
islands each evolve their own population of packings. A crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold any of
their texts, and best-fits the displaced texts. Between epochs each island's
elite migrates to the next island. The bins that stay under-filled in the best
packing of a shard are opened again and their texts packed together with those of
other shards, with ever fewer and, in the end, a single shard.

Only texts longer than the capacity are split: into full containers and one rest,
which is packed like a text.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scratch import Scratch

#: Texts per shard.
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Bins filled less than this are opened for the next level.
OPEN_BELOW = 0.985

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pre-tokenization of the byte-level vocabularies (fixed values of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _token_counter(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return work


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of every row with an id; null texts have no tokens; of an id met repeatedly the longest text counts."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(_token_counter(tokenizer), "id long, n_tokens long").groupBy("id").agg(F.max("n_tokens").alias("n_tokens"))


class Packing:
    """Bins of item positions; ``room`` finds the fullest bin that still takes an item."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self._by_left: dict[int, list[int]] = {}
        self._lefts = 0

    def _file(self, b: int) -> None:
        left = self.left[b]
        self._by_left.setdefault(left, []).append(b)
        self._lefts |= 1 << left

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.left.append(self.capacity - sum(self.sizes[i] for i in items))
        self._file(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            size = self.sizes[i]
            rest = self._lefts >> size
            if not rest:
                self.add_bin([i])
                continue
            left = (rest & -rest).bit_length() - 1 + size
            same = self._by_left[left]
            b = same.pop()
            if not same:
                self._lefts &= ~(1 << left)
            self.bins[b].append(i)
            self.left[b] = left - size
            self._file(b)

    def fitness(self) -> float:
        """Mean square of the bins' fill: fewer and fuller bins are better."""
        if not self.bins:
            return 1.0
        fill = 1 - np.array(self.left, dtype=float) / self.capacity
        return float((fill * fill).mean())


def _decreasing(sizes: list[int], items: list[int], rng: random.Random, noise: float) -> list[int]:
    return sorted(items, key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))


def fresh(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Packing:
    """Best fit of the items in decreasing order, slightly shuffled."""
    p = Packing(sizes, capacity)
    p.best_fit(_decreasing(sizes, list(range(len(sizes))), rng, noise))
    return p


def crossover(host: Packing, guest: Packing, rng: random.Random) -> Packing:
    """``host`` with some of the best-filled bins of ``guest`` put in whole."""
    sizes, capacity = host.sizes, host.capacity
    good = sorted(range(len(guest.bins)), key=lambda b: guest.left[b])
    good = good[: max(1, len(good) // 2)]
    injected = [guest.bins[b] for b in good if rng.random() < 0.5] or [guest.bins[good[0]]]
    taken = {i for b in injected for i in b}
    child = Packing(sizes, capacity)
    displaced: list[int] = []
    for b in injected:
        child.add_bin(list(b))
    worst = set(sorted(range(len(host.bins)), key=lambda b: -host.left[b])[: max(1, len(host.bins) // 50)])
    for n, b in enumerate(host.bins):
        if n in worst or not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
        else:
            child.add_bin(list(b))
    child.best_fit(_decreasing(sizes, displaced, rng, 0.1))
    return child


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing that one island reaches in one epoch, started from ``guests`` and fresh packings."""
    rng = random.Random(seed)
    pool: list[Packing] = []
    for bins in guests:
        p = Packing(sizes, capacity)
        for b in bins:
            p.add_bin(list(b))
        pool.append(p)
    pool += [fresh(sizes, capacity, rng, 0.0 if n == 0 and not guests else 0.15) for n in range(max(1, population - len(pool)))]
    pool = [(p.fitness(), n, p) for n, p in enumerate(pool)]
    least = -(-sum(sizes) // capacity)
    count = len(pool)
    for _ in range(generations):
        best = max(pool, key=lambda x: x[:2])[2]
        if len(best.bins) <= least:
            break
        for _ in range(len(pool)):
            host, guest = (max(rng.sample(pool, min(2, len(pool))), key=lambda x: x[:2])[2] for _ in range(2))
            child = crossover(host, guest, rng)
            count += 1
            pool.append((child.fitness(), count, child))
        pool = sorted(pool, key=lambda x: x[:2], reverse=True)[:population]
    return max(pool, key=lambda x: x[:2])[2]


_SOLUTION = "kind string, shard long, island int, capacity int, fitness double, bins array<array<long>>"


def _epoch(number: int):
    def work(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        kind, shard, island = key
        if not len(items):
            return pd.DataFrame({"kind": [], "shard": [], "island": [], "capacity": [], "fitness": [], "bins": []})
        items = items.sort_values("id", kind="stable")
        ids, capacity = items["id"].tolist(), int(items["capacity"].iloc[0])
        place = {x: n for n, x in enumerate(ids)}
        guests = [[[place[i] for i in b] for b in bins] for bins in elites.sort_values("fitness", ascending=False, kind="stable")["bins"]] if len(elites) else []
        best = evolve(items["size"].tolist(), capacity, hash((int(shard), int(island), number)), guests)
        return pd.DataFrame({"kind": [kind], "shard": [shard], "island": [island], "capacity": [capacity], "fitness": [best.fitness()], "bins": [[[ids[i] for i in b] for b in best.bins]]})

    return work


def _evolved(items: DataFrame, scratch: Scratch) -> DataFrame:
    """The best packing of every shard: ``kind, shard, capacity, bins``."""
    spark = items.sparkSession
    on_islands = items.withColumn("island", F.explode(F.array(*[F.lit(n) for n in range(ISLANDS)])))
    elites = spark.createDataFrame([], _SOLUTION)
    for epoch in range(EPOCHS):
        here = on_islands.groupBy("kind", "shard", "island")
        found = here.cogroup(elites.groupBy("kind", "shard", "island")).applyInPandas(_epoch(epoch), _SOLUTION)
        found = scratch.save(found)
        # Each island keeps its elite and sends a copy to the next one.
        elites = found.unionByName(found.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
    best = found.groupBy("kind", "shard").agg(F.max_by(F.struct("capacity", "bins"), F.struct("fitness", -F.col("island"))).alias("s"))
    return best.select("kind", "shard", "s.capacity", "s.bins")


def pack(sizes: DataFrame, containers: DataFrame, *, shard_items: int = SHARD_ITEMS, label: str = "packing") -> DataFrame:
    """Every text in containers of every kind: ``container_kind, container_id, doc_id, piece_no, n_tokens``.

    ``sizes`` has ``id, n_tokens`` (:func:`token_counts`), ``containers`` has
    ``container_kind, capacity_tokens``; kinds with a null or non-positive capacity
    are left out, and a kind met repeatedly has its least capacity. A text that
    fits is one piece (number 0) in one container; a longer one has full containers
    of its own and a last piece that is packed with other texts. A text without
    tokens takes no room. No texts or no containers give no rows.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, label)
    kinds = [(r[0], r[1]) for r in containers.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens")).collect()]
    saved = scratch.save(sizes.where("id IS NOT NULL").select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    n_texts = saved.count()
    shards = max(1, -(-n_texts // shard_items))
    kind_structs = [F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("int").alias("capacity")) for k, c in kinds]
    wanted = F.array(*kind_structs) if kinds else F.array().cast("array<struct<kind:string,capacity:int>>")
    each = saved.select("id", "n_tokens", F.inline(wanted))
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    full = F.when((F.col("n_tokens") > 0) & (F.col("n_tokens") % F.col("capacity") == 0), full - 1).otherwise(full)
    each = each.withColumn("n_full", full).withColumn("size", (F.col("n_tokens") - F.col("n_full") * F.col("capacity")).cast("long"))
    alone = each.where("n_full > 0").select("kind", "id", "capacity", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece_no"))
    out = alone.select(
        F.col("kind").alias("container_kind"), F.format_string("%s/own/%d/%d", "kind", "id", "piece_no").alias("container_id"), F.col("id").alias("doc_id"), "piece_no", F.col("capacity").cast("long").alias("n_tokens")
    )
    items = scratch.save(each.select("kind", "id", "capacity", "size", "n_full").withColumn("shard", F.pmod(F.xxhash64("id", "kind"), F.lit(shards))))
    todo, level = items.select("kind", "id", "capacity", "size", "shard"), 0
    while True:
        bins = _evolved(todo, scratch).select("kind", "shard", "capacity", F.posexplode("bins").alias("bin", "ids"))
        placed = bins.select("kind", "shard", "bin", F.explode("ids").alias("id")).join(todo.select("kind", "id", "capacity", "size"), ["kind", "id"])
        fill = placed.groupBy("kind", "shard", "bin").agg((F.sum("size") / F.max("capacity")).alias("fill"))
        state = scratch.save(placed.join(fill, ["kind", "shard", "bin"]).withColumn("open", F.col("fill") < OPEN_BELOW))
        most_open = state.where("open").groupBy("kind").count().agg(F.max("count")).first()[0] or 0
        fewer = max(1, -(-most_open // shard_items))
        # Texts that fill their bins badly wherever they are can't be packed on fewer shards.
        last = shards == 1 or most_open == 0 or fewer >= shards
        done = (state if last else state.where("NOT open")).join(items.select("kind", "id", "n_full"), ["kind", "id"])
        out = out.unionByName(
            done.select(F.col("kind").alias("container_kind"), F.format_string(f"%s/{level}/%d/%d", "kind", "shard", "bin").alias("container_id"), F.col("id").alias("doc_id"), F.col("n_full").alias("piece_no"), F.col("size").alias("n_tokens"))
        )
        if last:
            return out
        shards, level = fewer, level + 1
        todo = state.where("open").select("kind", "id", "capacity", "size", F.pmod(F.xxhash64("shard", "bin"), F.lit(shards)).alias("shard"))
