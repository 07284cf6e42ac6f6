"""The identity graph: records that share a value are linked, unless too many share it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scratch import Scratch
from quernstone.operators.skew import hot_aware_join

#: A value shared by more records than this is infrastructure, no identity.
MOST_SHARED = 10


def buckets(df: DataFrame, item: str, signals: dict[str, Column]) -> DataFrame:
    """One row per record, signal and value: ``signal``, ``value``, ``item``. Each signal is an array of values; nulls and blanks are none."""
    kinds = F.array(*[F.struct(F.lit(name).alias("signal"), values.alias("values")) for name, values in signals.items()])
    long = df.select(F.col(item).alias("item"), F.explode(kinds).alias("k")).select("item", "k.signal", F.explode("k.values").alias("value"))
    return long.where((F.col("value") != "") & F.col("item").isNotNull()).select("signal", "value", "item").distinct()


def capped(rows: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """The buckets of two to ``most`` records. Sizes are counted before anything is paired, so no hot value is ever expanded."""
    sizes = rows.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    return rows.join(sizes.select("signal", "value"), ["signal", "value"], "left_semi")


def pair_edges(rows: DataFrame) -> DataFrame:
    """``src < dst``, how many values the two records share (``weight``) and of which signals (sorted, ``;``-joined).

    ``rows`` must be capped: a bucket of n records makes n(n-1)/2 pairs.
    """
    a = rows.select("signal", "value", F.col("item").alias("src"))
    b = rows.select("signal", "value", F.col("item").alias("dst"))
    pairs = a.join(b, ["signal", "value"]).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.array_sort(F.collect_set("signal")), ";").alias("signals"))


def shared_with_others(rows: DataFrame) -> DataFrame:
    """Per record and signal: how many values it shares and with how many other records, from capped buckets."""
    a = rows.select("signal", "value", "item")
    b = rows.select("signal", "value", F.col("item").alias("other"))
    return a.join(b, ["signal", "value"]).where("item <> other").groupBy("item", "signal").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("other").alias("n_others"))


def components(edges: DataFrame, *, rounds: int = 60, label: str = "graph") -> DataFrame:
    """``node``, ``component`` (its least node) for the ends of ``src, dst``, by alternating large and small stars.

    Every round hangs the greater neighbours of a node on the least one, then the
    lesser ones, until stars remain. Rounds are written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, label)
    now = scratch.save(edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).where("v <> u").distinct())

    def to_least(rows: DataFrame, n_rows: int) -> DataFrame:
        """Each row with the least neighbour ``m`` of its ``v``. The root of a large component is a hot key."""
        least = rows.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n_rows"))
        return hot_aware_join(rows, least.select("v", "m"), "v", least.select("v", "n_rows"), n_rows)

    for _ in range(rounds):
        n_rows = now.count()
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = to_least(both, 2 * n_rows).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).where("v <> u").distinct()
        small = to_least(large, n_rows).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(large.groupBy("v").agg(F.min("u").alias("u"))).where("v <> u").distinct()
        then = scratch.save(small)
        same = then.exceptAll(now).limit(1).count() == 0 and now.exceptAll(then).limit(1).count() == 0
        scratch.drop(now)
        now = then
        if same:
            roots = now.select(F.col("u").alias("node")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"stars still move after {rounds} rounds")


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each node's root, the least of its tree) after the nodes ``a`` are tied to the nodes ``b``."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            then = root[root]
            if (then == root).all():
                break
            root = then


#: Up to so many edges are joined in one task.
MOST_JOINED = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (src, dst): each end with the least node that the edges of the task connect it to."""
    ends = [[c.cast(pa.string()) for c in batch.columns] for batch in batches if batch.num_rows]
    if not ends:
        return
    coded = pa.concat_arrays([x[i] for i in (0, 1) for x in ends]).dictionary_encode()
    del ends
    # In order, so that the least number of a component is that of its least node; arrow and Spark order by bytes.
    order = pc.sort_indices(coded.dictionary)
    nodes, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[coded.indices.to_numpy()]
    root = hooked(np.arange(len(nodes)), *np.split(at, 2))
    for at in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([nodes[at : at + 50_000], nodes.take(pa.array(root[at : at + 50_000]))], names=["node", "component"])


def joined(edges: DataFrame, *, label: str = "graph") -> DataFrame:
    """As :func:`components` over names (strings), the same rows, without rounds where MOST_JOINED edges or fewer are left.

    More edges are dealt to tasks of about that many, of which each leaves one edge a
    node; that is repeated as long as it takes away a third of them.
    """
    scratch = Scratch(edges.sparkSession, label)
    kept = scratch.save(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    n_kept = kept.count()
    while n_kept > MOST_JOINED:
        stars = kept.repartition(-(-n_kept // MOST_JOINED)).mapInArrow(_stars, "src string, dst string").where("src <> dst")
        before, n_before = kept, n_kept
        kept = scratch.save(stars.distinct())
        n_kept = kept.count()
        scratch.drop(before)
        if n_kept > MOST_JOINED and 3 * n_kept > 2 * n_before:
            return components(kept, label=label)
    return kept.coalesce(1).mapInArrow(_stars, "node string, component string")


def louvain_level(nodes: list, edges: list[tuple], total: float) -> dict:
    """Communities of one component: nodes move to the neighbouring community of greatest modularity gain until none gains.

    ``total`` is twice the edge weight of the whole graph, which the gain depends on.
    An edge from a node to itself counts twice in its degree. Every move raises the
    modularity, so the passes end.
    """
    near: dict = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    degree = {n: sum(x.values()) for n, x in near.items()}
    home, mass = {n: n for n in nodes}, dict(degree)
    moved = True
    while moved:
        moved = False
        for n in sorted(nodes):
            mine = home[n]
            mass[mine] -= degree[n]
            gain: dict = {mine: 0.0}
            for other, w in near[n].items():
                if other != n:
                    gain[home[other]] = gain.get(home[other], 0.0) + w
            best = max(gain, key=lambda c: (gain[c] - mass[c] * degree[n] / total, -1 if c != mine else 0, str(c)))
            if gain[best] - mass[best] * degree[n] / total <= gain[mine] - mass[mine] * degree[n] / total + 1e-12 * degree[n]:
                best = mine
            mass[best] += degree[n]
            moved |= best != mine
            home[n] = best
    return home


def louvain_levels(nodes: list, edges: list[tuple], total: float) -> dict:
    """As :func:`louvain_level`, then the communities become nodes of a weighted graph and move likewise, until none gains."""
    home = {n: n for n in nodes}
    while True:
        level = louvain_level(nodes, edges, total)
        if all(level[n] == n for n in nodes):
            return home
        home = {n: level[c] for n, c in home.items()}
        between: dict = {}
        for a, b, w in edges:
            pair = tuple(sorted((level[a], level[b])))
            between[pair] = between.get(pair, 0.0) + w
        nodes, edges = sorted(set(level.values())), [(a, b, w) for (a, b), w in between.items()]


#: Components of more edges than this are not gathered in one task.
MOST_EDGES = 200_000


def spread_labels(edges: DataFrame, rounds: int = 12, *, label: str = "spread") -> DataFrame:
    """``node``, ``community`` (its least node) over ``src, dst, w``: every node takes the label of most weight around it, a fixed number of times.

    Its own label counts as the lightest neighbour, ties go to the least label, and
    nodes take turns by parity of their hash, so that two can't swap labels for ever.
    """
    scratch = Scratch(edges.sparkSession, label)
    both = scratch.save(edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    now = scratch.save(both.select(F.col("src").alias("node")).distinct().withColumn("l", F.col("node")))
    for n in range(rounds):
        seen = both.join(now.select(F.col("node").alias("dst"), "l"), "dst").groupBy("src", "l").agg(F.sum("w").alias("w"))
        best = seen.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "l")).alias("b")).select(F.col("src").alias("node"), F.col("b.l").alias("to"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == n % 2
        then = scratch.save(now.join(best, "node", "left").select("node", F.when(turn, F.coalesce("to", "l")).otherwise(F.col("l")).alias("l")))
        scratch.drop(now)
        now = then
    least = now.groupBy("l").agg(F.min("node").alias("community"), F.count(F.lit(1)).alias("n_rows"))
    return hot_aware_join(now, least.select("l", "community"), "l", least.select("l", "n_rows"), now.count()).select("node", "community")


def communities(edges: DataFrame, weight: str = "weight", *, label: str = "louvain") -> DataFrame:
    """``node``, ``community`` (its least node): Louvain's method with all its levels, component by component.

    Components of at most MOST_EDGES edges are one group each. The weight of the whole
    graph, one number, is passed in, so the result is that of moving nodes in the
    whole graph. Larger components are divided by :func:`spread_labels` instead.
    """
    import pandas as pd

    parts = components(edges, label=label)
    total = 2.0 * (edges.agg(F.sum(weight)).first()[0] or 0.0)
    placed = edges.join(parts.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", F.col(weight).cast("double").alias("w"))
    kind = edges.schema["src"].dataType.simpleString()

    def work(group: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(group["src"]) | set(group["dst"]))
        home = louvain_levels(nodes, list(zip(group["src"], group["dst"], group["w"])), total)
        least: dict = {}
        for n in nodes:
            least.setdefault(home[n], n)
        return pd.DataFrame({"node": nodes, "community": [least[home[n]] for n in nodes]})

    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > MOST_EDGES).select("component")
    small = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(work, f"node {kind}, community {kind}")
    if not large.limit(1).count():
        return small
    return small.unionByName(spread_labels(placed.join(large, "component", "left_semi").select("src", "dst", "w"), label=f"{label}-large"))


def cluster_report(members: DataFrame, group: str, item: str, part: str) -> DataFrame:
    """Per group: its records and the number of different ``part`` values among them."""
    return members.groupBy(group).agg(F.countDistinct(item).alias("n_items"), F.countDistinct(part).alias("n_parts"))


def coherence(rows: DataFrame, value: str, item: str, owner: str, part: str) -> DataFrame:
    """Per value: its records, different owners, records without an owner, different parts."""
    return rows.groupBy(value).agg(
        F.countDistinct(item).alias("n_items"), F.countDistinct(owner).alias("n_owners"), F.count_if(F.col(owner).isNull()).alias("n_unowned"), F.countDistinct(part).alias("n_parts")
    )


def mean_cosine(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """Per group of two or more unit vectors: the mean cosine over all pairs, without making a pair.

    The pairs' sum is (|sum of vectors|² - n) / 2, so one algebraic aggregate of
    ``size`` sums per group does; it combines inside each partition.
    """
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.where(v.isNotNull() & (F.size(v) == size) & (norm > 0)).select(group, F.transform(v, lambda x: x.cast("double") / norm).alias("u"))
    sums = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n_items"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(size)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, size)), F.col("s0") * F.col("s0"))
    return sums.where("n_items > 1").select(group, "n_items", ((square - F.col("n_items")) / (F.col("n_items") * (F.col("n_items") - 1))).alias("mean_cosine"))
