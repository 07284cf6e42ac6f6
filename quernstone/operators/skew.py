"""Per-key results when a few keys hold most rows.

Aggregates here are algebraic (count, sum, min, max, max_by over one struct), so
Spark's partial hash aggregation combines each partition's rows into one state
per key before anything moves; the shuffle then carries at most
``partitions x keys`` compact states, however skewed the keys are. Joins that
must meet the rows of a hot key again split the few hot keys off and broadcast
only those, whose number has a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from 1/HOT_SHARE of all rows on, so at most HOT_SHARE keys are ever broadcast.
HOT_SHARE = 200
#: Nor does any with fewer rows, which one task joins as fast as several.
LEAST_HOT = 20_000


def per_key_state(df: DataFrame, key: str, sums: dict[str, Column] | None = None, latest_by: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """One row per value of ``key``: row count, sums, and the columns of the latest row.

    ``sums`` maps result names to numeric columns; null terms count as zero and an
    all-null or empty sum is 0. The latest row has the greatest ``latest_by`` tuple,
    nulls lowest, so ties need a unique last column to be defined; ``latest`` names
    the columns taken from it (prefixed ``latest_``). Null keys form their own group.
    Every aggregate is combined inside each partition before the shuffle. An empty
    input gives an empty result.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for name, term in (sums or {}).items():
        aggs.append(F.coalesce(F.sum(term), F.lit(0)).alias(name))
    if latest:
        order = F.struct(*[F.col(c) for c in latest_by])
        row = F.struct(*[F.col(c).alias(c) for c in latest])
        aggs.append(F.max(F.struct(order.alias("o"), row.alias("r"))).alias("__latest"))
    out = df.groupBy(F.col(key).alias(key)).agg(*aggs)
    if latest:
        out = out.select(*[c for c in out.columns if c != "__latest"], *[F.col(f"__latest.r.{c}").alias(f"latest_{c}") for c in latest])
    return out


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The non-null values of ``key`` holding at least ``share`` of all rows, nulls counted in the total.

    Partial counts are combined per partition; the total is summed from the same
    small per-key states; the plan counts twice, once for the total and once for the
    keys, and each scan reads the one column only. No rows give no keys.
    """
    counts = df.groupBy(F.col(key).alias(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    # A ROLLUP would expand every row twice; summing states costs one row per key.
    total = counts.select(F.sum("n_rows")).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") >= total * F.lit(share))).select(key)


def hot_aware_join(facts: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total_rows: int, least_hot: int = LEAST_HOT) -> DataFrame:
    """Inner join of ``facts`` with a ``lookup`` unique on ``key``, no task meeting all rows of a hot key.

    ``counts`` has (``key``, ``n_rows``) for every key of ``facts``. Keys with at least
    ``total_rows / HOT_SHARE`` rows number at most HOT_SHARE and are joined by
    broadcast, without moving their rows; all others are joined by a shuffle, as are
    all keys where none can have ``least_hot`` rows. Null keys join nothing.
    """
    if total_rows < least_hot:
        return facts.join(lookup, key)
    floor = max(least_hot, total_rows // HOT_SHARE)
    hot = counts.where(F.col("n_rows") >= F.lit(floor)).select(key)
    hot_lookup = F.broadcast(lookup.join(hot, key, "left_semi"))
    hot_keys = F.broadcast(hot)
    by_broadcast = facts.join(hot_lookup, key)
    by_shuffle = facts.join(hot_keys, key, "left_anti").join(lookup, key)
    return by_broadcast.unionByName(by_shuffle)
