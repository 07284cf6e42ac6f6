"""Record-level operators: deduplication, last-wins indexes, merges, resumption, ranked lookup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.skew import hot_aware_join


def best_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of every key in ``order``, as an aggregate that combines inside each partition.

    A window would sort every key's rows in one task; the least (order, row) state
    does not, so hot keys stay cheap. ``order`` must end in a unique column for the
    result to be defined. Null keys form one group.
    """
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    state = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), ranked).alias("__row"))
    return state.select("__row.*")


def filled(df: DataFrame, *besides: str) -> Column:
    """How many columns of a row, other than ``besides``, hold a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in df.columns if c not in besides), F.lit(0))


def last_wins(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The row of each non-null key that came last, by ``sequence`` (nulls first)."""
    return best_per_key(df.where(F.col(key).isNotNull()), F.col(key), -F.coalesce(F.col(sequence), F.lit(-(2**62))))


def merged(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Upsert: every key of either side, the columns of ``incoming`` over those of ``stored`` wherever they are not null.

    Both sides must be unique on ``key``. Columns of one side alone are null for keys of the other.
    """
    both = stored.alias("s").join(incoming.alias("i"), F.col(f"s.{key}") == F.col(f"i.{key}"), "full")
    names = [*stored.columns, *[c for c in incoming.columns if c not in stored.columns]]

    def value(c: str) -> Column:
        if c in stored.columns and c in incoming.columns:
            return F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}"))
        return F.col(f"i.{c}" if c in incoming.columns else f"s.{c}")

    return both.select(*[value(c).alias(c) for c in names])


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key ``done`` doesn't have yet; null keys are never done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def ranked_lookup(probes: DataFrame, probe_id: str, candidates: Column, stored: DataFrame, stored_key: str, keep: Sequence[str]) -> DataFrame:
    """For each probe the stored row of its first candidate key that is stored.

    ``candidates`` is an array in order of preference. Probes without a match give no row.
    """
    tried = probes.select(F.col(probe_id), F.posexplode(candidates).alias("rank", "__form")).where(F.col("__form").isNotNull())
    met = tried.join(stored.select(F.col(stored_key).alias("__form"), *keep), "__form")
    best = met.groupBy(probe_id).agg(F.min(F.struct("rank", "__form", *keep)).alias("b"))
    return best.select(probe_id, F.col("b.rank").alias("rank"), F.col("b.__form").alias("form"), *[F.col(f"b.{c}").alias(c) for c in keep])


def siblings(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """For every member the first ``most`` other items of its group, in item order: ``item``, ``sibling``, ``place``.

    A group contributes its first ``most + 1`` items only, so large groups don't
    multiply; the limit is the feature.
    """
    rows = members.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    # One group's leaders are its smallest items; each task keeps only those it may need.
    order = Window.partitionBy(group).orderBy(item)
    leaders = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1)
    lists = leaders.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("__leaders"))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    met = hot_aware_join(rows, lists, group, counts, rows.count())
    others = F.slice(F.filter("__leaders", lambda x: x != F.col(item)), 1, most)
    return met.select(group, item, F.posexplode(others).alias("place", "sibling")).select(group, item, "sibling", (F.col("place") + 1).alias("place"))


def top_and_other(df: DataFrame, key: str, most: int, other: str = "Other") -> DataFrame:
    """Counts of the ``most`` commonest keys (ties by key) and of all the rest together: ``name``, ``n_rows``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    leaders = counts.orderBy(F.desc("n"), F.asc_nulls_first(key)).limit(most).select(F.col(key).alias("__k"), F.lit(True).alias("__in"))
    named = counts.join(F.broadcast(leaders), F.col(key).eqNullSafe(F.col("__k")), "left")
    name = F.when(F.col("__in"), F.coalesce(F.col(key).cast("string"), F.lit("(none)"))).otherwise(F.lit(other))
    return named.groupBy(name.alias("name")).agg(F.sum("n").alias("n_rows"))


def stratified_sample(df: DataFrame, stratum: str, item: str, n: int, seed: int) -> DataFrame:
    """``n`` items spread over the strata by their sizes, the largest stratum taking what rounding leaves over.

    Within a stratum the items with the least seeded hash are taken, so the sample
    is repeatable. With at most ``n`` rows all are taken. Null strata are one stratum.
    """
    rows = df.select(stratum, item)
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.select(F.sum("size")).scalar()
    share = F.bround(F.col("size") * F.lit(n) / total).cast("long")
    planned = sizes.select(F.col(stratum).alias("__s"), "size", F.when(total <= n, F.col("size")).otherwise(share).alias("take"))
    missing = F.when(total <= n, F.lit(0)).otherwise(F.lit(n) - planned.select(F.sum("take")).scalar())
    largest = planned.select(F.max_by(F.coalesce(F.col("__s").cast("string"), F.lit("")), F.struct(F.col("size"), F.coalesce(F.col("__s").cast("string"), F.lit(""))))).scalar()
    planned = planned.withColumn("take", F.col("take") + F.when(F.coalesce(F.col("__s").cast("string"), F.lit("")) == largest, missing).otherwise(F.lit(0)))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string"))), 1, 15)
    drawn = rows.withColumn("draw", F.conv(digits, 16, 10).cast("long")).withColumn("__part", F.conv(F.substring(digits, 1, 3), 16, 10).cast("int"))
    # Counts over 4,096 ranges of the draw tell the range in which a stratum's quota ends; items beyond it are never ranked.
    running = F.sum("n").over(Window.partitionBy(stratum).orderBy("__part"))
    ranges = drawn.groupBy(stratum, "__part").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", running).join(F.broadcast(planned), F.col(stratum).eqNullSafe(F.col("__s")))
    ends = ranges.groupBy("__s", "take").agg(F.min(F.when(F.col("upto") >= F.col("take"), F.col("__part"))).alias("__end"))
    near = drawn.join(F.broadcast(ends), F.col(stratum).eqNullSafe(F.col("__s"))).where((F.col("take") > 0) & (F.col("__end").isNull() | (F.col("__part") <= F.col("__end"))))
    placed = near.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("draw", item)))
    return placed.where(F.col("r") <= F.col("take")).select(stratum, item)


def balanced_assignment(items: DataFrame, item: str, workers: Sequence[str], per_item: int, seed: int) -> DataFrame:
    """Every item with ``per_item`` workers, all combinations of workers used equally often: ``item``, ``worker``.

    Items are numbered in the order of a seeded hash and take the combinations in turn.
    """
    from itertools import combinations

    teams = list(combinations(workers, per_item))
    table = F.array(*[F.array(*[F.lit(w) for w in team]) for team in teams])
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    drawn = items.select(item).distinct().withColumn("draw", draw).withColumn("__part", F.substring("draw", 1, 3))
    # Numbered within 4,096 ranges of the hash, after the items of the ranges before: no task numbers all items.
    sizes = drawn.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    numbered = drawn.withColumn("r", F.row_number().over(Window.partitionBy("__part").orderBy("draw", item))).join(F.broadcast(before), "__part")
    place = F.col("before") + F.col("r") - 1
    return numbered.select(item, F.explode(F.element_at(table, (place % len(teams) + 1).cast("int"))).alias("worker"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys went from each value to each other between two versions; a missing key has a null value."""
    both = before.select(key, F.col(value).alias("was")).join(after.select(key, F.col(value).alias("now")), key, "full")
    return both.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n_rows"))


def completeness(df: DataFrame) -> DataFrame:
    """One row per column: how many rows hold a value in it, all counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_present"), F.col("__n").alias("n_rows")) for c in df.columns])
    return counts.select(F.inline(pairs))


def nested_record(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``base`` with an array of structs for each of ``parts``: the part's rows of the key, in the order of their columns; empty where it has none.

    Each part is gathered by its key before it is joined, so parts never multiply one
    another. A key's rows come together in one record, which is the feature.
    """
    out = base
    for name, part in parts.items():
        held = F.struct(*[F.col(c) for c in part.columns if c != key])
        gathered = part.groupBy(key).agg(F.sort_array(F.collect_list(held)).alias(name))
        empty = F.array().cast(gathered.schema[name].dataType)
        out = out.join(gathered, key, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return out


def verdict_totals(named: DataFrame, item: str, value: str, worst: DataFrame, excluded: Column) -> DataFrame:
    """Per item: its values (``n_domains``), those with hits (``n_bad``), those of them not ``excluded`` (``n_bad_kept``), ``most_hits``. ``worst`` has a row per value."""
    bad = F.coalesce(F.col("hits") >= 1, F.lit(False))
    return named.join(worst, value, "left").groupBy(item).agg(
        F.count(F.lit(1)).alias("n_domains"), F.count_if(bad).alias("n_bad"), F.count_if(bad & ~excluded).alias("n_bad_kept"), F.max("hits").alias("most_hits")
    )


def rewritten(df: DataFrame, column: str, change: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``column`` changed and its first state kept in ``column_raw``, which later changes leave alone; :func:`restored` brings it back."""
    backup = f"{column}_raw"
    first = F.coalesce(F.col(backup), F.col(column)) if backup in df.columns else F.col(column)
    return df.withColumn(backup, first).withColumn(column, change(F.col(column)))


def restored(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as it was before the first :func:`rewritten`, and no backup."""
    backup = f"{column}_raw"
    return df.withColumn(column, F.coalesce(F.col(backup), F.col(column))).drop(backup) if backup in df.columns else df


def hot_side_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with a ``lookup`` unique on ``key``; rows without a key, or with one that ``lookup`` lacks, keep nulls.

    The keys of many rows are joined without moving their rows.
    """
    keyed = rows.where(F.col(key).isNotNull())
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    found = hot_aware_join(keyed, counts.select(key).join(lookup, key, "left"), key, counts, keyed.count())
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
