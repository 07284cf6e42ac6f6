"""Group identifiers over pairwise matches: minimum labels with pointer jumping.

Matches come as memberships (item, tie): items under one tie are linked, which
carries any match graph without spelling out all pairs inside a tie. Each round
every item takes the least label met under its ties, hands it to the item that
its own label names, and then jumps to its label's label; the round's labels are
written to the shared checkpoint folder. No label is ever collected.

Rows of a tie, or of an item, with more than its share of all rows are spread over
salts, and the small side of each join is repeated once per salt, so no task
meets all rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.scratch import Scratch
from quernstone.operators.skew import HOT_SHARE, hot_aware_join

#: Keys with fewer rows are never salted.
LEAST_HOT = 20_000
#: Most salts of one key.
MOST_SALTS = 64


def whole_number(text: Column) -> Column:
    """The whole number that a text denotes, in canonical digits; null for any other text.

    Surrounding white space, leading zeros, a plus sign, a fraction of zeros and
    exponents are ways of writing the same number: `` 7``, ``007``, ``7.0``, ``7e0``.
    """
    x = F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")
    plain = F.regexp_extract(x, r"^[+-]?0*([0-9]+)(?:\.0*)?$", 1)
    power = F.when(x.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]{1,2}$"), x.try_cast("decimal(38,6)"))
    digits = F.when(plain != "", plain).otherwise(F.when(power % 1 == 0, F.abs(power).cast("decimal(38,0)").cast("string")))
    return F.when(digits == "0", digits).otherwise(F.concat(F.when(x.startswith("-"), F.lit("-")).otherwise(F.lit("")), digits))


def _salts(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, number of salts) of the keys with more than 1/HOT_SHARE of all rows: at most HOT_SHARE of them."""
    floor = max(LEAST_HOT, total // HOT_SHARE)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    return counted.select(key, F.least(F.lit(MOST_SALTS), F.ceil(F.col("n") / F.lit(floor))).cast("int").alias(f"{key}_salts"))


def _salted(rows: DataFrame, salts: DataFrame, key: str, other: str) -> DataFrame:
    """Rows with a salt column for ``key``; the broadcast side has at most HOT_SHARE rows."""
    return rows.join(F.broadcast(salts), key, "left").withColumn(f"{key}_salt", F.when(F.col(f"{key}_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(other), F.col(f"{key}_salts")).cast("int"))).drop(f"{key}_salts")


def _spread(lookup: DataFrame, key: str, top: str) -> DataFrame:
    """``lookup`` repeated for each salt from 0 to its ``top``."""
    return lookup.withColumn(f"{key}_salt", F.explode(F.sequence(F.lit(0), F.col(top)))).drop(top)


def least_labels(tied: DataFrame, scratch: Scratch, rounds: int) -> DataFrame:
    """(``v``, ``l``) for every ``v`` of the written table ``tied`` (``v`` long, ``tie``): the least ``v`` of its group."""
    total = tied.count()
    by_tie, by_item = _salts(tied, "tie", total), _salts(tied, "v", total)
    edges = scratch.save(_salted(_salted(tied, by_tie, "tie", "v"), by_item, "v", "tie"))
    tops = edges.groupBy("v").agg(F.max("v_salt").alias("v_top"))
    labels = scratch.save(tops.select("v", F.col("v").alias("l"), "v_top"))
    n_items = labels.count()
    for _ in range(rounds):
        labelled = edges.join(_spread(labels, "v", "v_top"), ["v", "v_salt"]).select("v", "tie", "tie_salt", "l")
        least = labelled.groupBy("tie").agg(F.min("l").alias("m"), F.max("tie_salt").alias("top"))
        offers = labelled.join(_spread(least, "tie", "top"), ["tie", "tie_salt"]).where("m < l").select("v", "l", "m")
        best = offers.select("v", "m").unionByName(offers.select(F.col("l").alias("v"), "m")).groupBy("v").agg(F.min("m").alias("m"))
        hooked = scratch.save(labels.join(best, "v", "left").select("v", F.least("l", "m").alias("l"), F.col("l").alias("was"), "v_top"))
        pointing = hooked.where("l <> v")
        onward = hooked.select(F.col("v").alias("l"), F.col("l").alias("next"))
        per_label = pointing.groupBy("l").agg(F.count(F.lit(1)).alias("n_rows"))
        moved = hot_aware_join(pointing, onward, "l", per_label, n_items).select("v", F.least("l", "next").alias("l"), "was", "v_top")
        jumped = scratch.save(hooked.where("l = v").unionByName(moved))
        changed = jumped.where("l <> was").limit(1).count()
        scratch.drop(hooked)
        scratch.drop(labels)
        labels = jumped.select("v", "l", "v_top")
        labels._quernstone_path = jumped._quernstone_path
        if not changed:
            scratch.drop(edges)
            return labels.select("v", "l")
    raise RuntimeError(f"labels still change after {rounds} rounds")


def connected_groups(memberships: DataFrame, item: str, tie: str, *, most_rounds: int = 60, label: str = "components") -> DataFrame:
    """One row per item: ``item``, ``group`` (the least item of its group), ``group_size``.

    Items sharing a tie are linked, directly or through others. A null item is
    ignored; an item whose ties are all null is a group of its own; repeated rows
    change nothing; further columns are ignored; no rows give no rows. Items are
    compared as written, in code-point order. Raises if labels still change after
    ``most_rounds`` rounds.
    """
    spark = memberships.sparkSession
    scratch = Scratch(spark, label)
    rows = memberships.select(F.col(item).alias("item"), F.col(tie).cast("string").alias("tie")).where(F.col("item").isNotNull()).distinct()
    rows = scratch.save(rows)
    # Written before they are used: identifiers made from positions must not be made twice.
    items = scratch.save(rows.select("item").distinct().withColumn("v", F.monotonically_increasing_id()))
    tied = scratch.save(rows.where(F.col("tie").isNotNull()).join(items, "item").select("v", "tie"))
    scratch.drop(rows)
    labels = least_labels(tied, scratch, most_rounds)
    placed = scratch.save(items.join(labels, "v", "left").select("item", F.coalesce("l", "v").alias("l")))
    groups = scratch.save(placed.groupBy("l").agg(F.min("item").alias("group"), F.count(F.lit(1)).alias("n_rows")))
    lookup = groups.select("l", "group", F.col("n_rows").alias("group_size"))
    return hot_aware_join(placed, lookup, "l", groups.select("l", "n_rows"), placed.count()).select("item", "group", "group_size")
