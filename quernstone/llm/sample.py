"""Bounded samples for fitting classifiers; nothing else is ever sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def hashed_sample(df: DataFrame, by: Column, total: int, most: int) -> DataFrame:
    """At most ``most`` of about ``total`` rows: those with the least hash of ``by``, so the same rows give the same sample.

    Where there are more, a hash threshold first leaves about twice as many as are
    wanted, so that not every partition sends ``most`` rows to the driver.
    """
    h = F.pmod(F.xxhash64(by), F.lit(_RANGE))
    rows = df.withColumn("__h", h)
    if total > 2 * most:
        rows = rows.where(F.col("__h") < int(_RANGE * 2 * most / total))
    return rows.orderBy("__h").limit(most).drop("__h")
