"""Per-key results over the skewed ``campaigns.platform``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.skew import heavy_keys, per_key_state
from quernstone.sources.tables import table

#: Share of all rows from which a platform is reported.
HEAVY_SHARE = 0.05


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return heavy_keys(table(spark, root, "campaigns", "platform"), "platform", HEAVY_SHARE)


def p3_platform_state(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "platform", "ingest_seq", "url", "donors_count", "description_word_count", "ingested_at")
    sums = {"donors": F.col("donors_count").cast("long"), "words": F.col("description_word_count").cast("long")}
    return per_key_state(rows, "platform", sums, latest_by=("ingested_at", "ingest_seq"), latest=("ingest_seq", "url"))


QUERIES = {"p3_found": p3_found, "p3_platform_state": p3_platform_state}

SQL = {
    "p3_found": """
        SELECT platform FROM campaigns WHERE platform IS NOT NULL
        GROUP BY platform HAVING count(*) >= 0.05 * (SELECT count(*) FROM campaigns)
    """,
    "p3_platform_state": """
        WITH ranked AS (
          SELECT platform, donors_count, description_word_count, ingest_seq, url,
            row_number() OVER (PARTITION BY platform ORDER BY ingested_at DESC NULLS LAST, ingest_seq DESC) AS r
          FROM campaigns
        )
        SELECT platform, count(*) AS n_rows, CAST(coalesce(sum(donors_count), 0) AS BIGINT) AS donors,
          CAST(coalesce(sum(description_word_count), 0) AS BIGINT) AS words,
          max(CASE WHEN r = 1 THEN ingest_seq END) AS latest_ingest_seq, max(CASE WHEN r = 1 THEN url END) AS latest_url
        FROM ranked GROUP BY platform
    """,
}
