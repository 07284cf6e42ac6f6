"""Queries that run a stream over the event log to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.base import Registry
from quernstone.streaming import arrivals as A

query = Registry()


def _events(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/events.parquet"
    # Watermarks need an instant; the log's times are UTC, as the session is.
    return A.stream_of(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_rates(spark: SparkSession, root: str) -> DataFrame:
    return A.drained(A.rates(_events(spark, root), "user_id", "ts", "value"), "complete", "rates").withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT event_id FROM events WHERE event_id IS NOT NULL")
def stream_first_arrivals(spark: SparkSession, root: str) -> DataFrame:
    return A.drained(A.first_arrivals(_events(spark, root), "event_id", "ts", "3650 days").select("event_id"), "append", "arrivals")


QUERIES, SQL = query.queries, query.sql
