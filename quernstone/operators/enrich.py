"""Enrichment by an outside client: batched, retried, broken off when the client is down, resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from quernstone.operators.records import pending

#: Pauses before each further attempt, in seconds.
PAUSES = (1.0, 5.0, 30.0)
#: Failures in a row after which a task asks no more.
MOST_FAILURES = 50


def attempted(call: Callable[[Any], dict], value: Any, pauses: Sequence[float], sleep: Callable[[float], None] = time.sleep) -> tuple[dict, str | None]:
    """The result of a call and no error, or an empty result and the last error after all attempts."""
    error = None
    for n in range(len(pauses) + 1):
        try:
            return call(value), None
        except Exception as e:  # noqa: BLE001 - whatever a client raises is a failed attempt
            error = f"{type(e).__name__}: {e}"[:200]
            if n < len(pauses):
                sleep(pauses[n])
    return {}, error


def enriched(df: DataFrame, key: str, value: str, make_client: Callable[[], Callable[[Any], dict]], fields: str, *, pauses: Sequence[float] = PAUSES, most_failures: int = MOST_FAILURES) -> DataFrame:
    """``key``, ``ok``, ``ms``, ``err`` and the ``fields`` (a ddl string) that the client gives for ``value``.

    ``make_client`` is called once per task and returns the function that is called
    per row; it must be picklable. A failed row has null fields and its error; after
    ``most_failures`` in a row the task's other rows fail at once, so that a dead
    client costs minutes, not days. Null values are not asked for and give no row.
    """
    names = [f.split()[0].strip("`") for f in fields.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, failures = make_client(), 0
        for batch in batches:
            rows = []
            for k, v in zip(batch[key], batch[value]):
                began = time.time()
                if failures >= most_failures:
                    result, error = {}, "the client has failed too often"
                else:
                    result, error = attempted(call, v, pauses)
                    failures = failures + 1 if error else 0
                rows.append({key: k, "ok": error is None, "ms": int((time.time() - began) * 1000), "err": error, **{n: result.get(n) for n in names}})
            yield pd.DataFrame(rows, columns=[key, "ok", "ms", "err", *names])

    kind = df.schema[key].dataType.simpleString()
    asked = df.select(key, value).where(df[value].isNotNull())
    return asked.mapInPandas(work, f"`{key}` {kind}, ok boolean, ms int, err string, {fields}")


def resumed(df: DataFrame, key: str, value: str, path: str, schema: str, make_client: Callable[[], Callable[[Any], dict]], fields: str, **options) -> int:
    """Ask for the keys that the json lines at ``path`` don't have an ok row for, and append what comes; the number asked for."""
    from quernstone.sources.files import append_jsonl, read_jsonl

    spark = df.sparkSession
    done = read_jsonl(spark, path, schema).where("ok")
    todo = pending(df.select(key, value).where(df[value].isNotNull()).dropDuplicates([key]), done, key)
    n = todo.count()
    if n:
        append_jsonl(enriched(todo, key, value, make_client, fields, **options), path)
    return n
