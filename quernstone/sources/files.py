"""File sources and sinks of the pipeline: tolerant readers, keyed indexes, text lists, archives, resumable outputs."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.records import last_wins


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *columns: str) -> DataFrame:
    """A csv with a header, cells of any length and line breaks in quotes; gzip by its extension. ``columns`` narrows the scan."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE", enforceSchema=False)
    return df.select(*columns) if columns else df


def read_csv_index(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """The last row of every key of a csv; an empty table where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = read_csv(spark, path, schema)
    # Position in the file is the load order; one csv with quoted line breaks is read by one task.
    return last_wins(rows.withColumn("__order", F.monotonically_increasing_id()), key, "__order").drop("__order")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Json lines, malformed ones dropped; an empty table where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_list(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """The trimmed lines of a text, blank ones and comments dropped: ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith(comment))


def read_zipped_json(spark: SparkSession, path: str, schema: T.StructType | str, skip: str = "progress") -> DataFrame:
    """Every record of the json members of zip archives; members named like ``skip`` are left out.

    A member holds one object or a list of them. Archives are opened where they are
    read, one at a time; members that are no json give no record.
    """

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            lines: list[str] = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.endswith(".json") or skip in name:
                            continue
                        try:
                            found = json.loads(archive.read(name))
                        except ValueError:
                            continue
                        lines += [json.dumps(x) for x in (found if isinstance(found, list) else [found])]
            yield pd.DataFrame({"line": lines})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Csv parts with a header and fixed column order; arrays must have been joined to text."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    """Further json-line parts beside those already written."""
    df.write.mode("append").json(path)


def write_list(df: DataFrame, value: str, path: str) -> None:
    """The distinct values, sorted, as text parts in order."""
    df.select(F.col(value).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").write.mode("overwrite").text(path)


def swapped_in(df: DataFrame, path: str, backup: str) -> None:
    """Replace the table at ``path``, which ``df`` may read, keeping the first version ever replaced at ``backup``.

    The new version is complete beside the old one before anything is renamed.
    """
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(new)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        if files.exists(at(backup)):
            files.delete(at(path), True)
        else:
            files.rename(at(path), at(backup))
    files.rename(at(new), at(path))


def with_paths(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set nested fields named by dotted paths, making the structs on the way that don't exist."""
    for path, value in values.items():
        head, _, rest = path.partition(".")
        if not rest:
            df = df.withColumn(head, value)
        elif head in df.columns:
            df = df.withColumn(head, F.col(head).withField(rest, value))
        else:
            for part in reversed(rest.split(".")):
                value = F.struct(value.alias(part))
            df = df.withColumn(head, value)
    return df


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, n_rows`` of several tables, for a run's summary."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
