"""Cutting lineage through tables written to the shared checkpoint folder.

Iterative operators must not grow one plan for ever and must survive the loss of
executors, so each round is written as a table in the folder that the session
names in ``spark.checkpoint.dir``. Only where that is unset (local tests) is a
folder of our own made. ``localCheckpoint`` is never used.

Shuffle files of a saved plan are removed as soon as its table is written, and the
tables themselves when the application ends, or before that by :func:`clean`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, taken from the session where it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_quernstone_scratch", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark._quernstone_scratch = own
    return own


#: Removes the shuffle files of a plan when its execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one operator run, each under its own path in the shared folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._next = 0
        path, files = _file_system(spark, self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark._quernstone_roots = [*getattr(spark, "_quernstone_roots", []), self.root]

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read back, with a fresh lineage."""
        path = f"{self.root}/{self._next}"
        self._next += 1
        schema = df.schema
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        saved = self.spark.read.schema(schema).parquet(path)
        saved._quernstone_path = path
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Delete a table of :meth:`save` that no later plan reads."""
        path, files = _file_system(self.spark, saved._quernstone_path)
        files.delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this session's operators have written; results not yet read or written are lost."""
    for root in getattr(spark, "_quernstone_roots", []):
        path, files = _file_system(spark, root)
        files.delete(path, True)
    spark._quernstone_roots = []
