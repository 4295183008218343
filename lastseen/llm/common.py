"""Scratch tables and text conventions the corpus operators share."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words, as given by the contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Mark-up characters of the quality contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a plain local session without one, as in tests, gets a temporary
    folder; executors of a cluster would not see it, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or (
            spark.sparkContext.master.startswith("local-cluster")
        ):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lastseen-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once in an application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves the file to the executors until the application ends.
    folder = tempfile.mkdtemp(prefix="lastseen-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lastseen_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


def shipped(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Mark a query or stage whose first argument is the session as using workers."""

    @functools.wraps(build)
    def run(spark: SparkSession, *arguments, **options) -> DataFrame:
        ship(spark)
        return build(spark, *arguments, **options)

    return run


#: Rows that a worker is handed at once, each with one text or two sets of a text.
HANDED_ROWS = 500
_HANDED = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def handing_few_rows(spark: SparkSession, rows: int = HANDED_ROWS) -> Iterator[None]:
    """Bound what one task holds outside the heap, in Spark's buffers and in its worker.

    Spark hands over 10,000 rows at once, which for pairs of texts of 1,000 words is 160 MB
    in each.
    """
    before = spark.conf.get(_HANDED)
    spark.conf.set(_HANDED, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_HANDED, before)


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop a job's shuffle files as soon as its result is stored.

    A concurrent job of the same session that ends meanwhile loses its files
    too; it would recompute them if it needed them again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: later jobs read the files, also after executors are lost,
    and the shuffle files that led to them are freed.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    with _freeing_shuffles(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without any."""
    trimmed = F.btrim(text, F.lit(SPACES))
    found = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(found)


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(words_of(text)).cast("long")


def symbol_count(text: Column) -> Column:
    """Number of characters that belong to mark-up rather than to prose."""
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
