"""Loads that appear whole or not at all.

A load writes its tables aside, each below ``<root>/<table>/load=<id>``, and then adds a
manifest, one small file, that names for every day the loads to read.  Readers take the
manifest with the highest number and open the folders it names, so a load that fails half
way leaves nothing to see, and one that replaces days swaps them in one step.  Two loads
at once cannot both add the same number: the second fails and may be repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partition of rows whose day is null, as Spark names its folder.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_FOLDER, _DIGITS = "_manifest", 12


class LoadConflict(RuntimeError):
    """Another load was published since this one began; repeat it."""


@dataclass(frozen=True)
class Manifest:
    """What is published: ``days`` maps a day to the loads that hold it, oldest first,
    each with what is known of its rows; ``lasting`` are loads of tables without days."""

    number: int = 0
    days: Mapping[str, tuple[dict, ...]] = field(default_factory=dict)
    lasting: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(root: str, *names: str) -> str:
    return "/".join([root.rstrip("/"), *names])


def manifest(spark: SparkSession, root: str) -> Manifest:
    """The manifest in force, an empty one for a folder nothing was published in."""
    folder, files = _files(spark, _path(root, _FOLDER))
    if not files.exists(folder):
        return Manifest()
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = [int(name.removesuffix(".json")) for name in names if name[:1].isdigit()]
    return _numbered(spark, root, max(numbers)) if numbers else Manifest()


def _numbered(spark: SparkSession, root: str, number: int) -> Manifest:
    path, files = _files(spark, _path(root, _FOLDER, f"{number:0{_DIGITS}}.json"))
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    days = {day: tuple(loads) for day, loads in found["days"].items()}
    return Manifest(number, days, {name: tuple(ids) for name, ids in found["lasting"].items()})


def _add(spark: SparkSession, root: str, added: Manifest) -> None:
    """Write a manifest aside and give it its name, unless that name is taken."""
    name = f"{added.number:0{_DIGITS}}.json"
    aside, files = _files(spark, _path(root, _FOLDER, f".{uuid.uuid4().hex}"))
    target, _ = _files(spark, _path(root, _FOLDER, name))
    text = json.dumps({"days": added.days, "lasting": added.lasting}, sort_keys=True)
    stream = files.create(aside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    kept = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    kept[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(
        files.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), kept)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise LoadConflict(f"{root}: manifest {added.number} is there already") from None
        raise


def new_load() -> str:
    return uuid.uuid4().hex


def staged_path(root: str, table: str, load: str) -> str:
    """Where a load writes a table; nobody reads there before the load is published."""
    return _path(root, table, f"load={load}")


def publish(
    spark: SparkSession,
    root: str,
    load: str,
    days: Mapping[str, dict],
    began: Manifest,
    lasting: Iterable[str] = (),
    replace: bool = False,
) -> Manifest:
    """Make a staged load visible: its ``days``, each with what is known of it.

    ``began`` is the manifest the load started from.  With ``replace`` the days found in
    the load are read from it alone; otherwise it adds to them.  ``lasting`` names tables
    whose part of this load stays whatever happens to its days.
    """
    parts = dict(began.days)
    for day, known in days.items():
        before = () if replace else parts.get(day, ())
        parts[day] = (*before, {"load": load, **known})
    kept = {name: began.lasting.get(name, ()) for name in {*began.lasting, *lasting}}
    kept |= {name: (*kept[name], load) for name in lasting}
    added = Manifest(began.number + 1, parts, kept)
    _add(spark, root, added)
    return added


def discard(spark: SparkSession, root: str, load: str, tables: Iterable[str]) -> None:
    """Remove what a load that failed has written aside."""
    for table in tables:
        path, files = _files(spark, staged_path(root, table, load))
        files.delete(path, True)


def read_days(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    partitions: tuple[str, ...],
    since: date | None = None,
    until: date | None = None,
    only: Iterable[date] | None = None,
    published: Manifest | None = None,
    counted: str | None = None,
) -> DataFrame:
    """A published table; ``partitions`` are the folders of a load, the day's first.

    Only the folders of the days asked for are listed: ``since`` and ``until`` are the first
    and last, ``only`` names single ones.  Rows without a day come unless days are named.
    ``counted`` is what loads noted of a table that they do not write for every day.
    """
    published = published or manifest(spark, root)
    wanted = None if only is None else {day.isoformat() for day in only}
    folders = []
    for day, loads in sorted(published.days.items()):
        if wanted is not None and day not in wanted:
            continue
        if day == NO_DAY and (since or until):
            continue
        if day != NO_DAY and (since and day < since.isoformat() or until and day > until.isoformat()):
            continue
        folders += [
            f"{staged_path(root, table, known['load'])}/{partitions[0]}={day}"
            for known in loads
            if counted is None or known[counted]
        ]
    return _read(spark, root, table, schema, folders)


def read_lasting(
    spark: SparkSession, root: str, table: str, schema: T.StructType, published: Manifest
) -> DataFrame:
    """A table without days: the parts of all loads that added to it."""
    folders = [staged_path(root, table, load) for load in published.lasting.get(table, ())]
    return _read(spark, root, table, schema, folders)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def _read(
    spark: SparkSession, root: str, table: str, schema: T.StructType, folders: list[str]
) -> DataFrame:
    if not folders:
        return empty(spark, schema)
    reader = spark.read.schema(schema).option("basePath", _path(root, table))
    return reader.parquet(*folders).select(*schema.names)


def clean(spark: SparkSession, root: str, tables: Iterable[str], keep: int = 1) -> list[str]:
    """Delete loads that none of the last ``keep`` manifests names; returns their ids.

    Run it when no load is being written: one that is staged but not published goes too.
    """
    last = manifest(spark, root)
    named = [_numbered(spark, root, n) for n in range(max(1, last.number - keep + 1), last.number + 1)]
    of_days = {known["load"] for m in named for loads in m.days.values() for known in loads}
    gone: set[str] = set()
    for table in tables:
        lasting = {load for m in named for load in m.lasting.get(table, ())}
        live = lasting if table in last.lasting else of_days
        folder, files = _files(spark, _path(root, table))
        if not files.exists(folder):
            continue
        for status in files.listStatus(folder):
            load = status.getPath().getName().removeprefix("load=")
            if load not in live:
                files.delete(status.getPath(), True)
                gone.add(load)
    return sorted(gone)
