"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one in the warehouse where that is unset.

    A folder that is named counts as shared, whatever its scheme. A warehouse on a local
    disk is refused where executors may be on other machines: each would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not on_one_machine(spark.sparkContext.master) and is_local(warehouse, _default_scheme(spark)):
        raise ValueError(
            f"intermediate tables cannot go to {warehouse}, which executors of {spark.sparkContext.master} "
            "do not share; set spark.checkpoint.dir to a folder that they do"
        )
    return f"{warehouse.rstrip('/')}/intermediate"


def _default_scheme(spark: SparkSession) -> str:
    context = spark.sparkContext
    return context._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(context._jsc.hadoopConfiguration()).getScheme()


def is_local(path: str, default_scheme: str) -> bool:
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else default_scheme
    return scheme == "file"


def on_one_machine(master: str) -> bool:
    """Whether the driver's machine holds all executors: threads of the driver, or a test cluster."""
    return master == "local" or master.startswith(("local[", "local-cluster["))


class Scratch:
    """Tables that a computation writes for itself and removes when it ends or fails.

    ``write`` computes a table once and gives it back as a scan of the written files,
    so a lost executor costs a read and not the work before it. ``remove`` deletes
    tables that are no longer read; leaving the ``with`` block deletes the rest.
    Results that are read later, outside the block, are written by ``materialise``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        table, path = _write(df)
        self.paths[id(table)] = (table, path)
        return table

    def remove(self, *tables: DataFrame) -> None:
        for table in tables:
            if id(table) in self.paths:
                _delete(self.spark, self.paths.pop(id(table))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths.values():
            _delete(self.spark, path)
        self.paths.clear()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from the shared folder afterwards.

    The files lie in a folder named after the application. It is removed by ``release``,
    or else when the driver's JVM ends.
    """
    return _write(df)[0]


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application; DataFrames that read them end with them."""
    _STORES.pop(spark.sparkContext.applicationId, None)
    _delete(spark, _folder(spark))


# --- tables by what they are computed from ---------------------------------------------


@dataclass
class _Stored:
    sources: tuple[DataFrame, ...]
    files: tuple
    table: DataFrame


@dataclass
class Store:
    """Tables that several queries of an application share.

    A table is known by its sources' plans (same relations, expressions and constants), by
    the step that makes it, settings included, and by the input files as they are at that
    time, by name, length and time of change; so inputs that were written again give a new table.
    """

    known: dict[tuple, list[_Stored]] = field(default_factory=dict)

    def get(self, sources: Sequence[DataFrame], step: str, build: Callable[[], DataFrame]) -> DataFrame:
        files = input_files(sources)
        same = self.known.setdefault((step, *[s.semanticHash() for s in sources]), [])
        for entry in same:
            if entry.files == files and all(map(DataFrame.sameSemantics, entry.sources, sources)):
                return entry.table
        table = materialise(build())
        same.append(_Stored(tuple(sources), files, table))
        return table


_STORES: dict[str, Store] = {}


def store(spark: SparkSession) -> Store:
    """The application's store."""
    return _STORES.setdefault(spark.sparkContext.applicationId, Store())


def input_files(sources: Sequence[DataFrame]) -> tuple:
    """Number and checksum of the files that are read. They are listed by Spark and not opened."""
    names = sorted({name for source in sources for name in source.inputFiles()})
    if not names:
        return ()
    listed = sources[0].sparkSession.read.format("binaryFile").load(names).select("path", "modificationTime", "length")
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)")
    found = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("sum")).first()
    return found["n"], found["sum"]


# --- files -------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession) -> str:
    """A path for tables of the application, shared by its executors and removed with the others."""
    system, place = _place(spark, _folder(spark))
    system.mkdirs(place)
    system.deleteOnExit(place)
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)
