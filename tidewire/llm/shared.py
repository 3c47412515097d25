"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (space, tab, newline, vertical tab, form feed, carriage return).
WHITE = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    for tables in _recorders:
        tables.append(out)
    return out


_recorders: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded(tables: list[DataFrame]) -> Iterator[None]:
    """What ``saved`` writes meanwhile is added to ``tables``, for whoever knows when nothing reads it any more."""
    _recorders.append(tables)
    try:
        yield
    finally:
        _recorders[:] = [t for t in _recorders if t is not tables]  # this list itself: an outer one may hold the same tables, and be equal


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it has written on the way are deleted."""
    with recorded(tables := []):
        made = make()
    out = saved(made, name)
    for table in tables:
        forget(table)
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what ``saved`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_tidewire_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)) == "", F.lit(0)).otherwise(F.size(words(text))).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
