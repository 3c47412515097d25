"""A commit log for tables that several writers append to: what a batch wrote counts from the moment its commit stands.

Each attempt writes to a folder of its own, named by a fresh id, so writers never read or list each other's files. A commit is
one small file named by the batch, moved into place by a rename that fails if the name is taken: a batch is committed once,
whoever repeats it, and an attempt that died leaves files that nothing reads.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError


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


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def attempts(spark: SparkSession, path: str) -> dict[str, str]:
    """The committed batches of a log and the attempt that each stands for: one small file a batch."""
    place, system = _system(spark, f"{path}/_commits")
    if not system.exists(place):
        return {}
    out = {}
    for status in system.listStatus(place):
        batch, _, attempt = status.getPath().getName().rpartition("@")
        if batch:
            out[batch] = attempt
    return out


def committed(spark: SparkSession, path: str, batch: str) -> str | None:
    return attempts(spark, path).get(batch)


def commit(spark: SparkSession, path: str, batch: str, attempt: str) -> bool:
    """Commit an attempt as ``batch``; False if the batch stands already, by whichever attempt.

    The name of the batch is claimed by a folder-free rename without overwriting; the attempt is part of the file that then shows it.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    claim, _ = _system(spark, f"{path}/_claims/{batch}")
    mine, system = _system(spark, f"{path}/_claims/.{attempt}")
    system.mkdirs(claim.getParent())
    out = system.create(mine, True)
    out.write(bytearray(attempt.encode()))
    out.close()
    context = fs.FileContext.getFileContext(mine.toUri(), spark._jsc.hadoopConfiguration())
    options = gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.NONE
    try:
        context.rename(system.makeQualified(mine), system.makeQualified(claim), options)
    except (Py4JJavaError, CapturedException):
        if not system.exists(claim):
            raise
        system.delete(mine, False)
        owner = _text(spark, f"{path}/_claims/{batch}")
    else:
        owner = attempt
    shown, _ = _system(spark, f"{path}/_commits/{batch}@{owner}")  # also where the claimer died before it showed its claim
    system.mkdirs(shown.getParent())
    system.create(shown, True).close()
    return owner == attempt


def _text(spark: SparkSession, path: str) -> str:
    place, system = _system(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def append(df: DataFrame, path: str, batch: str) -> bool:
    """Append ``df`` (as Parquet) under the log as ``batch``; nothing happens if the batch stands already."""
    spark = df.sparkSession
    if committed(spark, path, batch):
        return False
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/attempt={attempt}")
    return commit(spark, path, batch, attempt)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the committed batches of a log hold; without any, an empty table."""
    places = [f"{path}/attempt={a}" for a in sorted(attempts(spark, path).values())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
