"""Tables that are merged into: new rows replace those with their keys, and only the parts that they touch are written again.

Rows lie in buckets by a hash of their keys, each a partition of the table. A merge reads and writes the buckets of the new rows
alone (Spark's dynamic partition overwrite moves them into place when the job commits); the files of all others keep their names.
A merge of the same rows again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.rows import free_name, newest
from tidewire.sources.commits import fresh_folder

#: Buckets of a table, unless it is made with others: as many as keep a bucket at some hundred megabytes. A table keeps its number.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table, without the column of its buckets."""
    return spark.read.parquet(path).drop("_bucket")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge(new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, buckets: int = BUCKETS, newer: str | None = None) -> list[int]:
    """Merge ``new`` into the table at ``path``; returns the buckets that were written.

    Of new rows with equal keys the first in ``order`` counts (all columns, where there is none). ``newer``: a column by which a new
    row replaces a stored one only if it is greater; a row that isn't touches nothing, so that a repeated run writes no file.
    """
    spark = new.sparkSession
    ordered = order or [F.asc(c) for c in new.columns if c not in keys]
    staged = fresh_folder(spark, "merge")
    first = newest(new, keys, ordered) if ordered else new.dropDuplicates(keys)
    first.withColumn("_bucket", _bucket(keys, buckets)).write.parquet(staged)  # once: its buckets are asked for before it is merged
    coming = spark.read.parquet(staged)
    here = exists(spark, path)
    stored = spark.read.parquet(path) if here else coming.limit(0)
    if newer and here:
        seen = free_name(coming, "seen")
        before = stored.select("_bucket", *keys, F.col(newer).alias(seen))
        coming = coming.join(before, ["_bucket", *keys], "left").filter(F.col(seen).isNull() | (F.col(newer) > F.col(seen))).drop(seen)
    touched = sorted(r[0] for r in coming.select("_bucket").distinct().collect())  # ``buckets`` at most
    if not touched:
        return []
    kept = stored.filter(F.col("_bucket").isin(touched)).join(coming.select("_bucket", *keys), ["_bucket", *keys], "left_anti")
    out = kept.unionByName(coming).repartition("_bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return touched
