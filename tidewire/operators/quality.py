"""The data-quality gate: one report row for each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the expected volume below which a batch gets a warning.
VOLUME_SHARE = 0.8


def schema_errors(required: list[str]) -> Column:
    """Missing required fields of a row."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == "", 1).otherwise(0) for c in required])


def business_errors(least: dict[str, int]) -> Column:
    """Fields with a value shorter than allowed."""
    return reduce(lambda a, b: a + b, [F.when(F.length(c) < n, 1).otherwise(0) for c, n in least.items()])


def duplicates(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """Second and later rows of a key, null keys aside."""
    from tidewire.operators.rows import numbered

    keyed = df.withColumn("key", key).filter(F.col("key").isNotNull())
    return numbered(keyed, ["key"], [F.col(id_)], "nth").filter("nth > 1")


def report(df: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """(level, errors, rows, passed, passed_count) for each level, of errors a row, in one pass over ``df``.

    ``passed_count`` is rows less errors, errors and not rows being counted.
    """
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(e), F.lit(0)).alias(k) for k, e in levels.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).cast("long").alias("errors")) for k in levels])
    return totals.select("rows", F.explode(rows).alias("x")).select("x.level", "x.errors", "rows", (F.col("x.errors") == 0).alias("passed"), (F.col("rows") - F.col("x.errors")).alias("passed_count"))


def volume_passed(current: Column, expected: Column) -> Column:
    return F.when(expected > 0, current / expected >= VOLUME_SHARE).otherwise(True)
