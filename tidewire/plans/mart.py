"""The reporting mart: star join, incremental publication, filtered and paged queries, options and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def star(facts: DataFrame, inner: list[tuple[DataFrame, str, str]], left: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Facts joined with dimensions: (dimension, fact column, dimension key) each. Small dimensions are broadcast by their size."""
    out = facts
    for kind, dims in (("inner", inner), ("left", left)):
        for dim, column, key in dims:
            out = out.join(dim, out[column] == dim[key], kind)
    return out


def to_publish(candidates: DataFrame, mart: DataFrame, key: str, changed: str, updated: str) -> DataFrame:
    """Rows that the mart lacks, or has from before their last change."""
    known = mart.select(F.col(key), F.col(updated).alias("_updated"), F.lit(True).alias("_known"))
    return candidates.join(known, key, "left").filter(F.col("_known").isNull() | (F.col(changed) > F.col("_updated"))).drop("_updated", "_known")


def filtered(df: DataFrame, like: dict[str, str | None] | None = None, equal: dict | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Optional filters, all of which hold: substrings in any case (``%`` and ``_`` in them are wildcards), equality, and
    inclusive bounds. None means no filter."""
    for c, v in (like or {}).items():
        if v is not None:
            df = df.filter(F.col(c).ilike(f"%{v}%"))
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if since and since[1] is not None:
        df = df.filter(F.col(since[0]) >= F.lit(since[1]))
    if until and until[1] is not None:
        df = df.filter(F.col(until[0]) <= F.lit(until[1]))
    return df


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], last: tuple | None, limit: int = 100) -> DataFrame:
    """The page that follows the row with the keys ``last`` (None: the first page): a filter that a scan can use, and a top-k of a page.

    ``keys``: columns and whether they descend; together they are unique and not null.
    """
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (c, down), value in zip(keys, last):
            beyond = beyond | (same & ((F.col(c) < F.lit(value)) if down else (F.col(c) > F.lit(value))))
            same = same & (F.col(c) == F.lit(value))
        df = df.filter(beyond)
    return df.orderBy(*order).limit(limit)


def write_ordered(df: DataFrame, order: list[Column], path: str) -> None:
    """Write ``df`` in ranges of an order, for ``page_at``; ``order`` has a unique end."""
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)


def page_at(spark: SparkSession, path: str, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page by offset, however deep, of a table of ``write_ordered``.

    The ranges are counted (from the files' footers, a row a range), and only those that hold the page are read and sorted.
    """
    table, before, here = spark.read.parquet(path), 0, []
    skipped = 0
    for r in sorted(table.groupBy("_range").count().collect()):
        if before < offset + limit and before + r["count"] > offset:
            here.append(r["_range"])
        elif before + r["count"] <= offset:
            skipped = before + r["count"]
        before += r["count"]
    return table.filter(F.col("_range").isin(here)).drop("_range").orderBy(*order).offset(offset - skipped).limit(limit)


def scoped(df: DataFrame, role: str, department, column: str = "department_id") -> DataFrame:
    """What a user may see: viewers their own department, and nothing without one; others everything."""
    if role != "viewer":
        return df
    return df.filter(F.lit(False)) if department is None else df.filter(F.col(column) == department)


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't blank, in the order of their lower case, then their own."""
    found = df.select(F.col(column).alias("value")).filter(F.btrim("value") != "").distinct()
    return found.orderBy(F.lower("value"), "value")


def feed(df: DataFrame, day: str, priority: str) -> DataFrame:
    return df.groupBy(priority, day).agg(F.count(F.lit(1)).alias("n_events"))
