"""Operators that pick, number and compare rows of a key over time. Every order has a unique end, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark cuts each partition to n a key before it shuffles."""
    rn = free_name(df, "rn")
    return numbered(df, keys, order, rn).filter(F.col(rn) <= n).drop(rn)


def change_status(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """``status``: new, changed or unchanged against the row before."""
    over = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(over)
    return df.withColumn("status", F.when(F.row_number().over(over) == 1, "new").when(before == value, "unchanged").otherwise("changed"))


def streaks(df: DataFrame, keys: list[str], order: list[Column], failed: Column, limit: int = 3) -> DataFrame:
    """``streak``: failures in a row up to each row, 0 after a success; ``disabled`` from ``limit`` on."""
    over, bad, island = W.partitionBy(*keys).orderBy(*order), free_name(df, "failed"), free_name(df, "island")
    marked = df.withColumn(bad, failed).withColumn(island, F.sum(F.when(F.col(bad), 0).otherwise(1)).over(over))
    run = W.partitionBy(*keys, island).orderBy(*order)
    streak = F.when(F.col(bad), F.sum(F.when(F.col(bad), 1).otherwise(0)).over(run)).otherwise(0)
    return marked.withColumn("streak", streak).withColumn("disabled", F.col("streak") >= limit).drop(bad, island)


def limited(df: DataFrame, key: str, most: int, since, time: str = "created_at", id_: str = "id") -> DataFrame:
    """One limit rule: of the ``ok`` rows of a key since a time, those beyond the newest ``most`` are rejected.

    Spark keeps ``most`` eligible rows of a key in each partition before it shuffles, and only these, by their ids, meet the
    table again; a key with very many rows doesn't meet in one task. Ids are unique; rows with a null key are one group.
    """
    kept, over, ok = free_name(df, "kept"), free_name(df, "over"), (F.col("status") == "ok") & (F.col(time) >= since)
    newest_rows = newest(df.filter(ok).select(key, time, id_), [key], [F.desc(time), F.desc(id_)], most).select(F.col(id_), F.lit(True).alias(kept))
    out = df.join(newest_rows, id_, "left").withColumn(over, F.coalesce(ok, F.lit(False)) & F.col(kept).isNull())
    status, reason = F.when(F.col(over), "rejected").otherwise(F.col("status")), F.when(F.col(over), "noise_limit").otherwise(F.col("reject_reason"))
    return out.withColumn("reject_reason", reason).withColumn("status", status).select(*df.columns)


def window_start(window: str, now: Column, run_started: Column) -> Column:
    """Since when a limit counts: the start of the run, a day ago, or a week ago."""
    days = {"day": 1, "week": 7}
    if window != "run" and window not in days:
        raise ValueError(f"a limit's window is run, day or week, not {window}")
    return run_started if window == "run" else now - F.expr(f"interval {days[window]} days")


def over_limits(df: DataFrame, limits: list[tuple[str, str, int]], now: Column, run_started: Column) -> DataFrame:
    """``limited`` by each rule (column, window, most) in turn: a later rule counts what the earlier ones have left."""
    for key, window, most in limits:
        df = limited(df, key, most, window_start(window, now, run_started))
    return df


def insert_ignore(new: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` that are really inserted: the first of each key that isn't stored yet."""
    return newest(new, keys, order).join(stored.select(*keys), keys, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with their keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def patched(stored: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` from the row of ``patch`` with its key, where there is one."""
    if not columns:
        raise ValueError("a patch needs columns")
    new = free_name(stored, "patch")
    named = patch.select(F.col(key), F.struct(*columns).alias(new))
    out = stored.join(named, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col(new).isNotNull(), F.col(new)[c]).otherwise(F.col(c)))
    return out.drop(new)


def orphans(df: DataFrame, column: str, dim: DataFrame, key: str = "id") -> DataFrame:
    """Rows that refer to nothing: a report to look at before a write."""
    return df.filter(F.col(column).isNotNull()).join(dim.select(F.col(key).alias(column)), column, "left_anti")


def matrix(left: DataFrame, right: DataFrame, stored: DataFrame) -> DataFrame:
    """All pairs of two dimensions that aren't stored yet. A pair of whole dimensions is the feature here: the task matrix."""
    pairs = left.crossJoin(right)
    return pairs.join(stored.select(*pairs.columns), pairs.columns, "left_anti")
