"""Summaries of runs and stages, and the merge of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The reason of an empty snapshot that names none.
NO_REASON = "empty_items"


def input_summary(raw: DataFrame) -> DataFrame:
    """(kind, name, n): items in all, empty snapshots, and those by reason, of (raw_data) snapshots."""
    size = F.coalesce(F.size("raw_data.items"), F.lit(0))
    size = F.when(size < 0, 0).otherwise(size)
    reason = F.coalesce("raw_data.meta.empty_reason", F.lit(NO_REASON))
    seen = raw.select(size.alias("n"), F.when(size == 0, reason).alias("reason"))
    totals = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.count_if(F.col("n") == 0).alias("b"))
    rows = F.array(F.struct(F.lit("source_items").alias("kind"), F.col("a").alias("n")), F.struct(F.lit("empty_raw_items").alias("kind"), F.col("b").alias("n")))
    by_reason = seen.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return totals.select(F.explode(rows).alias("x")).select("x.kind", F.lit(None).cast("string").alias("name"), "x.n").unionByName(by_reason.select(F.lit("empty_by_reason").alias("kind"), F.col("reason").alias("name"), "n"))


def run_summary(results: DataFrame) -> DataFrame:
    """(kind, name, n) of task results (status, strategy, source_items, empty_reason): tasks by outcome, by the strategy that
    worked, items, and empty results by reason. Every status other than saved, unchanged and error counts as skipped."""
    status = F.when(F.col("status").isin("saved", "unchanged", "error"), F.col("status")).otherwise("skipped")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = F.array(
        F.struct(F.lit("tasks").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("status").alias("kind"), status.alias("name"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("by_strategy").alias("kind"), some("strategy").alias("name"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("source_items").alias("kind"), F.lit(None).cast("string").alias("name"), F.coalesce("source_items", F.lit(0)).cast("long").alias("n")),
        F.struct(F.lit("empty_by_reason").alias("kind"), some("empty_reason").alias("name"), F.lit(1).cast("long").alias("n")),
    )
    rows = results.select(F.explode(parts).alias("x")).select("x.*").filter("name is not null or kind in ('tasks', 'source_items')")
    return rows.groupBy("kind", "name").agg(F.sum("n").alias("n"))


def success_rate(produced: Column, tasks: Column) -> Column:
    """The share of tasks that gave data, to three places; 0 without tasks."""
    return F.when(tasks == 0, 0.0).otherwise(F.round(produced / tasks, 3))


def level_counters(results: DataFrame, levels: str = "quality_levels") -> DataFrame:
    """(level, passed, failed) over a map of level to a struct with ``passed``."""
    rows = results.select(F.explode(levels).alias("level", "info"))
    ok = F.coalesce(F.col("info.passed"), F.lit(False))
    return rows.groupBy("level").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def low_quality_sources(results: DataFrame, order: str) -> DataFrame:
    """(source, first): sources with a low-quality result, each once, with the place of its first one."""
    low = results.filter("quality_status = 'low_quality' and coalesce(source, '') <> ''")
    return low.groupBy("source").agg(F.min(order).alias("first"))


def stage_counters(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row with how many rows each condition holds for, as a stage reports them."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counters.items()])


def run_status(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, stages, failed, status): partial_failed where a stage failed, else succeeded."""
    out = stages.groupBy(run).agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "partial_failed").otherwise("succeeded"))


def domains_found(candidates: DataFrame, lists: str) -> DataFrame:
    size = F.size(lists)
    return candidates.agg(F.coalesce(F.sum(F.when(size > 0, size).otherwise(0)), F.lit(0)).alias("domains_found"))


def mean_confidence(parts: DataFrame, group: str, confidence: str) -> DataFrame:
    """(group, confidence, parts): the mean to three places, 0 without any."""
    out = parts.groupBy(group).agg(F.avg(confidence).alias("confidence"), F.count(F.lit(1)).alias("parts"))
    return out.withColumn("confidence", F.round(F.coalesce("confidence", F.lit(0.0)), 3))


def merged_map(parts: DataFrame, group: str, field: str, order: list[Column]) -> DataFrame:
    """(group, key, value): for each key of the parts' maps the first value, in their order, that isn't blank."""
    pairs = parts.select("*", F.explode(field).alias("key", "value")).filter("value is not null and value <> ''")
    first = F.row_number().over(W.partitionBy(group, "key").orderBy(*order))
    return pairs.withColumn("_first", first).filter("_first = 1").select(group, "key", "value")


def item_key(url: Column, title: Column, published: Column) -> Column:
    """What makes two collected items the same: the URL, else title and date; null (never the same) without either."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(url), F.when(filled(title).isNotNull(), F.concat_ws("\u0001", title, F.coalesce(published, F.lit("")))))


def first_occurrences(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in their order; rows with a null key all stay.

    Rows without a key don't meet: they skip the window.
    """
    keyed = df.withColumn("_key", key)
    numbered = keyed.filter("_key is not null").withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy(*order))).filter("_nth = 1")
    return numbered.drop("_key", "_nth").unionByName(keyed.filter("_key is null").drop("_key"))


def top_candidates(df: DataFrame, group: str, key: Column, order: list[Column], most: int) -> DataFrame:
    """Of each group the first ``most`` rows after each key has been cut to its first row, with their place ``nth``."""
    once = df.withColumn("_key", key).withColumn("_nth", F.row_number().over(W.partitionBy(group, "_key").orderBy(*order))).filter("_nth = 1 and _key is not null")
    return once.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("nth") <= most).drop("_key", "_nth")


def longest_text(*candidates: Column) -> Column:
    """The longest of the texts; of equally long ones the earliest stage's; null if all are."""
    found = F.filter(F.array(*[F.struct(F.length(c).alias("n"), F.lit(-i).alias("stage"), c.alias("text")) for i, c in enumerate(candidates)]), lambda x: x["text"].isNotNull())
    return F.array_max(found)["text"]


def first_success(attempts: DataFrame, group: str, ok: Column, order: str) -> DataFrame:
    """(group, winner, tried): the place of the first attempt that succeeded, null for none, and how many there were."""
    return attempts.groupBy(group).agg(F.min(F.when(ok, F.col(order))).alias("winner"), F.count(F.lit(1)).alias("tried"))


def latest_quality(raw: DataFrame, task: str = "search_task_id") -> DataFrame:
    """(task, quality_levels): those of the first item that has any, in the task's newest snapshot."""
    levels = F.filter(F.transform("raw_data.items", lambda x: x["extra"]["quality_levels"]), lambda x: x.isNotNull())
    newest = F.max_by(F.get(levels, F.lit(0)), F.struct("created_at", "id"))
    return raw.groupBy(task).agg(newest.alias("quality_levels"))
