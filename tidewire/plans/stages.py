"""The stages of the media pipeline over its own tables: snapshots to items, items to the mart, alerts, actions, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text, urls, values
from tidewire.operators import rows, rules

# Reasons of rejection that the breakdown lists.
REJECT_REASONS = ("black_domain", "stop_word", "stop_topic", "false_positive", "parse_error")


def pending_snapshots(raw: DataFrame, silver: DataFrame) -> DataFrame:
    """The newest valid snapshot of each task, unless its items are stored already."""
    latest = rows.newest(raw.filter("status <> 'error'"), ["search_task_id"], [F.desc("created_at"), F.desc("id")])
    return latest.join(silver.select(F.col("raw_item_id").alias("id")), "id", "left_anti")


def items(snapshots: DataFrame) -> DataFrame:
    """A row for each item of a snapshot; none for empty ones."""
    return snapshots.select(F.col("id").alias("raw_item_id"), "search_task_id", "created_at", F.col("raw_data.meta").alias("meta"), F.posexplode("raw_data.items").alias("pos", "item"))


def normalized(found: DataFrame, competitors: DataFrame, regions: DataFrame, tasks: DataFrame, black: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """Clean items with dimension ids, dedup key and status; the first of each key stays."""
    by_name = competitors.filter("is_active").groupBy(F.lower("name").alias("_competitor")).agg(F.max("id").alias("competitor_id"))
    by_alias = regions.select(F.explode("name_aliases").alias("a"), "id").groupBy(F.lower("a").alias("_region")).agg(F.max("id").alias("region_id"))
    sources = tasks.select(F.col("id").alias("search_task_id"), "source_id")
    out = found.withColumn("_competitor", F.lower("meta.competitor")).withColumn("_region", F.lower(F.btrim("item.region")))
    out = out.join(by_name, "_competitor", "left").join(by_alias, "_region", "left").join(sources, "search_task_id", "left")
    title, day = text.clean_full(F.col("item.title")), values.parsed_date(F.col("item.published_at"))
    out = out.withColumn("title", F.coalesce(title, F.lit(text.NO_TITLE))).withColumn("text", text.clean_full(F.col("item.text"))).withColumn("published_at", day)
    out = out.withColumn("media_domain", urls.domain(F.col("item.url"))).withColumn("url", F.col("item.url"))
    out = out.withColumn("dedup_key", values.dedup_key(F.col("meta.competitor"), F.col("published_at"), F.col("item.region"), title=F.col("title")))
    listed = black.filter("is_active").select(F.col("domain").alias("media_domain"), F.lit(True).alias("_black")).distinct()
    out = out.join(listed, "media_domain", "left")
    reason = F.when(F.col("title") == text.NO_TITLE, "parse_error").when(F.col("_black"), "black_domain").otherwise(rules.first_phrase(F.concat_ws(" ", "title", "text"), phrases))
    out = out.withColumn("reject_reason", reason).withColumn("status", F.when(F.col("reject_reason").isNull(), "ok").otherwise("rejected"))
    return rows.newest(out, ["dedup_key"], [F.asc("raw_item_id"), F.asc("pos")]).drop("_competitor", "_region", "_black", "meta", "item")


def reject_breakdown(silver: DataFrame) -> DataFrame:
    """A count for each listed reason, zeros included."""
    names = silver.sparkSession.createDataFrame([(r,) for r in REJECT_REASONS], "reject_reason string")
    counts = silver.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "reject_reason", "left").select("reject_reason", F.coalesce("n", F.lit(0)).alias("n"))


def alerts(mart: DataFrame, types: DataFrame, routing: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts that are new: of events never checked or changed since, routed, and not stored."""
    fresh = mart.filter("alerted_at is null or updated_at > alerted_at").withColumnRenamed("id", "event_id")
    found = rules.routed(rules.least_type(fresh, "title", types), routing)
    return found.join(stored.select(F.col("showcase_event_id").alias("event_id"), "user_id", "channel_id"), ["event_id", "user_id", "channel_id"], "left_anti")


def action_items(mart: DataFrame, gold: DataFrame) -> DataFrame:
    """A row for each task of a p1 or p2 event that has made none yet; none without a department."""
    due = mart.filter("action_items_generated_at is null and priority in ('П1', 'П2')").select(F.col("id").alias("showcase_event_id"), "categorized_event_id")
    joined = due.join(gold, due["categorized_event_id"] == gold["id"])
    return joined.filter("department_id is not null").select("showcase_event_id", F.explode("task").alias("task"), "department_id", "deadline", "expected_result", F.lit("new").alias("status"))


def promoted(candidates: DataFrame, sources: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(new sources, all selected candidates): active new ones with a score above the threshold; known names aren't inserted."""
    chosen = candidates.filter("is_active and status = 'new' and score is not null").filter(F.col("score") > threshold)
    new = chosen.select(F.col("domain").alias("name")).filter("name is not null").distinct().join(sources.select("name"), "name", "left_anti")
    return new, chosen.withColumn("status", F.lit("promoted"))
