"""State that stages keep in columns and small tables: marks, retention, circuit breakers, run slots, schedules, task scopes."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.urls import host
from tidewire.operators.rows import free_name, matrix

#: Layers of the pipeline, each downstream of the one before.
PIPELINE_ORDER = ("raw_item", "normalized_item", "categorized_event", "showcase_event", "alert", "action_item", "source_candidate")
#: Days for which adapters, classes, article texts and probed addresses stay valid; hours for which a failing source is blocked.
KEEP_DAYS, BLOCK_HOURS, DISABLE_AT = 7, 24, 3
#: Failures in a row after which a source's adapter is learned anew; seconds without a heartbeat after which a run is stale.
RESET_AT, STALE_SECONDS = 2, 1800


def marked(table: DataFrame, considered: DataFrame, column: str, now: Column, key: str = "id") -> DataFrame:
    """``table`` with ``column`` set to ``now`` on every considered row, whatever came of it; ``updated_at`` stays."""
    mark = free_name(table, "mark")
    ids = considered.select(F.col(key), F.lit(True).alias(mark)).distinct()
    return table.join(ids, key, "left").withColumn(column, F.when(F.col(mark), now).otherwise(F.col(column))).select(*table.columns)


def reparsed(stored: DataFrame, new: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Stored rows take status and reason from the new row of their key, and rows of new keys are added.

    A row that a limit had rejected is valid again until the limits run again. Of equal keys in ``new`` the caller keeps one.
    """
    change = free_name(stored, "change")
    kept = stored.join(new.select(key, F.struct("status", "reject_reason").alias(change)), key, "left")
    for column in ("status", "reject_reason"):
        kept = kept.withColumn(column, F.when(F.col(change).isNotNull(), F.col(change)[column]).otherwise(F.col(column)))
    return kept.select(*stored.columns).unionByName(new.join(stored.select(key), key, "left_anti").select(*stored.columns))


def kept_until(stored: Column, days: int = KEEP_DAYS) -> Column:
    return stored + F.expr(f"interval {days} days")


def alive(table: DataFrame, now: Column, stored: str = "stored_at", days: int = KEEP_DAYS) -> DataFrame:
    """Rows whose time to live isn't over."""
    return table.filter(kept_until(F.col(stored), days) > now)


def circuit(streaks: DataFrame, now: Column, failed_at: str = "failed_at", streak: str = "streak") -> DataFrame:
    """``streaks`` with ``state``: disabled from DISABLE_AT failures in a row, blocked for BLOCK_HOURS after the last one, or open."""
    fresh = F.col(failed_at) + F.expr(f"interval {BLOCK_HOURS} hours") > now
    return streaks.withColumn("state", F.when(F.col(streak) >= DISABLE_AT, "disabled").when((F.col(streak) > 0) & fresh, "blocked").otherwise("open"))


def adapters_to_reset(streaks: DataFrame, streak: str = "streak") -> DataFrame:
    """Sources whose adapter has failed the quality gate RESET_AT times in a row."""
    return streaks.filter(F.col(streak) >= RESET_AT)


def reconciled(classes: DataFrame, fetched: DataFrame, key: str = "source") -> DataFrame:
    """Stored classes with those of the latest successful fetch in their place."""
    newest = fetched.filter("ok").groupBy(key).agg(F.max_by(F.struct(*[c for c in classes.columns if c != key]), "fetched_at").alias("_new"))
    out = classes.select(F.col(key), F.struct(*[c for c in classes.columns if c != key]).alias("_old")).join(newest, key, "full")
    return out.select(key, F.coalesce("_new", "_old").alias("_x")).select(key, "_x.*").select(*classes.columns)


def free_slot(runs: DataFrame) -> bool:
    """Whether a run may start: one is active at a time."""
    return runs.filter("status in ('queued', 'running')").isEmpty()


def stale_runs(runs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Active runs whose heartbeat is too old."""
    return runs.filter("status in ('queued', 'running')").filter(F.col("heartbeat") < now - F.expr(f"interval {seconds} seconds"))


def _matches(part: str, value: int, least: int, most: int) -> bool:
    for piece in part.split(","):
        span, _, step = piece.partition("/")
        low, _, high = span.partition("-")
        a, b = (least, most) if low == "*" else (int(low), int(high or (most if step else low)))
        if a <= value <= b and (value - a) % int(step or 1) == 0:
            return True
    return False


def cron_slot(cron: str, zone: str, now: datetime, forward: bool = False) -> datetime:
    """The last slot at or before ``now``, or the next one after it, of minute, hour, day, month and weekday, in UTC.

    Local times that a change of clocks leaves out have no slot. Days of month and week both restrict when both are given.
    """
    minute, hour, day, month, weekday = cron.split()
    local = now.astimezone(ZoneInfo(zone)).replace(second=0, microsecond=0)
    at = local.replace(tzinfo=None) + timedelta(minutes=1 if forward else 0)
    for _ in range(366 * 24 * 60):
        fits_day = _matches(day, at.day, 1, 31) and _matches(month, at.month, 1, 12) and _matches(weekday, at.isoweekday() % 7, 0, 6)
        if not fits_day:
            at = (at + timedelta(days=1)).replace(hour=0, minute=0) if forward else at.replace(hour=0, minute=0) - timedelta(minutes=1)
            continue
        if _matches(hour, at.hour, 0, 23) and _matches(minute, at.minute, 0, 59):
            there = at.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
            if there.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == at:
                return there
        at += timedelta(minutes=1 if forward else -1)
    raise ValueError(f"{cron} has no slot within a year")


def due(cron: str, zone: str, now: datetime, last_scheduled_for: datetime | None) -> datetime | None:
    """The slot to run for, or None: each slot is dispatched once."""
    slot = cron_slot(cron, zone, now)
    return None if last_scheduled_for is not None and last_scheduled_for >= slot else slot


def downstream(layer: str) -> list[str]:
    """``layer`` and all that are made from it, the last first: the order in which they are cleared."""
    return list(reversed(PIPELINE_ORDER[PIPELINE_ORDER.index(layer) :]))


def missing_tasks(competitors: DataFrame, sources: DataFrame, tasks: DataFrame, competitor_ids: list | None = None, source_ids: list | None = None) -> DataFrame:
    """(competitor_id, source_id) that have no task without a trigger yet: active ones of either side, or of the ids given."""
    a = competitors.filter("is_active").select(F.col("id").alias("competitor_id"))
    b = sources.filter("is_active").select(F.col("id").alias("source_id"))
    a = a if competitor_ids is None else a.filter(F.col("competitor_id").isin(competitor_ids))
    b = b if source_ids is None else b.filter(F.col("source_id").isin(source_ids))
    return matrix(a, b, tasks.filter("trigger_id is null").select("competitor_id", "source_id"))


def task_scope(tasks: DataFrame, competitors: DataFrame, sources: DataFrame, competitor_id: int | None = None, source_id: int | None = None) -> DataFrame:
    """Tasks of a collection job with both names: of one source, of one competitor, or all; the other side must be active."""
    a = competitors.filter("is_active").select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor"))
    b = sources.filter("is_active").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    out = tasks.filter("is_active").join(a, "competitor_id").join(b, "source_id")
    out = out if competitor_id is None else out.filter(F.col("competitor_id") == competitor_id)
    return out if source_id is None else out.filter(F.col("source_id") == source_id)


def task_config(tasks: DataFrame, competitors: DataFrame, sources: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each task with the names that its collection needs; only a trigger may be missing."""
    named = lambda dim, key, column, *more: dim.select(F.col("id").alias(key), F.col(column).alias(key.removesuffix("_id")), *more)
    out = tasks.join(named(competitors, "competitor_id", "name", "inn"), "competitor_id").join(named(sources, "source_id", "name"), "source_id")
    return out.join(named(triggers, "trigger_id", "keyword"), "trigger_id", "left")


def by_host(names: DataFrame, name: str, sources: DataFrame) -> DataFrame:
    """``names`` with ``source_id``: the source of that very name, else the first one of the same bare host, else null."""
    exact = sources.groupBy(F.col("name").alias(name)).agg(F.min("id").alias("_exact"))
    hosts = sources.withColumn("_host", host(F.col("name"))).filter("_host is not null").groupBy("_host").agg(F.min("id").alias("_near"))
    out = names.withColumn("_host", host(F.col(name))).join(exact, name, "left").join(hosts, "_host", "left")
    return out.withColumn("source_id", F.coalesce("_exact", "_near")).select(*names.columns, "source_id")


def find_or_create(dim: DataFrame, names: DataFrame, key: Column, by: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``names`` with the id they have or get, rows to append): names are equal by ``by`` of the dimension and ``key``."""
    from tidewire.operators.listing import inserted

    wanted = names.withColumn("_key", key)
    known = dim.groupBy(by.alias("_key")).agg(F.min("id").alias("id"))
    new = wanted.join(known, "_key", "left_anti").groupBy("_key").agg(F.min("name").alias("name"))
    every = inserted(dim.select("id", "name"), new.select("name"))
    added = every.join(dim.select("id"), "id", "left_anti")
    ids = known.unionByName(added.join(new, "name").select("_key", "id"))
    return wanted.join(ids, "_key", "left").drop("_key"), added
